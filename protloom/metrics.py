"""Counters and timers on the driver."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Lock

logger = logging.getLogger("protloom")


def _ratio(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


@dataclass(frozen=True)
class IndexMetrics:
    signatures_processed: int = 0
    kmers_processed: int = 0
    total_processing_time: float = 0.0
    memory_usage_bytes: int = 0
    database_operations: int = 0
    cache_hits: int = 0
    cache_misses: int = 0

    @property
    def avg_time_per_signature(self) -> float:
        return _ratio(self.total_processing_time, self.signatures_processed)

    def cache_hit_ratio(self) -> float:
        return _ratio(self.cache_hits, self.cache_hits + self.cache_misses)

    def kmers_per_second(self) -> float:
        return _ratio(self.kmers_processed, self.total_processing_time)

    def signatures_per_second(self) -> float:
        return _ratio(self.signatures_processed, self.total_processing_time)


class MetricsCollector:
    """Counts from several threads; time runs from its making."""

    def __init__(self) -> None:
        self._lock, self._began = Lock(), time.monotonic()
        self._counts = dict.fromkeys(("signatures_processed", "kmers_processed", "database_operations", "cache_hits", "cache_misses"), 0)

    def record(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._counts[name] += n

    def get_metrics(self) -> IndexMetrics:
        with self._lock:
            return IndexMetrics(total_processing_time=time.monotonic() - self._began, **self._counts)


@contextmanager
def timed(operation: str, log: bool = False) -> Iterator[list[float]]:
    """A list that holds the block's seconds once it has ended."""
    took: list[float] = []
    began = time.monotonic()
    try:
        yield took
    finally:
        took.append(time.monotonic() - began)
        if log:
            logger.info("%s took %.3f s", operation, took[0])
