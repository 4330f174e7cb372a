"""Settings of an index, checked."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ConfigurationError

MAX_KSIZE, MAX_SCALED = 100, 10
MOLTYPES = ("protein", "dayhoff", "hp")


# The messages of ``kmer_size``, ``molecule_type`` and ``validate`` are fixed texts of the interface.


def kmer_size(value: int) -> int:
    """1 to 100."""
    if value < 1:
        raise ValueError("K-mer size must be greater than 0")
    if value > MAX_KSIZE:
        raise ValueError(f"K-mer size too large (max {MAX_KSIZE})")
    return value


def scaled_value(value: int) -> int:
    """1 to 10; one in so many hashes is kept."""
    if value < 1:
        raise ValueError("Scaled value must be greater than 0")
    if value > MAX_SCALED:
        raise ValueError(f"scaled is {value}, and at most {MAX_SCALED}")
    return value


def molecule_type(value: str) -> str:
    if value not in MOLTYPES:
        raise ValueError(f"Invalid molecular type: {value}. Must be one of: {', '.join(MOLTYPES)}")
    return value


@dataclass(frozen=True)
class PerformanceConfig:
    num_threads: int | None = None
    batch_size: int = 1000
    enable_metrics: bool = True
    progress_interval: int = 1000


@dataclass(frozen=True)
class MemoryConfig:
    max_memory_mb: int | None = None
    enable_monitoring: bool = False
    kmer_cache_size: int = 10_000


@dataclass(frozen=True)
class IndexConfig:
    """``IndexConfig.checked`` makes one whose k-mer size, sampling and alphabet are valid."""

    ksize: int
    scaled: int
    moltype: str
    path: str
    store_raw_sequences: bool = False
    performance: PerformanceConfig = field(default_factory=PerformanceConfig)
    memory: MemoryConfig = field(default_factory=MemoryConfig)

    @classmethod
    def checked(cls, ksize: int, scaled: int, moltype: str, path: str, **kw: object) -> IndexConfig:
        for name, check, value in (("ksize", kmer_size, ksize), ("scaled", scaled_value, scaled), ("moltype", molecule_type, moltype)):
            try:
                check(value)
            except ValueError as e:
                raise ConfigurationError(name, e) from e
        return cls(ksize, scaled, moltype, str(path), **kw)

    def validate(self) -> None:
        parent = Path(self.path).parent
        if not parent.exists():
            raise ConfigurationError("db_path", f"Database directory does not exist: {parent}")
        if self.performance.batch_size < 1:
            raise ConfigurationError("batch_size", "Batch size must be greater than 0")
        if self.memory.max_memory_mb is not None and self.memory.max_memory_mb < 1:
            raise ConfigurationError("max_memory_mb", "Maximum memory must be greater than 0")

    def effective_thread_count(self) -> int:
        return self.performance.num_threads or os.cpu_count() or 1

    def should_monitor_memory(self) -> bool:
        return self.memory.enable_monitoring or self.memory.max_memory_mb is not None
