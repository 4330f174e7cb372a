"""One stored signature as an object, for callers that look at single records; collections stay tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Row


@dataclass
class StoredSignature:
    """Hashes with abundances, and the originals of each hash with their positions; hashes are unsigned.

    Whether a raw sequence is kept is settled when the record is made: without storage, setting one changes nothing.
    """

    name: str
    ksize: int
    moltype: str
    mins: list[int]
    abunds: list[int] | None = None
    kmer_infos: dict[int, dict] = field(default_factory=dict)
    raw_storage: bool = False
    raw_sequence: str | None = None

    def __post_init__(self) -> None:
        if not self.raw_storage:
            self.raw_sequence = None
        elif self.raw_sequence is None:
            self.raw_sequence = ""

    @classmethod
    def from_existing_data(cls, name: str, ksize: int, moltype: str, mins: list[int], abunds: list[int] | None = None, kmer_infos: dict[int, dict] | None = None, raw_sequence: str | None = None) -> StoredSignature:
        """With storage for a raw sequence if one is given."""
        return cls(name, ksize, moltype, list(mins), abunds, dict(kmer_infos or {}), raw_sequence is not None, raw_sequence)

    @classmethod
    def from_row(cls, row: Row, ksize: int, moltype: str) -> StoredSignature:
        """From a row of ``ProteinIndex.records``."""
        unsigned = lambda x: x % 2**64
        own = sorted((unsigned(h), n) for h, n in zip(row["mins"], row["abunds"], strict=True))
        infos = {unsigned(h): {"encoded_kmer": x["encoded_kmer"], "original_kmer_to_position": dict(x["original_kmer_to_position"])} for h, x in row["kmer_infos"].items()}
        return cls.from_existing_data(row["name"], ksize, moltype, [h for h, _ in own], [n for _, n in own], infos, row["raw_sequence"])

    @property
    def protein_ksize(self) -> int:
        return self.ksize

    @property
    def minhash_ksize(self) -> int:
        """Three nucleotides for each residue."""
        return 3 * self.ksize

    def has_efficient_data(self) -> bool:
        return bool(self.kmer_infos)

    def set_raw_sequence(self, sequence: str) -> None:
        if self.raw_storage:
            self.raw_sequence = sequence

    def get_raw_sequence(self) -> str | None:
        return self.raw_sequence

    def has_raw_sequence_storage(self) -> bool:
        return self.raw_storage

    def kmer_count(self) -> int:
        return len(self.mins)

    def estimated_size(self) -> int:
        """Bytes: the name, 8 for each hash and abundance, 12 and the encoded k-mer for each hash, 16 for each original, the raw sequence."""
        infos = sum(12 + len(x["encoded_kmer"]) + 16 * len(x["original_kmer_to_position"]) for x in self.kmer_infos.values())
        return len(self.name.encode()) + 8 * len(self.mins) + 8 * len(self.abunds or ()) + infos + len(self.raw_sequence or "")
