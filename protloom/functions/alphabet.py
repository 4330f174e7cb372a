"""Residue alphabets: validation, ambiguity, stop codons, reduced encodings; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidMoltype

# The residues, and the groups of the reduced alphabets.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
SPECIAL = "XUO*"
AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "IL"}
HP_GROUPS = {"h": "AFGILMPVWY", "p": "CDEHKNQRST"}
DAYHOFF_GROUPS = {"a": "C", "b": "AGPST", "c": "DENQ", "d": "HKR", "e": "ILMV", "f": "FWY"}
#: What reduced alphabets write for letters outside their groups.
UNKNOWN = "X"

_UNKNOWN: dict[str, str] = {}
_GROUPS = {"protein": None, "raw": None, "hp": HP_GROUPS, "dayhoff": DAYHOFF_GROUPS}


def table_of(moltype: str) -> dict[str, str] | None:
    """Letter to symbol, or None where the letters stay."""
    if moltype not in _GROUPS:
        raise InvalidMoltype(moltype)
    groups = _GROUPS[moltype]
    if groups is None:
        return None
    table = {residue: symbol for symbol, members in groups.items() for residue in members}
    return {**{c: _UNKNOWN.get(moltype, UNKNOWN) for c in SPECIAL}, **table}


def register(moltype: str, groups: dict[str, str], unknown: str = UNKNOWN) -> None:
    """A reduced alphabet of one's own: symbol to the letters that it stands for; other special letters become ``unknown``."""
    letters = "".join(groups.values())
    if moltype in ("protein", "raw", "hp", "dayhoff") or not groups:
        raise ValueError(f"{moltype!r} is built in, or has no groups")
    if len(set(letters)) != len(letters) or not (letters + "".join(groups)).isascii() or any(len(symbol) != 1 for symbol in groups) or len(unknown) != 1:
        raise ValueError("symbols are single ASCII characters, and a letter stands in one group")
    _GROUPS[moltype] = dict(groups)
    _UNKNOWN[moltype] = unknown


def encode(sequence: Column, moltype: str) -> Column:
    """The sequence in an alphabet."""
    table = table_of(moltype)
    return sequence if table is None else F.translate(sequence, "".join(table), "".join(table.values()))


def is_valid_residue(letter: Column) -> Column:
    return letter.rlike(r"^[A-Z*]$")


def first_invalid(sequence: Column) -> Column:
    """``char, position`` (from 1) of the first letter that is no residue and stands before any stop codon; null if there is none."""
    good = F.length(F.regexp_extract(sequence, "^[A-Z]*", 0))
    char = F.substr(sequence, good + 1, F.lit(1))
    return F.when((char != "") & (char != "*"), F.struct(char.alias("char"), (good + 1).alias("position")))


def truncate_at_stop(sequence: Column) -> Column:
    """Everything up to the first stop codon, with it."""
    return F.regexp_extract(sequence, r"^[^*]*\*?", 0)


def resolve_ambiguity(sequence: Column, seed: int | None = None) -> Column:
    """B, Z and J as the first residue they can stand for; with a seed, as either, by a hash of the place and the sequence."""
    if seed is None:
        for name, residues in AMBIGUOUS.items():  # no residue is a name; ``translate`` looks up each letter of a sequence
            sequence = F.replace(sequence, F.lit(name), F.lit(residues[0]))
        return sequence
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")

    def resolve(letter: Column, place: Column) -> Column:
        second = F.pmod(F.xxhash64(sequence, place, F.lit(seed)), F.lit(2)) == 1
        out = letter
        for name, (a, b) in AMBIGUOUS.items():
            out = F.when(letter == name, F.when(second, b).otherwise(a)).otherwise(out)
        return out

    return F.array_join(F.transform(letters, resolve), "")


def validate_and_resolve(sequence: Column, seed: int | None = None) -> Column:
    """The truncated, resolved sequence; an invalid residue fails the job."""
    bad = first_invalid(sequence)
    message = F.format_string("Invalid amino acid '%s' found at position %d", bad["char"], bad["position"])
    return F.when(bad.isNotNull(), F.raise_error(message)).otherwise(resolve_ambiguity(truncate_at_stop(sequence), seed))


def letters_only(text: Column) -> Column:
    """Any text as a sequence: its ASCII letters in upper case, ambiguity resolved."""
    return resolve_ambiguity(F.upper(F.regexp_replace(text, "[^A-Za-z]+", "")))
