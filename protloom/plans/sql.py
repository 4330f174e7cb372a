"""DuckDB SQL for residue sequences, k-mers and their hashes, as lists of named subqueries."""

from __future__ import annotations

from ..functions import alphabet

_WORD = 2**64


def _mul(a: str, b: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % CAST({_WORD} AS UHUGEINT) AS UBIGINT)"


def _add(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % CAST({_WORD} AS UHUGEINT) AS UBIGINT)"


def _down(a: str, bits: int) -> str:
    return f"({a} >> CAST({bits} AS UBIGINT))"


def _rotl(a: str, bits: int) -> str:
    return f"(CAST((CAST({a} AS UHUGEINT) * CAST({2**bits} AS UHUGEINT)) % CAST({_WORD} AS UHUGEINT) AS UBIGINT) | {_down(a, 64 - bits)})"


def sequences(p: str, table: str, key: str) -> list[tuple[str, str]]:
    """``{p}_s``: name and sequence of each row of a text table."""
    return [(f"{p}_s", f"SELECT CAST({key} AS VARCHAR) AS name, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BZJ', 'DEI') AS sequence FROM {table}")]


def kmers(p: str, table: str, key: str, ksize: int, moltype: str) -> list[tuple[str, str]]:
    """``{p}_k``: name, start, kmer, encoded, hash (UBIGINT), for at most 8 letters, which the hash's tail holds."""
    if not 1 <= ksize <= 8:
        raise ValueError("1 to 8 letters")
    own = alphabet.table_of(moltype)
    encoded = "kmer" if own is None else f"translate(kmer, '{''.join(own)}', '{''.join(own.values())}')"
    word = " + ".join(f"CAST(ascii(substr(encoded, {i + 1}, 1)) AS UHUGEINT) * CAST({256**i} AS UHUGEINT)" for i in range(ksize))
    steps = [
        f"SELECT encoded, CAST({word} AS UBIGINT) AS x FROM (SELECT DISTINCT encoded FROM {p}_e)",
        f"SELECT encoded, {_mul('x', 0x87C37B91114253D5)} AS x",
        f"SELECT encoded, {_rotl('x', 31)} AS x",
        f"SELECT encoded, {_mul('x', 0x4CF5AD432745937F)} AS x",
        f"SELECT encoded, xor(xor(CAST(42 AS UBIGINT), x), CAST({ksize} AS UBIGINT)) AS a, xor(CAST(42 AS UBIGINT), CAST({ksize} AS UBIGINT)) AS b",
        f"SELECT encoded, {_add('a', 'b')} AS a, b",
        f"SELECT encoded, a, {_add('a', 'b')} AS b",
    ]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        steps += [f"SELECT encoded, xor(a, {_down('a', 33)}) AS a, xor(b, {_down('b', 33)}) AS b", f"SELECT encoded, {_mul('a', factor)} AS a, {_mul('b', factor)} AS b"]
    steps += [f"SELECT encoded, xor(a, {_down('a', 33)}) AS a, xor(b, {_down('b', 33)}) AS b", f"SELECT encoded, {_add('a', 'b')} AS hash"]
    named = [(f"{p}_h{i}", s if not i else f"{s} FROM {p}_h{i - 1}") for i, s in enumerate(steps)]
    return [
        *sequences(p, table, key),
        (f"{p}_i", f"SELECT name, sequence, unnest(range(1, length(sequence) - {ksize} + 2)) AS i FROM {p}_s"),
        (f"{p}_w", f"SELECT name, CAST(i - 1 AS INTEGER) AS start, substr(sequence, i, {ksize}) AS kmer FROM {p}_i"),
        (f"{p}_e", f"SELECT *, {encoded} AS encoded FROM {p}_w"),
        *named,
        (f"{p}_k", f"SELECT e.name, e.start, e.kmer, e.encoded, h.hash FROM {p}_e e JOIN {named[-1][0]} h USING (encoded)"),
    ]


def sketch(p: str, *args: object) -> list[tuple[str, str]]:
    """Also ``{p}_t``: name, hash, abund."""
    return [*kmers(p, *args), (f"{p}_t", f"SELECT name, hash, count(*) AS abund FROM {p}_k GROUP BY ALL")]


def statement(parts: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts) + f"\n{last}"
