import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from protloom.errors import InvalidMoltype
from protloom.functions import alphabet, hashing


def column(spark, values, expression, name="s"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{name} string").select(expression).collect()]


def test_hash_goldens():
    for text, want in (("PLANT", 5893010049374798421), ("bebcb", 5045972850709227854), ("hhhpp", 4230974618842309829)):
        assert int(hashing.murmur(np.frombuffer(text.encode(), np.uint8)[None, :])[0]) == want


def scalar_murmur(key, seed=42):
    m, c1, c2 = 2**64 - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: (x << r | x >> 64 - r) & m

    def mix(k):
        k ^= k >> 33
        k = k * 0xFF51AFD7ED558CCD & m
        k ^= k >> 33
        k = k * 0xC4CEB9FE1A85EC53 & m
        return k ^ k >> 33

    a = b = seed
    n = len(key) // 16
    for i in range(n):
        x, y = (int.from_bytes(key[16 * i + o : 16 * i + o + 8], "little") for o in (0, 8))
        a = (rot(a ^ rot(x * c1 & m, 31) * c2 & m, 27) + b) * 5 + 0x52DCE729 & m
        b = (rot(b ^ rot(y * c2 & m, 33) * c1 & m, 31) + a) * 5 + 0x38495AB5 & m
    tail = key[16 * n :]
    if len(tail) > 8:
        b ^= rot(int.from_bytes(tail[8:], "little") * c2 & m, 33) * c1 & m
    if tail:
        a ^= rot(int.from_bytes(tail[:8], "little") * c1 & m, 31) * c2 & m
    a, b = a ^ len(key), b ^ len(key)
    a = a + b & m
    b = a + b & m
    return mix(a) + mix(b) & m


@given(st.binary(min_size=1, max_size=50))
def test_hash_by_definition(key):
    assert int(hashing.murmur(np.frombuffer(key, np.uint8)[None, :])[0]) == scalar_murmur(key)


def test_sampling_limit():
    assert hashing.max_hash(1) == 2**64 - 1 and hashing.max_hash(5) == 3689348814741910528


def test_unsigned(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    assert [r[0] for r in df.select(hashing.unsigned_text(F.col("h"))).collect()] == [str(v % 2**64) for v in values]
    assert df.select(hashing.wrapped_sum_hex(F.col("h"))).first()[0] == f"{sum(values) % 2**64:x}"
    assert [r["h"] for r in df.orderBy(hashing.sortable(F.col("h"))).collect()] == sorted(values, key=lambda v: v % 2**64)


def test_encodings(spark):
    s = F.col("s")
    assert column(spark, ["LIVINGALIVE", "XUO*"], alphabet.encode(s, "dayhoff")) == ["eeeecbbeeec", "XXXX"]
    assert column(spark, ["LIVINGALIVE"], alphabet.encode(s, "hp")) == ["hhhhphhhhhp"]
    assert column(spark, ["LIVINGALIVE"], alphabet.encode(s, "raw")) == ["LIVINGALIVE"]
    with pytest.raises(InvalidMoltype, match="Invalid molecular type: dna"):
        alphabet.encode(s, "dna")
    assert set("".join(alphabet.HP_GROUPS.values())) == set("".join(alphabet.DAYHOFF_GROUPS.values())) == set(alphabet.RESIDUES)


def test_validation(spark):
    s = F.col("s")
    got = column(spark, ["PLANTANDANIMALGEN1MES", "ACDEF*gh1", "ACD", "", "aB", "A$"], alphabet.first_invalid(s))
    assert [tuple(x) if x else None for x in got] == [("1", 18), None, None, None, ("a", 1), ("$", 2)]
    assert column(spark, ["ACDEF*GHI", "A", "*"], alphabet.truncate_at_stop(s)) == ["ACDEF*", "A", "*"]
    assert column(spark, ["ACDEFXBZJ"], alphabet.validate_and_resolve(s)) == ["ACDEFXDEI"]
    with pytest.raises(Exception, match="Invalid amino acid '1' found at position 18"):
        column(spark, ["PLANTANDANIMALGEN1MES"], alphabet.validate_and_resolve(s))
    assert column(spark, ["A", "*", "a", "1"], alphabet.is_valid_residue(s)) == [True, True, False, False]


def test_seeded_resolution_is_stable(spark):
    s = F.col("s")
    a, b = (column(spark, ["BZJ" * 40], alphabet.resolve_ambiguity(s, seed))[0] for seed in (1, 1))
    assert a == b and set(a) <= set("DNEQIL") and len(set(a)) == 6


def test_letters_only(spark):
    assert column(spark, ["Ab, z É1!"], alphabet.letters_only(F.col("s"))) == ["ADE"]


def test_hashes_of_windows_equal_those_of_keys():
    rng = np.random.default_rng(1)
    for symbols in (b"hp", b"abcdef", bytes(range(65, 90)), b"h"):
        data = rng.choice(np.frombuffer(symbols, np.uint8), 3000)
        for k in (1, 3, 7, 8, 9, 16, 17, 40):
            want = hashing.murmur(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)))
            assert (hashing.murmur_windows(data, k) == want).all()
            assert len(hashing.murmur_windows(data[: k - 1], k)) == 0
