"""Every query against its SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from protloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 14) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rounded(df.select(*cols).collect()) == rounded(want)
    assert want


def test_contract(spark):
    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_queries_do_without_the_optional_part(spark, monkeypatch):
    find = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None if name.endswith("llm") else find(name))
    assert set(entry.queries()) == set(registry.queries())


@pytest.mark.parametrize("name", ["kmer_positions", "kmer_info_map", "sketch_abundance", "kmer_idf_frequency", "unique_kmer_count", "index_equivalence"])
def test_targets_are_covered(spark, name):
    over = registry.queries()[f"{name}_documents"](spark, SF)
    if name == "index_equivalence":
        assert {(r["other"], r["equal"]) for r in over.collect()} == {("hp", True), ("dayhoff", False)}
    elif name == "kmer_idf_frequency":
        assert over.agg({"df": "max"}).first()[0] > registry.queries()[name](spark, SF).agg({"df": "max"}).first()[0]
    else:
        names = {r["name"] for r in over.select("name").distinct().collect()}
        long_enough = registry.scaled_sample(spark, SF).select("name").distinct().count()
        assert len(names) >= long_enough > 40
