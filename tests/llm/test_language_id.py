import zlib

import unicodedata

import pytest
import zstandard
from pyspark.sql import functions as F

from protloom.llm import language_id as li


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in li.language_table(docs, model).collect()}
    right = total = 0
    for d in docs.collect():
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            total, right = total + 1, right + (r["lang_pred"] == d["lang"])
    assert total > 200 and right / total > 0.97
    assert sum(r["rejected"] for r in got.values()) < 0.02 * len(got)


def test_labels_of_held_out_rows_do_not_matter(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = li.fit(docs.withColumn("lang", F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang"))))
    assert other == model


def test_odd_rows(spark, model, odd_docs, no_docs):
    got = li.language_table(odd_docs, model).collect()
    docs = odd_docs.collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert {r["lang_pred"] for r in got} <= {*model.languages, "und"}
    assert by[6]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert li.language_table(no_docs, model).collect() == []
    assert {r["lang_pred"] for r in li.language_table(odd_docs, li.fit(no_docs)).collect()} == {"und"}
    assert [r["language"]["lang_pred"] for r in li.predict(odd_docs, model).collect()] == [r["lang_pred"] for r in got]


def test_spans_cover_long_texts(model):
    few = li.Identifier(li.Model(model.languages, model.contents, span_bytes=100))
    assert few("this is the of and in that " * 40)[0] == "en"
    assert sum(few.sizes(b"a" * 250)) > sum(few.sizes(b"a" * 100))


def plain(text, model):
    """Language, margin and sizes with compressors of its own."""
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    own = " ".join(letters.split()).encode()
    if not own:
        return "und", 0.0, []
    sizes = []
    for content in model.contents:
        size = 0
        for k in range(0, len(own), model.span_bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size += len(zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False).compress(own[k : k + model.span_bytes]))
        sizes.append(size)
    best = sizes.index(min(sizes))
    return model.languages[best], (min(sizes[:best] + sizes[best + 1 :]) - sizes[best]) / min(sizes[:best] + sizes[best + 1 :]), sizes


def test_equals_the_plain_version(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    own = li.fit(spark.read.parquet(f"{sf}/documents.parquet"), dict_bytes=4096, draws=32)
    identify = li.Identifier(own)
    got = li.language_table(docs, own).collect()
    for d, r in zip(docs.collect(), got, strict=True):
        lang, margin, sizes = plain(d["text"], own)
        assert (r["doc_id"], r["lang_pred"]) == (d["doc_id"], lang) and r["margin"] == pytest.approx(margin)
        assert r["rejected"] == (lang == "und" or margin < li.MIN_MARGIN)
        assert not sizes or identify.sizes(li.normalise(d["text"])) == sizes


def test_numerals_are_no_letters(spark, model):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(("½", "²³", "Ⅷ", "①", "123 ¼", "_", "٣"))], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in li.language_table(rows, model).collect()} == {("und", 0.0)}


def test_a_dictionary_from_the_whole_of_long_texts(spark):
    text = "".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)} " for k in range(3000))
    rows = spark.createDataFrame([(1, text, "xx")] * 50, "doc_id long, text string, lang string")
    drawn = rows.select(li.spread(F.col("text"), 1600).alias("t")).first()["t"]
    assert len(drawn) <= 1600 + 16 and text[:90] in drawn and text[-740:-660] in drawn
    assert li.fit(rows, draw_chars=1600).contents == [li.normalise(drawn) + b" "]


def test_columns_of_any_name(spark, model):
    rows = spark.createDataFrame([(1, "the house of the lord", "x", "y")], "doc_id long, text string, language string, doc string")
    assert tuple(li.predict(rows, model).select("doc.*").first()) == (1, "the house of the lord", "x", "y")
