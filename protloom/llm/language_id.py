"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw content: normalised text (the letters' words in lower case) of a
bounded sample of its labelled documents. A text is normalised, cut into spans of
``span_bytes`` so that the dictionary never leaves the window, and compressed once with each
language's dictionary; the smallest sum wins. Its margin is the saving over the second
smallest, as a share. Below ``min_margin`` the answer is rejected (``rejected``), as there is
next to no evidence; among equal sizes the language with more labelled documents comes first, then
the alphabet decides.

Letters are the characters of Unicode's letter categories; numerals are none, whatever they look like.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; texts of any length are compressed whole; repeated rows are each answered; rows without an id are answered, not learned from; an empty
table gives an empty result; without any labelled document all texts are ``und``; further columns are
ignored by ``language_table`` and carried along by ``predict``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import steps, texts
from ._store import table

UNDETERMINED = "und"
#: Bounds of the sample: a dictionary's bytes, documents drawn for a language, and characters used of each, which come
#: from ``DRAW_SPANS`` places spread over the whole of a longer text.
DICT_BYTES, DRAWS, DRAW_CHARS, DRAW_SPANS = 256 * 1024, 512, 16 * 1024, 16
#: Drawn documents of all languages up to which their hashes are broadcast; else all texts are dealt out to meet them.
BROADCAST_DRAWS = 500_000
LEVEL = 6
SPAN_BYTES = 64 * 1024
MIN_MARGIN = 0.002
#: The margin at which the score has come about two thirds of its way from 0.5 to 1.
SCALE = 0.03
_WORD = regex.compile(r"\p{L}+")


def normalise(text: str) -> bytes:
    """The runs of letters, in lower case, with one space between them."""
    return " ".join(_WORD.findall(text.lower())).encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Languages, those with more labelled documents first, and their dictionaries' contents."""

    languages: list[str]
    contents: list[bytes]
    level: int = LEVEL
    span_bytes: int = SPAN_BYTES
    min_margin: float = MIN_MARGIN


def learnable(id_col: str = "doc_id", lang_col: str = "lang") -> F.Column:
    return F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull()


def held_out(id_col: str = "doc_id") -> F.Column:
    """Ids whose digest leaves a remainder of 2; false for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(text: F.Column, chars: int, spans: int = DRAW_SPANS) -> F.Column:
    """The text, or, if it is longer than ``chars``, as many of its characters in spans at equal distances."""
    own = chars // spans
    parts = [F.substr(text, (F.length(text) * k / spans).cast("int") + 1, F.lit(own)) for k in range(spans)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dict_bytes: int = DICT_BYTES, draws: int = DRAWS, draw_chars: int = DRAW_CHARS, **kw: float) -> Model:
    """From a sample of the labelled rows that are not held out: of each language the document of least hash in each of
    ``draws`` hash classes, in hash order, until the dictionary is full."""
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    own = docs.where(learnable(id_col, lang_col)).select(F.col(lang_col).alias("_lang"), hashed.alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    drawn = own.groupBy("_lang", F.pmod("_hash", F.lit(draws)).alias("_class")).agg(F.min("_hash").alias("h"), F.count("*").alias("n")).collect()
    if not drawn:
        return Model([], [], **kw)
    n_of: dict[str, int] = {}
    for r in drawn:
        n_of[r["_lang"]] = n_of.get(r["_lang"], 0) + r["n"]
    languages = sorted(n_of, key=lambda x: (-n_of[x], x))
    # one row for each language and hash class, also where an id is repeated
    wanted = docs.sparkSession.createDataFrame([(r["_lang"], r["h"]) for r in drawn], "_lang string, _hash long")
    if len(drawn) <= BROADCAST_DRAWS:
        wanted = F.broadcast(wanted)
    found = own.join(wanted, ["_lang", "_hash"], "left_semi").groupBy("_lang", "_hash").agg(F.min(spread(F.coalesce("_text", F.lit("")), draw_chars)).alias("t"))
    contents = {x: bytearray() for x in languages}
    for r in sorted(found.collect(), key=lambda r: r["_hash"]):
        if len(contents[r["_lang"]]) < dict_bytes:
            contents[r["_lang"]] += normalise(r["t"]) + b" "
    return Model(languages, [bytes(contents[x][:dict_bytes]) for x in languages], **kw)


class Identifier:
    """A worker's compressors."""

    def __init__(self, model: Model):
        import zstandard

        self.model, self.each = model, []
        for content in model.contents:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=model.level)
            self.each.append(zstandard.ZstdCompressor(level=model.level, dict_data=own, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        span = self.model.span_bytes
        if len(text) <= span:
            return [len(f(text)) for f in self.each]
        parts = [text[k : k + span] for k in range(0, len(text), span)]
        return [sum(len(f(p)) for p in parts) for f in self.each]

    def __call__(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected."""
        import math

        own = normalise(text)
        if not own or not self.each:
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(own)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=None)
        margin = 1.0 if second is None else (second - sizes[best]) / second
        return self.model.languages[best], 1 - math.exp(-margin / SCALE) / 2, margin, margin < self.model.min_margin


OUT = "lang_pred string, score double, margin double, rejected boolean"


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``doc``, the row as a struct, and ``language``, a struct of the predicted language, score, margin and whether it is rejected."""

    own: list[Identifier] = []  # opened once in each worker

    @F.pandas_udf(OUT)
    def answer(batch):  # noqa: ANN001, ANN202
        import pandas as pd

        if not own:
            own.append(Identifier(model))
        return pd.DataFrame([own[0](t if t is not None else "") for t in batch], columns=["lang_pred", "score", "margin", "rejected"])

    return docs.select(F.struct("*").alias("doc"), answer(F.col(text_col).cast("string")).alias("language"))


def language_table(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, rejected`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(model)
        for batch in batches:
            for part in steps(batch, "text"):
                found = list(zip(*[identify(t) for t in texts(part)], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, " + OUT)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_table(docs, fit(docs))
