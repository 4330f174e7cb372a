"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

Each turn is written ``<|turn|>role`` newline ``text<|end|>`` newline. Inside roles and texts every backslash is
doubled, ``<|`` becomes ``<\\|`` and, in roles, a newline becomes ``<\\.``: a control string cannot occur in
them, and the way back is exact.

A conversation's turns are numbered and their token costs summed up in two levels (blocks of turn numbers, then inside a
block), so that one very long conversation does not meet in one task. A block of more than ``HOT`` turns, which have no number or share one, is divided
by role and by the beginning of the text. The running sums alone choose the windows:
with ``n`` tokens for new turns (the budget less the system turn and the history, a quarter of the
budget at least) turns are dealt by their end into cells of ``n / 2`` tokens; a turn longer than a cell is a window
of its own, the other turns of a cell are one. No window holds more than ``n`` new tokens unless a single turn does.

A window repeats the conversation's system turn and those turns before its first that end
within ``history`` tokens, as context. Each assistant text is under the loss mask once, where it is
new; repeated ones are masked.

Defined results: null roles and texts are empty; rows follow ``turn`` (null first), then role, then text, and repeated rows are
turns of their own; rows without a conversation id form one conversation; a conversation of a system turn alone is one window; an
empty table gives an empty result; texts of any length stay whole; further columns are ignored, whatever their names. Tokens are those of a column of counts
(``tokens``), or, without one, estimated as runs of ASCII letters, digits and underscores, and single other characters; plus 4 for each turn's marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import saved, table

TURN, END = "<|turn|>", "<|end|>\n"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"
MARKS = 4
BUDGET, HISTORY = 1024, 192
#: Turn numbers in a block of the two-level running sums.
BLOCK = 64
#: Turns of a block from which it is divided, and the characters of a text that divide it.
HOT, HOT_CHARS = 10_000, 4
SYSTEM, ASSISTANT = "system", "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\.")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    out = F.replace(out, F.lit("<\\."), F.lit("\n")) if role else out
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def numbered(turns: DataFrame, tokens: str | None = None, hot: int = HOT) -> DataFrame:
    """Turns with their conversation's key ``c``, number ``i``, cost, and the cost of all turns before."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    block = F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK).cast("long"), F.lit(-(2**62)))
    n_tokens = F.regexp_count(text, F.lit(TOKEN)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), block.alias("block"), role.alias("role"), text.alias("text"), (n_tokens + MARKS).cast("long").alias("cost"))
    by = ["c", "block"]
    large = rows.groupBy("c", "block").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("c", "block", F.lit(True).alias("large"))
    if large.limit(1).count():
        # one row for each ``hot`` turns at most; the order inside stays that of turn, role and text
        part = F.struct(F.col("turn").alias("t"), F.col("role").alias("r"), F.left("text", F.lit(HOT_CHARS)).alias("b"))
        rows = rows.join(large, by, "left").withColumn("part", F.when(F.col("large"), part)).drop("large")
        by.append("part")
    blocks = rows.groupBy(*by).agg(F.sum("cost").alias("block_cost"), F.count("*").alias("block_rows"))
    earlier = W.partitionBy("c").orderBy(*by[1:]).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*by, F.coalesce(F.sum("block_cost").over(earlier), F.lit(0)).alias("cost_0"), F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("row_0"))
    order = W.partitionBy(*by).orderBy(F.asc_nulls_first("turn"), "role", "text")
    inside = rows.withColumn("k", F.row_number().over(order)).withColumn("to", F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0)))
    told = blocks.select(*(F.col(c).alias(f"_{c}") for c in by), "cost_0", "row_0")
    met = inside.join(told, [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "part" else F.col(c) == F.col(f"_{c}") for c in by])
    return met.select("c", "conv_id", "role", "text", "cost", (F.col("row_0") + F.col("k") - 1).alias("i"), (F.col("cost_0") + F.col("to") - F.col("cost")).alias("before"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None, hot: int = HOT) -> DataFrame:
    """Windows of ``conv_id, turn, role, text`` rows; ``tokens`` names a column of token counts.

    Returns ``c, conv_id, window, text, loss, n_turns, n_context``: the formatted text, the spans ``(start, length)`` under the
    loss mask in characters, the number of turns, and how many of them, at the start, are repeated.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    rows = numbered(turns, tokens, hot).select("c", "cost", "i", "before", (F.col("role") == ASSISTANT).alias("target"), ((F.col("role") == SYSTEM) & (F.col("i") == 0)).alias("system"), head.alias("head"), body.alias("body"))
    rows, _ = saved(rows, "turns")
    # windows are chosen without the texts, which are joined on once
    plan = rows.select("c", "i", "cost", "before", "system")
    told = plan.where("system").select("c", F.col("cost").alias("system_cost"))
    new = plan.where(~F.col("system")).join(told, "c", "left").withColumn("system_cost", F.coalesce("system_cost", F.lit(0)))
    cell = F.floor(F.greatest(F.lit(budget - history) - F.col("system_cost"), F.lit(budget // 4)) / 2)
    new = new.withColumn("before", F.col("before") - F.col("system_cost"))
    new = new.withColumn("window", F.floor((F.col("before") + F.col("cost") - 1) / cell) * 2 + F.when(F.col("cost") > cell, 0).otherwise(1))
    starts = new.groupBy("c", "window").agg(F.min("before").alias("start"))
    parts = new.select("c", "window", "i", F.lit(False).alias("repeated"))
    if history > 0:
        # a window starts in the history cell of a turn before it, or in the next one
        cells = new.select("c", "i", "cost", "before", F.explode(F.array(F.floor(F.col("before") / history), F.floor(F.col("before") / history) + 1)).alias("at"))
        near = starts.withColumnRenamed("window", "later").withColumn("at", F.floor(F.col("start") / history))
        seen = cells.join(near, ["c", "at"]).where((F.col("before") + F.col("cost") <= F.col("start")) & (F.col("before") >= F.col("start") - history))
        parts = parts.unionByName(seen.select("c", F.col("later").alias("window"), "i", F.lit(True).alias("repeated")))
    alone = told.join(starts.select("c").distinct(), "c", "left_anti").select("c", F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("start"))
    first = starts.unionByName(alone).join(told, "c").select("c", "window", F.lit(0).cast("long").alias("i"), (F.col("start") > 0).alias("repeated"))
    parts = parts.unionByName(first).join(rows.select("c", "i", "target", "head", "body"), ["c", "i"])
    parts = parts.select("c", "window", F.struct("i", "repeated", "target", "head", "body").alias("part"))
    whole = parts.groupBy("c", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["head"])
        span = F.array(F.struct(at.alias("start"), F.length(x["body"]).alias("length")))
        return F.struct((at + F.length(x["body"]) + len(END)).alias("at"), F.when(x["target"] & ~x["repeated"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    context = F.size(F.filter("parts", lambda x: x["repeated"]))
    return whole.select("c", F.when(F.col("c") != "", F.col("c").cast("long")).alias("conv_id"), "window", text.alias("text"), F.aggregate("parts", empty, step)["spans"].alias("loss"), F.size("parts").alias("n_turns"), context.alias("n_context"))


def read_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, the roles and texts of each window's new turns, and ``targets``, the texts under its loss mask."""
    blocks = F.split("text", F.lit(END.replace("|", r"\|")), -1)
    own = F.slice(blocks, F.col("n_context") + 1, F.size(blocks) - 1 - F.col("n_context"))
    opened = F.transform(own, lambda x: F.substring(x, len(TURN) + 1, 2**31 - 1))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape(role, role=True).alias("role"), unescape(F.substr(x, F.length(role) + 2)).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("*", F.transform(opened, turn).alias("turns"), targets.alias("targets"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_turns(windows).select("c", "conv_id", "window", F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"), said.alias("said"), F.array_join("targets", "").alias("target"))
    whole = read.groupBy("c", "conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("w"))
    said, target = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.target"), "")
    return whole.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations", dealt=False).select("conv_id", "turn", "role", "text").unionByName(more)
    return conversation_digests(chat_windows(turns))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
costed AS (
  SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]')) + 4 AS cost,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\.')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 17 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM rows),
sys AS (SELECT conv_id, cost AS system_cost, chars AS system_chars FROM costed WHERE i = 0 AND role = 'system'),
body AS (
  SELECT c.conv_id, c.cost, c.chars, c.i, coalesce(s.system_cost, 0) AS system_cost,
    sum(c.cost) OVER (PARTITION BY c.conv_id ORDER BY c.i) - c.cost AS before
  FROM costed c LEFT JOIN sys s USING (conv_id) WHERE NOT (c.i = 0 AND c.role = 'system')),
celled AS (SELECT *, greatest(832 - system_cost, 256) // 2 AS cell FROM body),
dealt AS (SELECT *, CAST((before + cost - 1) // cell AS BIGINT) * 2 + CASE WHEN cost > cell THEN 0 ELSE 1 END AS win FROM celled),
starts AS (SELECT conv_id, win, min(before) AS start FROM dealt GROUP BY ALL),
parts AS (
  SELECT conv_id, chars FROM dealt
  UNION ALL SELECT d.conv_id, d.chars FROM dealt d JOIN starts s ON d.conv_id = s.conv_id AND d.before + d.cost <= s.start AND d.before >= s.start - 192
  UNION ALL SELECT s.conv_id, s.system_chars FROM sys s JOIN (SELECT conv_id, win FROM starts UNION ALL SELECT conv_id, 0 FROM sys WHERE conv_id NOT IN (SELECT conv_id FROM starts)) w ON s.conv_id = w.conv_id),
sized AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM parts GROUP BY conv_id),
digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
  FROM costed GROUP BY conv_id)
SELECT * FROM digests JOIN sized USING (conv_id)
"""
