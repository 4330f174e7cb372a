"""Conversation repair: the cheapest edits after which a conversation follows a grammar of roles.

A conversation's roles are to read ``(s?(ua)+)?`` by their initials. Its turns are kept (0), given the role user or assistant (1) or
deleted (2; blank and repeated turns must be), empty turns of user or assistant are inserted (5), and a turn that ends in mid-sentence costs 5 if
it stays. Among the cheapest ways the one of least audit counts: the edits' initials (K, R, D, I) in order.

1. Turns are dealt out by the hash of their conversation and sorted by turn, in ranges, so that a very long conversation goes on in the next
   range. Each range numbers the turns of each conversation in it and cuts them into segments of ``SEGMENT`` turns.
2. Segments are dealt out by hash. A batch of them is one recursive query of DuckDB: each recursion advances one turn for all segments of the batch, and
   keeps the least (cost, audit) for each pair of grammar states, that before the segment and that after the turn.
3. Segments of one conversation are steps themselves: the same query advances over ``SEGMENT`` of them at a time, until each conversation has one.
   (Costs add up and audits are strung together; of two audits of one cost over the same turns none begins the other, so the least of the
   whole is made of the least of its parts.)
4. The turns of a conversation, in order, meet its audit, and leave as repaired turns. One task holds one turn and one audit at a time.

Turns that repeat role and text of an earlier one are told by a count of digests of conversation, role and text, not by a comparison of turns.

Defined results: nulls are one space in roles and texts; rows without a conversation id form one conversation; rows follow ``turn`` (null first), then
the SHA-256 of conversation, role and text, and repeated rows are turns of their own; texts of any length are taken whole; an empty
table gives an empty result; further columns are ignored, whatever their names. A role is its initial, case and all: any other than s, u and a is never legal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import saved, table

#: Turns (or segments) that one segment holds at most.
SEGMENT = 64
#: Rows that one DuckDB query gets.
BATCH = 20_000
#: What does not count as text, and what ends a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

#: Grammar states: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that may follow each state.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Classes of turns: initial of the role (o: any other), and . (as it is), x (must go), t (in mid-sentence).
_LETTERS, _FAULTS = "suao", ".xt"
_PIECES = "seg int, i int, origin int, target int, cost long, audit string"
_PATHS = "conv_id long, part int, seg long, origin int, target int, cost long, audit string"
_ROWS = "conv_id long, turn long, role string, text string, digest binary, blank boolean, cut boolean, part int, at long"
_REPAIRED = "conv_id long, place long, edit string, role string, text string, report struct<gaps:long,illegal:long,cost:long,audit:string,blank:long,duplicate:long,truncated:long>"


def _legal(letter: str, state: int) -> int | None:
    """The state after a kept turn, if it may stand there."""
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    return _NEXT[state] if letter == {USER: "u", ASSISTANT: "a"}[_NEXT[state]] else None


def _with_inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """States that up to two inserted turns lead to; more than two come back to where two or none do."""
    for n in range(3):
        yield state, n * INSERT, "I" * n
        state = _NEXT[state]


@cache
def turn_steps() -> pa.Table:
    """``kind, origin, target, cost, audit``: the cheapest ways over one turn of each class."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for k, (letter, fault) in enumerate((x, f) for x in _LETTERS for f in _FAULTS):
        for origin in range(4):
            for state, cost, audit in _with_inserts(origin):
                ways = [(state, DELETE, "D")]
                if fault != "x":
                    stays = CUT if fault == "t" else 0
                    ways.append((_NEXT[state], REROLE + stays, "R"))
                    if (kept := _legal(letter, state)) is not None:
                        ways.append((kept, KEEP + stays, "K"))
                for target, more, edit in ways:
                    way = (cost + more, audit + edit)
                    best[k, origin, target] = min(way, best.get((k, origin, target), way))
    rows = [(*key, *way) for key, way in sorted(best.items())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["kind", "origin", "target", "cost", "audit"])


def end_of(state: int) -> tuple[int, str]:
    """The cheapest end of a conversation in a state."""
    return min((cost, edits) for target, cost, edits in _with_inserts(state) if target in (NOTHING, ASSISTANT))


_WALK = """
WITH RECURSIVE walk(seg, origin, state, i, best) USING KEY (seg, origin, state) AS (
    SELECT DISTINCT seg, s.origin, s.origin, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM {pieces}, (SELECT unnest(range(4))::INTEGER AS origin) s
  UNION
    SELECT w.seg, w.origin, p.target, w.i + 1, min({{'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.audit}})
    FROM walk w JOIN {pieces} p ON p.seg = w.seg AND p.i = w.i AND p.origin = w.state GROUP BY ALL
)
SELECT w.seg, w.origin, w.state AS target, w.best.cost AS cost, w.best.audit AS audit
FROM walk w JOIN (SELECT seg, max(i) + 1 AS n FROM {pieces} GROUP BY seg) z ON z.seg = w.seg AND w.i = z.n
"""


def _connection():  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.register("steps", turn_steps())
    con.execute("CREATE TABLE turn_steps AS SELECT * FROM steps")
    return con


def _batches(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where a group of ``keys`` ends, and each row's group number in its table."""
    held: list[pa.RecordBatch] = []
    n = 0

    def numbers(whole: pa.Table) -> np.ndarray:
        new = np.zeros(len(whole), bool)
        for k in keys:
            c = whole.column(k).combine_chunks()
            missing, values = c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)
            new[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
        return np.cumsum(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held)
            seg = numbers(whole)
            if cut := int(np.searchsorted(seg, seg[-1])):
                yield whole.slice(0, cut), seg[:cut]
                held, n = whole.slice(cut).to_batches(), n - cut
    if n:
        whole = pa.Table.from_batches(held)
        yield whole, numbers(whole)


def _walked(con, whole: pa.Table, seg: np.ndarray, pieces: pa.Table, of_kinds: bool) -> pa.RecordBatch:  # noqa: ANN001
    """One recursive query; ``conv_id, part, seg`` of a segment are those of its first row."""
    con.register("given", pieces)
    con.execute(f"CREATE OR REPLACE TABLE pieces AS SELECT seg, i, {'s.origin, s.target, s.cost, s.audit FROM given JOIN turn_steps s USING (kind)' if of_kinds else 'origin, target, cost, audit FROM given'}")
    found = con.sql(_WALK.format(pieces="pieces")).to_arrow_table()
    con.unregister("given")
    first = pa.array(np.searchsorted(seg, found.column("seg").to_numpy()))
    out = [whole.column(c).take(first) for c in ("conv_id", "part", "seg")] + [found.column(c).cast(t) for c, t in (("origin", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()))]
    return pa.table(out, [x.split()[0] for x in _PATHS.split(", ")]).combine_chunks().to_batches()[0]


def _initial(role: Column) -> Column:
    return F.left(role, F.lit(1))


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with digest and faults of their own, in ranges of conversations; ``part`` and ``at`` tell range and place in the conversation's run there."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim("text", F.lit(SPACE))
    rows = turns.select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("*", F.unhex(F.sha2(key.cast("binary"), 256)).alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    # equal rows are told apart only to let a range end among them
    order = [F.xxhash64("conv_id"), F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            at = []
            for conv in batch.column("conv_id").to_pylist():
                n = n + 1 if (conv,) == last else 0
                last = (conv,)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at, pa.int64())], [*batch.schema.names, "part", "at"])

    return dealt.mapInArrow(run, _ROWS)


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, part, at, letter, blank, duplicate, truncated`` of each turn; the first fault counts."""
    place = F.struct("part", "at")
    repeated = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    own = rows.select("conv_id", "part", "at", "digest", "blank", "cut", _initial(F.col("role")).alias("letter"))
    duplicate = ~F.col("blank") & F.coalesce(place > F.col("first"), F.lit(False))
    met = own.join(repeated, "digest", "left").withColumn("duplicate", duplicate)
    return met.select("conv_id", "part", "at", "letter", "blank", "duplicate", (F.col("cut") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"))


def segment_paths(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The cheapest paths over each segment of turns, from each grammar state to each."""
    letter = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in _LETTERS)), F.col("letter")), F.lit(0))
    number = F.when(letter == 0, len(_LETTERS) - 1).otherwise(letter - 1)
    fault = F.when(F.col("blank") | F.col("duplicate"), 1).when(F.col("truncated"), 2).otherwise(0)
    rows = faults.select("conv_id", "part", F.floor(F.col("at") / segment).cast("long").alias("seg"), (F.col("at") % segment).cast("int").alias("i"), (number * len(_FAULTS) + fault).cast("int").alias("kind"))
    keys = ["conv_id", "part", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for whole, seg in _batches(batches, keys, BATCH):
            yield _walked(con, whole, seg, pa.table([pa.array(seg, pa.int32()), whole.column("i"), whole.column("kind")], ["seg", "i", "kind"]), True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "i").mapInArrow(run, _PATHS)


def joined_paths(paths: DataFrame, segment: int, across: bool) -> DataFrame:
    """Paths over up to ``segment`` segments that follow one another: of one range, or across ranges whose conversations' runs are one segment each."""
    order = F.col("part") if across else F.col("seg")
    group = F.floor(order / segment).cast("long")
    rows = paths.select("conv_id", (group.cast("int") if across else F.col("part")).alias("part"), (F.lit(0).cast("long") if across else group).alias("seg"), order.cast("long").alias("place"), "origin", "target", "cost", "audit")
    keys = ["conv_id", "part", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for whole, seg in _batches(batches, keys, BATCH):
            place = whole.column("place").to_numpy()
            new = np.ones(len(seg), np.int64)
            new[1:] = (np.diff(seg) != 0) | (np.diff(place) != 0)
            i = np.cumsum(new)
            i -= i[np.searchsorted(seg, seg)]
            yield _walked(con, whole, seg, pa.table([pa.array(seg, pa.int32()), pa.array(i, pa.int32()), *(whole.column(c) for c in ("origin", "target", "cost", "audit"))], ["seg", "i", "origin", "target", "cost", "audit"]), False)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(run, _PATHS)


def cheapest(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, cost, audit`` of each conversation that has turns."""
    done = None
    todo, _ = saved(segment_paths(faults, segment), "paths")
    while True:
        # a segment has one path at least for each origin; conversations with one segment are ready
        spans = todo.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("seg").alias("a"), F.max("seg").alias("z"))
        spans, _ = saved(spans.select(F.col("conv_id").alias("c"), (F.col("a") != F.col("z")).alias("long"), (F.col("lo") != F.col("hi")).alias("across")).where("long or across"), "spans")
        state = spans.agg(F.count("*").alias("n"), F.max("long").alias("long")).first()
        ready = todo.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti") if state["n"] else todo
        done = ready if done is None else done.unionByName(ready)
        if not state["n"]:
            break
        todo, _ = saved(joined_paths(todo.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), segment, not state["long"]), "paths")

    more, edits = F.lit(0), F.lit("")
    for state in range(4):
        n, said = end_of(state)
        more, edits = F.when(F.col("target") == state, n).otherwise(more), F.when(F.col("target") == state, F.lit(said)).otherwise(edits)
    best = done.where(F.col("origin") == NOTHING).groupBy("conv_id").agg(F.min(F.struct((F.col("cost") + more).alias("cost"), F.concat("audit", edits).alias("audit"))).alias("best"))
    return best.select("conv_id", "best.cost", "best.audit")


def _applied(conversations: DataFrame, rows: DataFrame, faults: DataFrame, best: DataFrame) -> DataFrame:
    """The repaired turns, each conversation's in order and in one task, and after them a row with its ``report``."""
    counts = faults.groupBy("conv_id").agg(*(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    of = lambda name, kind, value=None: F.lit(value).cast(kind).alias(name)
    no_turn, no_head = [of(*x.split()) for x in ("part int", "at long", "turn long", "role string", "text string")], of("told", "struct<cost:long,audit:string,blank:long,duplicate:long,truncated:long>")
    heads = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", of("kind", "int", 0), *no_turn, no_head)
    told = best.join(counts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    told = told.select("conv_id", of("kind", "int", 1), *no_turn, F.struct("cost", "audit", "blank", "duplicate", "truncated").alias("told"))
    turns = rows.select("conv_id", of("kind", "int", 2), "part", "at", "turn", "role", "text", no_head)
    dealt = heads.unionByName(told).unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own = None
        for batch in batches:
            for r in batch.to_pylist():
                if not r["kind"]:
                    if own:
                        out += own.ended()
                    own = _Replay(r["conv_id"])
                elif r["kind"] == 1:
                    own.told = r["told"]
                else:
                    out += own.turn(r)
            yield _batch(out)
            out = []
        if own:
            yield _batch(own.ended())

    return dealt.mapInArrow(run, _REPAIRED)


_REPORT = pa.struct([(c, pa.string() if c == "audit" else pa.int64()) for c in ("gaps", "illegal", "cost", "audit", "blank", "duplicate", "truncated")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), _REPORT)
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _REPAIRED.split(", ", 5)])


class _Replay:
    """One conversation's turns in order, and what its audit makes of them."""

    def __init__(self, conv: int | None):
        self.conv, self.told = conv, {"cost": 0, "audit": "", "blank": 0, "duplicate": 0, "truncated": 0}
        self.state, self.at, self.place = NOTHING, 0, 0
        self.least = self.most = self.before = None
        self.distinct = self.illegal = self.turns = 0

    def _left(self, edit: str, role: str | None, text: str) -> tuple:
        if role is None:
            self.state = _NEXT[self.state]
            role = {USER: "user", ASSISTANT: "assistant"}[self.state]
        else:
            self.state = _legal(role[:1], self.state)
        self.place += 1
        return (self.conv, self.place - 1, edit, role, text, None)

    def _inserted(self) -> list[tuple]:
        out, audit = [], self.told["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            out.append(self._left("I", None, ""))
            self.at += 1
        return out

    def turn(self, r: dict) -> list[tuple]:
        if r["turn"] is not None:
            self.least = r["turn"] if self.least is None else self.least
            self.distinct += self.most is None or r["turn"] != self.most
            self.most = r["turn"]
        self.illegal += self.turns > 0 and self.before + r["role"][:1] not in ("su", "ua", "au")
        self.before, self.turns = r["role"][:1], self.turns + 1
        out = self._inserted()
        edit = self.told["audit"][self.at]
        self.at += 1
        return out if edit == "D" else [*out, self._left(edit, r["role"] if edit == "K" else None, r["text"])]

    def ended(self) -> list[tuple]:
        """The turns inserted last, and the report."""
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return [*self._inserted(), (self.conv, None, None, None, None, {"gaps": gaps, "illegal": self.illegal} | self.told)]


def applied(conversations: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repaired turns of ``turns`` and reports of all ``conversations``; see ``_applied``."""
    rows, _ = saved(ordered(turns), "turns")
    faults, _ = saved(with_faults(rows), "faults")
    return _applied(conversations, rows, faults, cheapest(faults, segment))


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """``conv_id, place, edit, role, text`` of the repaired conversations, and a report of each: ``conv_id``, counts of faults, ``cost, audit``."""
    out, _ = saved(applied(conversations, conversations, segment), "repaired")
    return out.where("report is null").drop("report"), out.where("report is not null").select("conv_id", "report.*")


# ---- the query ----


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in, by the CRC-32 of conversation and turn."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    told = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(told.cast("binary")) % 20).alias("r")).where("r <> 0")
    copies = F.when(F.col("r") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``applied``, with the SHA-256 of its repaired turns; these are hashed as they come, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = hashlib.sha256(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["report"] is None:
                    own.update(f"{chr(10) * (n > 0)}{r['role']}:{r['text']}".encode())
                    n += 1
                else:
                    out.append((r["conv_id"], *r["report"].values(), own.hexdigest()))
                    own, n = hashlib.sha256(), 0
            columns = zip(*out, strict=True) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 3 + [pa.string()], strict=True)], ["conv_id", "gaps", "illegal", "cost", "audit", "blank", "duplicate", "truncated", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, gaps long, illegal long, cost long, audit string, blank long, duplicate long, truncated long, repaired_sha256 string")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations, after damage."""
    rows = table(spark, sf_dir, "conversations", dealt=False)
    return digests(applied(rows, damaged(rows)))


_BYTES = "list_transform(range(1, length(k) + 1), lambda i: ascii(k[i]))"
_STRIPPED = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP11_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (SELECT conv_id, turn, role, text, xor(list_reduce({_BYTES}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 20 AS r FROM given, crc_table),
hurt AS (SELECT conv_id, turn, CASE r WHEN 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE r WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE r <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || length(role) || ':' || role || text), copy) - 1 AS i, {_STRIPPED} AS bare, left(role, 1) AS letter FROM hurt),
told AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
moves(state, letter, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
forward(state, target, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts(state, target, cost, audit, said) AS (SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) v(s) UNION ALL SELECT state, target, 5, 'I', [role || ':'] FROM forward
    UNION ALL SELECT a.state, b.target, 10, 'II', [a.role || ':', b.role || ':'] FROM forward a JOIN forward b ON b.state = a.target),
edits AS (SELECT t.conv_id, t.i, s.state, s.state AS target, 2 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS said FROM told t, (VALUES (0), (1), (2), (3)) s(state)
    UNION ALL SELECT t.conv_id, t.i, m.state, m.target, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [t.role || ':' || t.text] FROM told t JOIN moves m ON m.letter = t.letter WHERE fault NOT IN ('b', 'd')
    UNION ALL SELECT t.conv_id, t.i, f.state, f.target, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [f.role || ':' || t.text] FROM told t, forward f WHERE fault NOT IN ('b', 'd')),
walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS best FROM counts
  UNION ALL
    SELECT w.conv_id, w.i + 1, e.target, min({{'cost': w.best.cost + n.cost + e.cost, 'audit': w.best.audit || n.audit || e.audit, 'said': w.best.said || n.said || e.said}})
    FROM walk w JOIN inserts n ON n.state = w.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i AND e.state = n.target GROUP BY ALL),
ends AS (SELECT w.conv_id, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.audit, 'said': w.best.said || n.said}}) AS best
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.state = w.state WHERE n.target IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
    coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
