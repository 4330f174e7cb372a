"""Self-join of documents on the Jaccard similarity of their word shingles, by chosen paths.

1. Documents become sets of five-word shingles. Equal sets collapse to one node with a multiplicity, so copies
   never pair up; each node has ``COORDINATES`` MinHash values.
2. In every run a node walks down a tree: a tree node samples coordinates (by a hash of its path, the same for
   all sets there), and sets go on to the child named by their MinHash value there. Sets that are alone leave. Paths
   with at most ``LEAF`` sets are compared by brute force on 64-byte sketches; larger ones are split again. Runs
   are repeated as often as the target recall needs for a pair at the threshold.
   What is still large at ``DEPTH`` is compared with one of its sets, block by block; only sets unlike it go on to all blocks.
3. Candidate links form components. Inside a component all pairs are settled exactly, on the shingles, in blocks of bounded size, so a
   group of near copies gets every link. In a component of several blocks, sets are first compared with one of them, the pivot, and
   put into blocks in the order of their distance from it. Jaccard distance is a metric: blocks near enough to the pivot link as wholes, blocks
   whose distances differ by too much do not link at all, and only the other pairs of blocks are compared set by set. Only
   counts of links and a spanning forest leave a task.
4. Components of the verified links are the classes.

Defined results: a document without words (null, empty, signs only) has no links and is a class of its own; texts of any length are taken whole; a document of one
to four words is one shingle of all its words; repeated rows are copies of each other; a class is named
after its least id (null if no document of it has one); an empty table gives an empty result; further columns are ignored by ``near_classes`` and
carried along by ``drop_near_copies``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _words
from ._arrow import groups, steps, texts
from ._store import forget, saved, table
from .graphs import components
from .mph import mix

THRESHOLD = 0.8
TARGET_RECALL = 0.995
COORDINATES = 64
LEAF = 2048
DEPTH = 6
#: Coordinates that a tree's root samples, and on average a node further down.
ROOT_BRANCHES, BRANCHES = 2, 1.5
#: Keys, of 8 bytes each, that are broadcast at most.
PICKED = 2_000_000
#: Sketch bytes that may differ beyond what the threshold expects.
SLACK = 0.2
#: Sets and shingles of a small component, and about those of a block of a large one.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000


def runs_for(target: float, threshold: float, depth: int = DEPTH, root: int = ROOT_BRANCHES, branches: float = BRANCHES) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``target``."""
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - math.exp(-branches * threshold * alive)
    once = 1 - (1 - threshold * alive) ** root
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - once)))


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit MinHash values of consecutive non-empty sets that begin at ``starts``."""
    out = np.empty((len(starts), COORDINATES), "<u4")
    for k, factor in enumerate(_multipliers()):
        out[:, k] = mix(np.minimum.reduceat(hashes * factor, starts)) >> np.uint64(32)
    return out


def _keys(text_col: str, id_col: str) -> list:
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return [own.alias("doc_id"), F.xxhash64(own, text, F.lit(3)).alias("r1"), F.xxhash64(F.lit(4), text, own).alias("r2"), text.alias("text")]


def shingle_sets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, r1, r2, digest, n, mins``; digest and mins are null for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                own = _words.shingles(_words.split(texts(part)))
                size = np.bincount(own.doc, minlength=part.num_rows) if len(own.doc) else np.zeros(part.num_rows, np.int64)
                starts = np.cumsum(size) - size
                full = np.flatnonzero(size)
                mins = minhashes(own.hash, starts[full]) if len(full) else np.zeros((0, COORDINATES), "<u4")
                digests: list = [None] * part.num_rows
                packed: list = [None] * part.num_rows
                n = np.zeros(part.num_rows, np.int64)
                for k, d in enumerate(full.tolist()):
                    distinct = np.unique(own.hash[starts[d] : starts[d] + size[d]])
                    digests[d], packed[d], n[d] = xxhash.xxh3_128_digest(distinct.tobytes()), mins[k].tobytes(), len(distinct)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("r1"), part.column("r2"), pa.array(digests, pa.binary()), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "r1", "r2", "digest", "n", "mins"])

    return docs.select(*_keys(text_col, id_col)).mapInArrow(run, "doc_id long, r1 long, r2 long, digest binary, n long, mins binary")


def _mins(column: pa.BinaryArray) -> np.ndarray:
    """The MinHash values of a column without nulls, in place."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(-1, COORDINATES)


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path ^ mix(coordinate.astype(np.uint64) << np.uint64(32) ^ value.astype(np.uint64)))


def first_paths(nodes: DataFrame, runs: int) -> DataFrame:
    """``path, node`` below the roots of all runs."""
    chosen = np.random.default_rng(20).permuted(np.tile(np.arange(COORDINATES), (runs, 1)), axis=1)[:, :ROOT_BRANCHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mins, node = _mins(batch.column("mins")), batch.column("node").to_numpy()
                for k in range(runs):
                    root = np.full(len(node), mix(np.array([k + 1], np.uint64))[0])
                    for c in chosen[k]:
                        path = _child(root, np.full(len(node), c), mins[:, c])
                        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node)], ["path", "node"])

    return nodes.select("node", "mins").mapInArrow(run, "path long, node long")


def next_paths(large: DataFrame) -> DataFrame:
    """The children of ``path, node, mins``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))
        limit = np.uint64(int(BRANCHES / COORDINATES * 2**64))
        for batch in batches:
            if batch.num_rows:
                mins, node, path = _mins(batch.column("mins")), batch.column("node").to_numpy(), batch.column("path").to_numpy().view(np.uint64)
                row, c = np.nonzero(mix(path[:, None] ^ salt[None, :]) < limit)
                yield pa.RecordBatch.from_arrays([pa.array(_child(path[row], c, mins[row, c]).view(np.int64)), pa.array(node[row])], ["path", "node"])

    return large.select("path", "node", "mins").mapInArrow(run, "path long, node long")


def split_paths(rows: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """``path, node`` of stored paths that two to ``leaf`` nodes share, and ``path, node, n`` of larger ones (None if there are none).

    Only the former gather in a task. The latter are told by their paths, of which there are at most one for each ``leaf`` rows.
    """
    all_ = rows.count()
    large, _ = saved(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > leaf), "large-paths", all_ // leaf)
    n, small, more = large.count(), rows, None
    if n:
        told = F.broadcast(large) if n <= PICKED else large
        small, more = rows.join(told, "path", "left_anti"), saved(rows.join(told, "path"), "large-rows", all_)[0]
    met = small.groupBy("path").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    return saved(met.select("path", F.explode("nodes").alias("node")), "shared-paths", all_)[0], more


def forest(marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows that agree in ``least`` bytes or more; each row is compared once with those not reached yet."""
    out, todo = [], np.arange(len(marks))
    while len(todo):
        stack, todo = [int(todo[0])], todo[1:]
        while stack and len(todo):
            j = stack.pop()
            near = (marks[todo] == marks[j]).sum(1) >= least
            new, todo = todo[near].tolist(), todo[~near]
            out += [(j, k) for k in new]
            stack += new
    return out


def candidate_links(leaves: DataFrame, least: int) -> DataFrame:
    """``a, b``: a spanning forest of each leaf's nodes whose sketches agree in ``least`` bytes. ``leaves``: ``path, node, mins``."""
    sketch = F.struct("node", "mins")
    buckets = leaves.groupBy("path").agg(F.collect_list(sketch).alias("rows"))

    def links_of(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        node, mins = rows.flatten().flatten()
        node, marks = node.to_numpy(), _mins(mins).astype(np.uint8)
        size = rows.value_lengths().to_numpy()
        start = np.cumsum(size) - size
        two = start[size == 2]
        hit = two[(marks[two] == marks[two + 1]).sum(1) >= least]
        a, b = [node[hit]], [node[hit + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = np.array(forest(marks[s : s + n], least), np.int64).reshape(-1, 2) + s
            a.append(node[found[:, 0]])
            b.append(node[found[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("rows").value_lengths().to_numpy()
            ends, at = np.cumsum(size), 0
            while at < len(size):  # some thousand sets at once
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * LEAF, side="right")))
                a, b = links_of(batch.column("rows").slice(at, stop - at))
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.select("rows").mapInArrow(run, "a long, b long").distinct()


def pivot_links(large: DataFrame, mins: DataFrame, leaf: int, least: int) -> DataFrame:
    """``a, b``: links that connect what a spanning forest of each large path would. ``large``: ``path, node, n``."""
    blocks = F.ceil(F.col("n") / (leaf // 2)).cast("int")
    own = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "path"), F.col("blocks")).cast("int")).join(mins, "node")
    pivots = large.groupBy("path").agg(F.min("node").alias("pivot"), F.first("n").alias("n")).withColumnRenamed("pivot", "node").join(mins, "node")
    pivots = pivots.select("path", F.col("node").alias("pivot"), F.col("mins").alias("pivot_mins"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_mins(batch.column("mins")).astype(np.uint8) == _mins(batch.column("pivot_mins")).astype(np.uint8)).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "node", "blocks", "block", "mins", "pivot")), pa.array(agree >= least)], ["path", "node", "blocks", "block", "mins", "pivot", "near"])

    marked, _ = saved(own.join(pivots, "path").mapInArrow(compare, "path long, node long, blocks int, block int, mins binary, pivot long, near boolean"), "pivots")
    # those unlike the pivot meet all blocks; those like it are one component already
    moved = marked.where(~F.col("near")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = F.struct("near", "node", "mins")
    met = marked.where("near").select("path", "block", rows.alias("row")).unionByName(moved.select("path", "block", rows.alias("row")))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                near, node, mins = rows.values.flatten()
                near, node, marks = near.to_numpy(zero_copy_only=False), node.to_numpy(), _mins(mins).astype(np.uint8)
                known, out = np.flatnonzero(near), []
                others = np.flatnonzero(~near)
                for i in others.tolist():
                    hit = np.flatnonzero((marks[known] == marks[i]).sum(1) >= least)[:1]
                    out += [(node[i], node[known[k]]) for k in hit.tolist()]
                out += [(node[others[i]], node[others[j]]) for i, j in forest(marks[others], least)]
                pair = np.array(out, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    found = met.groupBy("path", "block").agg(F.collect_list("row").alias("rows")).select("rows").mapInArrow(links, "a long, b long")
    return marked.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(found).where("a <> b").distinct()


def chosen_path_links(nodes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Candidate links between stored ``node, mins``."""
    mins, least = nodes.select("node", "mins"), int((threshold - SLACK) * COORDINATES)
    rows, leaves = first_paths(nodes, runs_for(target, threshold)), None
    for level in range(depth):
        rows, path = saved(rows, "paths")
        ended, large = split_paths(rows, leaf)
        forget(nodes.sparkSession, path)
        leaves = ended if leaves is None else leaves.unionByName(ended)
        if large is None:
            break
        if level + 1 < depth:
            rows = next_paths(large.join(mins, "node"))
        else:
            found = pivot_links(large, mins, leaf, least)
            return candidate_links(leaves.join(mins, "node"), least).unionByName(found)
    return candidate_links(leaves.join(mins, "node"), least)


def exact_links(sets: list[np.ndarray], threshold: float, split: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later sets at the threshold or above; with ``split``, only pairs across it count."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(distinct), np.int64)
    for i in range(len(sets) - 1 if split is None else split):
        first = i + 1 if split is None else split
        own = ids[start[i] : start[i] + size[i]]
        flag[own] = 1
        both = np.add.reduceat(flag[ids[start[first] :]], start[first:] - start[first])
        flag[own] = 0
        all_ = size[i] + size[first:] - both
        yield i, first + np.flatnonzero(both >= threshold * all_ - 1e-9)


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """``members``: ``root, i, j, block, node, mult, text``, the blocks i and j of a component together.

    Returns rows ``node, links, other``: counts of links of a node (other null), and a spanning forest (links null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["root", "i", "j"]):
            node, block, mult = (group.column(c).to_numpy() for c in ("node", "block", "mult"))
            _, first = np.unique(node, return_index=True)  # a row that was given twice comes twice
            first = first[np.argsort(block[first], kind="stable")]
            node, block, mult = node[first], block[first], mult[first]
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            cut = int(np.searchsorted(block, block[-1])) if across else None
            if len(node) < 2 or (across and not cut):
                continue
            rows = group.column("text").take(pa.array(first)).to_pylist()
            own = _words.shingles(_words.split(rows))
            order = np.searchsorted(own.doc, np.arange(len(rows) + 1))
            sets = [np.unique(own.hash[order[k] : order[k + 1]]) for k in range(len(rows))]
            links = np.zeros(len(node), np.int64)
            root = np.arange(len(node))
            edges = []
            for k, found in exact_links(sets, threshold, cut):
                links[k] += mult[found].sum()
                links[found] += mult[k]
                for f in found.tolist():
                    a, b = k, f
                    while root[a] != a:
                        root[a] = root[root[a]]
                        a = root[a]
                    while root[b] != b:
                        root[b] = root[root[b]]
                        b = root[b]
                    if a != b:
                        root[a] = b
                        edges.append((k, f))
            e = np.array(edges, np.int64).reshape(-1, 2)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[hit], node[e[:, 0]]])), pa.array([*links[hit].tolist(), *[None] * len(e)], pa.int64()), pa.array([*[None] * len(hit), *node[e[:, 1]].tolist()], pa.int64())], ["node", "links", "other"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(run, "node long, links long, other long")


def texts_of(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``r1, r2, text`` of the members among ``rows``, one row for each; other texts are not dealt out, but for more than ``PICKED`` members."""
    keys = members.select("r1").distinct()
    if members.count() <= PICKED:
        rows = rows.join(F.broadcast(keys), "r1", "left_semi")
    else:
        rows = rows.join(keys, "r1", "left_semi")
    return saved(rows.dropDuplicates(["r1", "r2"]), "member-texts")[0]


def pivot_distances(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``root, node, mult, r1, r2, pivot, n, d``: sizes and Jaccard distances of ``members`` from their component's pivot, the set with most copies."""
    pivots = members.groupBy("root").agg(F.min_by(F.struct("node", "r1", "r2"), F.struct(-F.col("mult"), "node")).alias("p"))
    pivots = pivots.select("root", "p.*").join(rows, ["r1", "r2"]).select("root", F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    rows = members.join(rows, ["r1", "r2"]).join(pivots, "root").select("root", "node", "mult", "r1", "r2", "pivot", "pivot_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                own = _words.shingles(_words.split(texts(part)))
                order = np.searchsorted(own.doc, np.arange(part.num_rows + 1))
                d, n = np.ones(part.num_rows), np.zeros(part.num_rows, np.int64)
                for k, pivot in enumerate(part.column("pivot").to_pylist()):
                    if pivot not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[pivot] = np.unique(_words.shingles(_words.split([part.column("pivot_text")[k].as_py()])).hash)
                    mine = np.unique(own.hash[order[k] : order[k + 1]])
                    both = len(np.intersect1d(mine, known[pivot], assume_unique=True))
                    d[k], n[k] = 1 - both / (len(mine) + len(known[pivot]) - both), len(mine)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "node", "mult", "r1", "r2", "pivot")), pa.array(n), pa.array(d)], ["root", "node", "mult", "r1", "r2", "pivot", "n", "d"])

    return rows.mapInArrow(run, "root long, node long, mult long, r1 long, r2 long, pivot long, n long, d double")


#: Steps of distance by which sets are put into blocks.
_BINS = 256


def blocks_by_distance(distances: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with their ``block``; the pairs of blocks ``root, i, j`` to compare; and counts of links between blocks that link as wholes."""
    binned = distances.withColumn("bin", F.floor(F.col("d") * _BINS).cast("int"))
    size = F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)  # in blocks
    sized = binned.groupBy("root", "bin").agg(size.alias("size"))  # at most _BINS + 1 rows for a component
    before = W.partitionBy("root").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.select("root", "bin", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0.0))).alias("g"), F.ceil("size").alias("subs"))
    own = binned.join(sized, ["root", "bin"]).withColumn("block", (F.col("g") * 2**20 + F.pmod(F.xxhash64("node"), F.col("subs"))).cast("long")).drop("bin", "g", "subs", "n")
    own, _ = saved(own, "blocks", distances.count())
    stats = own.groupBy("root", "block").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("mult").alias("sets"))
    a, b = (stats.select("root", *(F.col(c).alias(c + x) for c in ("block", "low", "high", "sets"))) for x in ("_a", "_b"))
    pairs = a.join(b, "root")  # of blocks, a few for each thousand sets
    whole = F.col("high_a") + F.col("high_b") <= 1 - threshold - 1e-9
    apart = F.greatest(F.col("low_a") - F.col("high_b"), F.col("low_b") - F.col("high_a")) > 1 - threshold + 1e-9
    linked = pairs.where(whole).groupBy("root", F.col("block_a").alias("block")).agg(F.sum("sets_b").alias("linked"), F.max((F.col("block_a") == F.col("block_b")).cast("int")).alias("itself"))
    linked = own.join(linked, ["root", "block"]).select("node", (F.col("linked") - F.col("itself") * F.col("mult")).alias("links"), F.lit(None).cast("long").alias("other"))
    todo = pairs.where(~whole & ~apart & (F.col("block_a") <= F.col("block_b"))).select("root", F.col("block_a").alias("i"), F.col("block_b").alias("j"))
    return own, todo, linked


def verified(own: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """What ``verify`` gives, for all components. ``own``: ``root, node, mult, n, r1, r2``; ``rows``: the texts by ``r1, r2``."""
    size = own.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    own, _ = saved(own.join(size.select("root", ((F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)).alias("large")), "root"), "sized-members", own.count())
    small = own.where(~F.col("large")).select("root", *(F.lit(0).cast("long").alias(c) for c in ("i", "j", "block")), "node", "mult", "r1", "r2")
    columns = ["root", "i", "j", "block", "node", "mult", "text"]
    if not own.where("large").limit(1).count():
        return saved(verify(small.join(rows, ["r1", "r2"]).select(*columns), threshold), "verified")[0]
    distances, _ = saved(pivot_distances(own.where("large").drop("n", "large"), rows), "distances")
    placed, todo, linked = blocks_by_distance(distances, threshold)
    ends = todo.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    members = placed.join(ends, ["root", "block"]).select("root", "i", "j", "block", "node", "mult", "r1", "r2")
    compared = verify(small.unionByName(members).join(rows, ["r1", "r2"]).select(*columns), threshold)
    to_pivot = distances.where((F.col("node") != F.col("pivot")) & (F.col("d") <= 1 - threshold + 1e-9)).select("node", F.lit(None).cast("long").alias("links"), F.col("pivot").alias("other"))
    return saved(compared.unionByName(linked).unionByName(to_pivot), "verified")[0]


def classified(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, r1, r2, class_id, n_links, copies, stays`` for every row; ``stays`` marks the class's first document."""
    sets, _ = saved(shingle_sets(docs, text_col, id_col), "sets")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")
    nodes = sets.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("mult"), F.min(name).alias("name"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    n = sets.count()
    nodes, _ = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", 5 * n)  # wider rows
    candidates = components(chosen_path_links(nodes, threshold, target))
    candidates, _ = saved(candidates, "candidates", n)
    own, _ = saved(candidates.join(nodes.select("node", "mult", "n", F.col("name.r1").alias("r1"), F.col("name.r2").alias("r2")), "node"), "members", n)
    found = verified(own, texts_of(own, docs.select(*_keys(text_col, id_col)).drop("doc_id")), threshold)
    links = found.where(F.col("links").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = nodes.select("digest", "node", "mult", "name").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes, _ = saved(classes, "classes", n)
    firsts = classes.groupBy("root").agg(F.min("name").alias("first"))
    told = classes.join(firsts, "root").select("digest", F.col("first"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.col("mult").alias("copies"))
    rows = sets.select("doc_id", "r1", "r2", "digest").join(told, "digest", "left")
    alone = F.col("digest").isNull()
    first = (F.col("r1") == F.col("first.r1")) & (F.col("r2") == F.col("first.r2"))
    return rows.select("doc_id", "r1", "r2", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), (alone | first).alias("stays"), alone.alias("alone"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, class_id, n_links, copies``: each document's class, its links to other documents, and the documents of its shingle set."""
    return classified(docs, threshold, target, text_col, id_col).select("doc_id", "class_id", "n_links", "copies")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without all but the first document (the one of least id) of each class."""
    told, _ = saved(classified(docs, threshold, target, text_col, id_col).select("r1", "r2", "stays", "alone"), "told")
    own = docs.select(F.struct("*").alias("_doc"), *_keys(text_col, id_col)).drop("doc_id", "text")
    # rows that go or are repeated; all others stay where they are read
    apart = told.where(~F.col("alone")).groupBy("r1", "r2").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where(~F.col("stays") | (F.col("n") > 1))
    picked = apart.select("r1").distinct()
    if apart.count() <= PICKED:
        picked = F.broadcast(picked)
    rest = own.join(picked, "r1", "left_semi").join(told.where("stays").distinct(), ["r1", "r2"])
    single = rest.where(~F.col("alone")).dropDuplicates(["r1", "r2"])
    return own.join(picked, "r1", "left_anti").select("_doc.*").unionByName(rest.where("alone").unionByName(single).select("_doc.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents."""
    return near_classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM numbered),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b, s.n = x.n AND s.n = y.n AS same FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE same) AS copies FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c.least, doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, coalesce(n.copies, 0) + 1 AS copies
FROM documents d LEFT JOIN class c ON c.a = doc_id LEFT JOIN counted n ON n.a = doc_id
"""
