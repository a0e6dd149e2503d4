"""Operator 6: approximate nearest neighbours by cosine, in a hash-prefix forest.

Each of TREES trees gives every vector a string of BITS bits, the sides of random hyperplanes; a
tree is the array of its strings in sorted order, in which the strings with a common prefix are one
run. Queries are the vectors whose id is divisible by ``every``; all vectors are indexed. A query
descends in each tree to its longest prefix match, beside its own place in the sorted array, and
ascends in all trees at once, a bit at a time, until the runs of a level hold ``fewest`` vectors, and
one of them k; these are compared with it. Two vectors at angle a share x bits of a tree with probability
(1 - a / pi) ** x: from the k-th similarity so far follows the level at which a neighbour as near as
that has been seen, in some tree, with probability ``target``, and the query ascends there at once.
The k-th similarity can only have grown by then, so that a query is done after two levels. Where
the runs of all trees would hold an eighth of all vectors (TREES / 2 ** x), the query goes to the
root, the empty prefix, and is compared with all, as rows of a matrix product. How far it ascends
depends on its neighbourhood alone; vectors without structure (no near neighbours) go to the root,
which is work in proportion to queries times vectors. There is no cap on candidates.

Plan: equal vectors collapse to their least id, k + 1 ids of each kept, which is all that a result can
name; a query with k copies is answered by them. The sorted arrays are one range-partitioned sort by
(tree, string, id), written as segments of about RUN strings: as the id is part of the key, a run
of any length, of near copies for instance, is cut over as many segments as it fills. Segment bounds
go to the driver (their number is n * TREES / RUN); by them a query is sent to the segments that
its runs touch, and to no others. Only ids and strings are in the forest; vectors join the distinct
candidate pairs. At the root, blocks of queries meet blocks of vectors.

Defined results: null, empty and all-zero vectors, those with a null, NaN or infinite element and
those not of the most common length (of equally common ones, the greatest) are neither queries nor
neighbours; ids are numbers, rows with null vec_id are ignored; of rows sharing a vec_id the least
vector stands; similarities are rounded to six places before they are ranked, equal ones rank by
vec_id; fewer than k other vectors give fewer rows; an empty table gives no rows; long vectors
are compared whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, parts, released

NEIGHBOURS = 10
EVERY = 20
TREES, BITS = 16, 63
FEWEST = 100
TARGET = 0.92
RUN = 1 << 16
BLOCK = 1 << 15
SEED = 20240229


def vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, vec: the rows that are indexed."""
    as_double = F.col(column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), as_double.alias("vec")).where("id is not null and size(vec) > 0")
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(sound)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(common.select("d")), F.size("vec") == F.col("d")).groupBy("id").agg(F.min("vec").alias("vec"))


def planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * bits)).astype(np.float32)


def strings(x: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """The hash string of each row in each tree, as integers whose first bit is the highest."""
    side = (x @ planes(x.shape[1], trees, bits) > 0).reshape(len(x), trees, bits)
    return (side * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1)


def _strings(trees: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = strings(_matrix(part.column(1)), trees, bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(s))), pa.array(s.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), trees))], names=["tree", "string", "id"])

    return run


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as one row; its number is the segment's."""
    from pyspark import TaskContext

    tree, string, ids = [], [], []
    for b in batches:
        for to, i in ((tree, 0), (string, 1), (ids, 2)):
            to.append(b.column(i).to_numpy(zero_copy_only=False))
    if sum(map(len, tree)):
        t, s, i = (np.concatenate(x) for x in (tree, string, ids))
        values = [TaskContext.get().partitionId(), int(t[0]), int(s[0]), int(i[0]), int(t[-1]), int(s[-1]), t.astype("<i4").tobytes(), s.astype("<i8").tobytes(), i.astype("<i8").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["segment", "tree", "string", "id", "last_tree", "last_string", "trees", "strings", "ids"])


class Bounds:
    """The first (tree, string, id) of each segment, in order."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["tree"], r["string"], r["id"]))
        self.segment = np.array([r["segment"] for r in rows], dtype=np.int32)
        self.tree = np.array([r["tree"] for r in rows], dtype=np.int64)
        self.string = np.array([r["string"] for r in rows], dtype=np.int64)
        self.last_tree = np.array([r["last_tree"] for r in rows], dtype=np.int64)
        self.last_string = np.array([r["last_string"] for r in rows], dtype=np.int64)

    def touched(self, tree: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and range of strings, both ends included, the first and the number of the
        segments (places in order) that may hold a string of it."""
        first, count = np.zeros(len(tree), dtype=np.int64), np.zeros(len(tree), dtype=np.int64)
        for t in np.unique(tree):
            on = tree == t
            # Places whose end is not before lo, and whose begin is not after hi.
            ends = np.where(self.last_tree > t, np.iinfo(np.int64).max, np.where(self.last_tree < t, -1, self.last_string))
            begins = np.where(self.tree < t, -1, np.where(self.tree > t, np.iinfo(np.int64).max, self.string))
            a = np.searchsorted(ends, lo[on], side="left")
            z = np.searchsorted(begins, hi[on], side="right")
            first[on], count[on] = a, np.maximum(z - a, 0)
        return first, count


def _route(shared, trees: int, bits: int):
    """query, level, tree, string, segment: where the run of a query's prefix lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, level = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                s = strings(_matrix(part.column(2)), trees, bits).astype(np.int64).reshape(-1)
                query, x, tree = np.repeat(ids, trees), np.repeat(level, trees), np.tile(np.arange(trees), len(ids))
                below = (np.int64(1) << (bits - x)) - 1
                first, count = bounds.touched(tree, s & ~below, s | below)
                row = np.repeat(np.arange(len(query)), count)
                place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(x[row].astype(np.int32)), pa.array(tree[row].astype(np.int32)), pa.array(s[row]), pa.array(bounds.segment[place])], names=["query", "level", "tree", "string", "segment"])

    return run


def _runs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda c, kind: np.frombuffer(group[c][0].as_py(), kind)
    return read("trees", "<i4"), read("strings", "<i8"), read("ids", "<i8")


def _places(trees, values, tree, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Range of a segment's places with each tree and range of strings."""
    a, z = np.zeros(len(tree), dtype=np.int64), np.zeros(len(tree), dtype=np.int64)
    for t in np.unique(tree):
        on = tree == t
        b, e = np.searchsorted(trees, (t, t + 1))
        a[on] = b + np.searchsorted(values[b:e], lo[on], side="left")
        z[on] = b + np.searchsorted(values[b:e], hi[on], side="right")
    return a, z


def _descend(bits: int, fewest: int):
    """query, level, n, run: how many strings of a segment, its own included, share exactly level bits
    with the query's and how many as many or more, from its longest match on upwards until fewest
    others are met. Near a segment's ends these are lower bounds, which ascend a little further."""

    def run(key, segments: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 4
        if segments.num_rows and queries.num_rows:
            trees, values, _ = _runs(segments)
            query, tree, string = (queries[c].to_numpy() for c in ("query", "tree", "string"))
            found = []
            who, inner = np.arange(len(query)), np.zeros(len(query), dtype=np.int64)
            for level in range(bits, -1, -1):
                below = (np.int64(1) << np.int64(bits - level)) - 1
                a, z = _places(trees, values, tree[who], string[who] & ~below, string[who] | below)
                n, before = z - a, inner[who]
                more = n > before
                found.append((query[who][more], np.full(int(more.sum()), level), (n - before)[more], n[more]))
                inner[who] = n
                who = who[n <= fewest]
                if not len(who):
                    break
            out = [np.concatenate(x) for x in zip(*found)]
        return pa.table({"query": pa.array(out[0], pa.int64()), "level": pa.array(out[1].astype(np.int32)), "n": pa.array(out[2], pa.int64()), "run": pa.array(out[3], pa.int64())})

    return run


def _meet(bits: int):
    """query, id: the strings of a segment that share a query's prefix."""

    def run(key, segments: pa.Table, queries: pa.Table) -> pa.Table:
        left = right = np.empty(0, np.int64)
        if segments.num_rows and queries.num_rows:
            trees, values, ids = _runs(segments)
            query, level, tree, string = (queries[c].to_numpy() for c in ("query", "level", "tree", "string"))
            below = (np.int64(1) << (bits - level.astype(np.int64))) - 1
            a, z = _places(trees, values, tree, string & ~below, string | below)
            n = z - a
            left = np.repeat(query, n)
            right = ids[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            keep = left != right
            keep[1:] &= (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            left, right = left[keep], right[keep]
        return pa.table({"query": pa.array(left, pa.int64()), "id": pa.array(right, pa.int64())})

    return run


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            s = np.round(np.einsum("ij,ij->i", _matrix(b.column("u")), _matrix(b.column("v"))).astype(np.float64), 6)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(s)], names=["query", "id", "sim"])


def best_rows(top: int, sim: np.ndarray, names: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of rounded similarities the top by similarity, then by name, without its own."""
    sim[query[:, None] == names[None, :]] = -2
    if sim.shape[1] > top:
        cut = np.partition(sim, sim.shape[1] - top, axis=1)[:, sim.shape[1] - top]
    else:
        cut = np.full(len(sim), -1.5)
    r, c = np.nonzero((sim >= cut[:, None]) & (sim > -1.5))
    order = np.lexsort((names[c], -sim[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[rank < top], c[rank < top]
    return query[r], names[c], sim[r, c]


def _cell(top: int):
    """A block of queries against a block of vectors."""

    def run(key, points: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if points.num_rows and queries.num_rows:
            names, x = points["id"].to_numpy(), _matrix(points["vec"])
            query, y = queries["query"].to_numpy(), _matrix(queries["vec"])
            for at in range(0, len(query), 256):
                sim = np.round((y[at : at + 256] @ x.T).astype(np.float64), 6)
                found.append(best_rows(top, sim, names, query[at : at + 256]))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "sim": pa.array(s, pa.float64())})

    return run


def _top(rows: DataFrame, k: int, *extra: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "sim", "rank", *extra)


def wanted_level(kth: Column, trees: int, target: float) -> Column:
    """The level at which a vector as similar as kth shares a prefix in some tree with probability target."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), kth)))
    share = F.log(F.greatest(F.lit(1e-12), 1 - angle / math.pi))
    return F.when(share > -1e-9, F.lit(1 << 20)).otherwise(F.floor(F.lit(math.log(1 - (1 - target) ** (1 / trees))) / share)).cast("int")


def neighbours(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, trees: int = TREES, fewest: int = FEWEST, target: float = TARGET, id_column: str = "vec_id", column: str = "embedding", stats: dict | None = None) -> DataFrame:
    """vec_id, neighbor_id, rank, similarity of the k nearest others of every vector whose id is
    divisible by ``every``. stats, where given, gets the numbers of vectors, of searches, of pairs compared
    after descent and after ascent, and of searches that went to the root."""
    if k < 1 or trees < 1 or every < 1 or fewest < k or not 0 < target < 1:
        raise ValueError("k, trees and every must be positive, fewest at least k, and target within (0, 1)")
    spark, scratch = table.sparkSession, []
    h = ["h1", "h2"]
    unit = vectors(table, id_column, column).mapInArrow(_unit, "id long, vec binary").select("id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    unit = materialize(unit, "unit-vectors", scratch)
    copies = Window.partitionBy(*h).orderBy("id")
    members = materialize(unit.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).withColumn("rep", F.min("id").over(Window.partitionBy(*h))), "members")
    points = members.where("nth = 1").select("id", "vec")
    asked = unit.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("asked"), *h).join(members.where("nth = 1").select("rep", *h), h).select("asked", "rep")
    full = members.where(F.col("nth") == k + 1).select("rep")
    search = materialize(asked.select("rep").distinct().join(full, "rep", "left_anti").join(points, F.col("rep") == F.col("id")).select(F.col("rep").alias("query"), "vec"), "searches", scratch)
    n, n_searches = points.count(), search.count()

    n_segments = max(1, -(-n * trees // RUN))
    sorted_ = points.mapInArrow(released(_strings(trees, BITS)), "tree int, string long, id long").repartitionByRange(n_segments, "tree", "string", "id").sortWithinPartitions("tree", "string", "id")
    forest = materialize(sorted_.mapInArrow(_segment, "segment int, tree int, string long, id long, last_tree int, last_string long, trees binary, strings binary, ids binary"), "forest", scratch)
    ends = forest.select("segment", "tree", "string", "id", "last_tree", "last_string").collect()  # a row for RUN strings
    runs = forest.select("segment", "trees", "strings", "ids")

    def routed(levels: DataFrame) -> DataFrame:
        return levels.select("query", "level", "vec").mapInArrow(_route(shared, trees, BITS), "query long, level int, tree int, string long, segment int")

    def compared(levels: DataFrame, name: str) -> DataFrame:
        found = runs.groupBy("segment").cogroup(routed(levels).groupBy("segment")).applyInArrow(_meet(BITS), "query long, id long").distinct()
        pairs = found.join(points.select("id", F.col("vec").alias("v")), "id").join(search.select("query", F.col("vec").alias("u")), "query")
        done = materialize(pairs.mapInArrow(_similarities, "query long, id long, sim double"), name, scratch)
        if stats is not None:
            stats[name] = done.count()
        return _top(done, k)

    if ends and n_searches:
        shared = spark.sparkContext.broadcast(Bounds(ends))
        own = routed(search.withColumn("level", F.lit(BITS)))
        met = runs.groupBy("segment").cogroup(own.groupBy("segment")).applyInArrow(_descend(BITS, fewest), "query long, level int, n long, run long")
        upward = Window.partitionBy("query").orderBy(F.desc("level"))
        per_level = met.groupBy("query", "level").agg(F.sum("n").alias("n"), F.max("run").alias("run"))
        so_far = per_level.select("query", "level", F.sum("n").over(upward).alias("n"), F.max("run").over(upward).alias("run"))
        # Its own string is in every tree; the same neighbours may be in all: one run must hold k others.
        enough = (F.col("n") >= fewest + trees) & (F.col("run") > k)
        reached = so_far.groupBy("query").agg(F.coalesce(F.max(F.when(enough, F.col("level"))), F.min("level")).alias("level"))
        first = materialize(search.join(reached, "query"), "descended", scratch)
        near = materialize(compared(first, "descent"), "nearest", scratch)
        kth = near.groupBy("query").agg(F.min("sim").alias("kth"), F.count("*").alias("found"))
        state = search.join(first.select("query", F.col("level").alias("seen")), "query", "left").join(kth, "query", "left")
        level = F.when(F.coalesce("found", F.lit(0)) < k, F.lit(0)).otherwise(wanted_level(F.col("kth"), trees, target))
        least = math.log2(trees) + 3
        state = materialize(state.withColumn("level", level).where(F.col("seen").isNull() | (F.col("level") < F.col("seen"))).select("query", "vec", F.when(F.col("level") > least, F.col("level")).otherwise(0).alias("level")), "ascending", scratch)
        more = compared(state.where("level > 0"), "ascent")
        at_root = state.where("level = 0").select("query", "vec")
        n_root = at_root.count()
    else:
        near = more = spark.createDataFrame([], "query long, id long, sim double, rank int")
        at_root, n_root = search, n_searches
    if stats is not None:
        stats |= {"vectors": n, "searches": n_searches, "root": n_root}
    p_blocks, q_blocks = max(1, -(-n // BLOCK), min(parts(spark), -(-n // 1024))), max(1, -(-n_root // BLOCK))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    if n_root:
        p = points.select("id", "vec", spread("id", p_blocks).alias("p"), each(q_blocks).alias("q"))
        q = at_root.select("query", "vec", spread("query", q_blocks).alias("q"), each(p_blocks).alias("p"))
        cells = p.groupBy("p", "q").cogroup(q.groupBy("p", "q")).applyInArrow(_cell(k), "query long, id long, sim double")
        root = _top(cells, k)
    else:
        root = near.limit(0)
    # A query's rows come from where it ended: the later ones replace or join the earlier.
    found = near.unionByName(more).unionByName(root).groupBy("query", "id").agg(F.max("sim").alias("sim"))
    best = materialize(_top(found, k), "best")
    asked = materialize(asked, "asked")
    discard(spark, scratch)
    named = members.select(F.col("rep").alias("of"), F.col("id").alias("member"))
    others = asked.join(best, F.col("rep") == F.col("query")).join(named, F.col("id") == F.col("of")).select("asked", "member", "sim")
    own = asked.join(named, F.col("rep") == F.col("of")).where("member <> asked").select("asked", "member", F.lit(1.0).alias("sim"))
    ranked = _top(own.unionByName(others).select(F.col("asked").alias("query"), F.col("member").alias("id"), "sim"), k)
    return ranked.select(F.col("query").alias("vec_id"), F.col("id").alias("neighbor_id"), F.col("rank").cast("long").alias("rank"), F.col("sim").alias("similarity"))


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
