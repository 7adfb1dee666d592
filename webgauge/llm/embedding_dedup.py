"""Near-duplicates among embeddings by sorted projection passes.

In each pass the vectors are ordered by (label, length, code), where the code is a string of signs of projections on random
directions, drawn anew for each pass. The order is cut into blocks of ``BLOCK`` places, and every vector is compared, by cosine in double
precision, with those of its own block and of the two beside it. A run of equal first signs may be longer than such a window; a vector
that isn't in its run's main ball (below) is then compared with the whole run, block by block, so that the window is no cap.
Links found in several passes count in the first one: blocks and signs of all passes travel with a vector. What a tile of
compared blocks gives out is at most a row a vector (its links counted, the least vector it hangs together with), never pairs.

Copies are one class from the start. Of near copies, balls are made: all members are within half the threshold's
angle of the ball's first vector and so linked with each other for certain, without being compared. Vectors join balls in rounds of blocks,
so a group of near copies as large as a third of the table is counted, not squared. What remains is vectors that are near a large
ball but not in it: they are compared with all of its run.

How many passes are made follows the largest label: a pair at the threshold keeps equal first signs, as many as cut that label into runs of half a block, in one
of them with a probability of at least 1 - MISS; closer pairs more. Tests measure recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label or id, link with
nothing, keep their id as component and stay. Vectors of different lengths never link. Rows that share an id are vectors of their own;
rows with equal vectors and labels link with each other. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.llm.components import components
from webgauge.llm.shared import maybe_broadcast, written
from webgauge.operators.scan import placed

COSINE = 0.93
BLOCK = 256
BITS = 62
MISS = 1e-4
#: Number of the first order in which balls are made; passes are numbered from 0.
BALL_RUN = 1_000_000
#: Two vectors within this cosine of a third one are certainly linked (half the angle, with room for rounding).
ROOM = 1e-9


def half(cosine: float) -> float:
    return math.sqrt((1 + cosine) / 2) + ROOM


def prefix_bits(n: Column) -> Column:
    """As many signs as cut n vectors into runs of about half a block."""
    return F.least(F.lit(BITS), F.ceil(F.log2(F.greatest(n / (BLOCK / 2), F.lit(1.0))))).cast("int")


def passes(largest: int, cosine: float) -> int:
    bits = math.ceil(math.log2(max(largest / (BLOCK / 2), 1)))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if meets >= 1 else max(2, math.ceil(math.log(MISS) / math.log(1 - meets)))


@lru_cache(maxsize=256)
def directions(run: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20240719, run, dim])).standard_normal((dim, BITS))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(x: np.ndarray, run: int) -> np.ndarray:
    signs = x @ directions(run, x.shape[1]) >= 0
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def code_batches(batches: Iterator[pa.RecordBatch], runs: list[int]) -> Iterator[pa.RecordBatch]:
    """(no, label, vec) to a row for each pass."""
    for batch in batches:
        lengths = np.diff(batch.column(2).offsets.to_numpy())
        for dim in np.unique(lengths):
            own = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            x = matrix(own.column(2))
            for run in runs:
                n = len(own)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(n, run, np.int32)), own.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(codes(x, run))], ["no", "run", "label", "dim", "code"])


def in_blocks(vectors: DataFrame, runs: list[int]) -> DataFrame:
    """no, run, label, dim, code, block of the vectors (no, label, vec) in each pass; labels are whole numbers."""
    coded = vectors.select("no", F.col("label").cast("long").alias("label"), "vec").mapInArrow(partial(code_batches, runs=runs), "no long, run int, label long, dim int, code long")
    at = placed(coded, ["run", "label", "dim", "code", "no"], written)
    return at.withColumn("block", F.floor(F.col("place") / BLOCK)).drop("place")


def in_group(kernel: Callable[..., pa.Table], **settings) -> Callable[[pa.Table], pa.Table]:
    """The kernel with settings, as a function whose hints Spark can read."""

    def run(table: pa.Table) -> pa.Table:
        return kernel(table, **settings)

    return run


# Balls -------------------------------------------------------------------------------------------------------------


def lead_table(table: pa.Table, cosine: float) -> pa.Table:
    """Of one block's leaders: those that another one takes in, with its vector. Larger balls, then smaller numbers, go first."""
    table = table.combine_chunks()
    no, size = (table.column(c).to_numpy() for c in ("no", "members"))
    vec = table.column("vec").combine_chunks()
    lengths, label = np.diff(vec.offsets.to_numpy()), table.column("label").to_numpy()
    gone, to = [], []
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        own = own[np.lexsort((no[own], -size[own]))]
        x = matrix(vec.take(pa.array(own)))
        near = (x @ x.T >= half(cosine)) & (label[own][:, None] == label[own][None, :])
        free = np.ones(len(own), bool)
        for i in range(len(own)):
            if free[i]:
                free[i] = False
                taken = np.flatnonzero(near[i] & free)
                free[taken] = False
                gone += own[taken].tolist()
                to += [own[i]] * len(taken)
    return pa.table({"ball": pa.array(no[gone] if gone else [], pa.int64()), "next": pa.array(no[to] if to else [], pa.int64()), "next_vec": vec.take(pa.array(to, pa.int64()))})


def move_batches(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(no, vec, next, next_vec) to (no, ball): a member goes along only if it is as near to the new leader, else it is alone."""
    for batch in batches:
        no, to = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        ball = no.copy()
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            a, b = (matrix(batch.column(i).take(pa.array(own))) for i in (1, 3))
            ball[own] = np.where((a * b).sum(1) >= half(cosine), to[own], no[own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ball)], ["no", "ball"])


def balls(vectors: DataFrame, n: int, cosine: float) -> DataFrame:
    """no, ball of the vectors (no, label, vec) that are in another one's ball (written)."""
    spark = vectors.sparkSession
    of = written(spark.createDataFrame([], "no long, ball long"), "balls")
    for round_ in range(max(1, math.ceil(math.log(max(n, 2), BLOCK)))):
        members = of.groupBy("ball").agg((F.count("*") + 1).alias("members")).withColumnRenamed("ball", "no")
        leaders = vectors.join(of.select("no"), "no", "left_anti").join(members, "no", "left").withColumn("members", F.coalesce("members", F.lit(1)))
        blocks = in_blocks(leaders, [BALL_RUN + round_]).select("no", "block")
        near = leaders.join(blocks, "no").select("block", "no", F.col("label").cast("long").alias("label"), "members", "vec").groupBy("block")
        joined = written(near.applyInArrow(in_group(lead_table, cosine=cosine), f"ball long, next long, next_vec {dict(vectors.dtypes)['vec']}"), "joined")
        if joined.isEmpty():
            break
        # the leaders that were taken in are near enough; their members have to show it
        stay = of.join(joined.select("ball"), "ball", "left_anti").select("no", "ball")
        asked = of.join(joined, "ball").join(vectors.select("no", "vec"), "no").select("no", "vec", "next", "next_vec")
        moved = asked.mapInArrow(partial(move_batches, cosine=cosine), "no long, ball long").where("no <> ball")
        of = written(stay.union(moved).union(joined.select("ball", "next")), "balls")
    return of


# Links -------------------------------------------------------------------------------------------------------------


def least_linked(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, each row's smallest row reachable."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_table(table: pa.Table, run: int, cosine: float) -> pa.Table:
    """One tile: (no, links, root) of its vectors that are linked and weren't compared in an earlier pass.

    side 0 and 1: a block and the next one. side 2: vectors outside of the main ball of a long run; side 3: a block of that run.
    """
    table = table.combine_chunks()
    side, no, label, ball, size = (table.column(c).to_numpy() for c in ("side", "no", "label", "ball", "size"))
    n, vec = len(no), table.column("vec").combine_chunks()
    lengths = np.diff(vec.offsets.to_numpy())
    block, prefix = (table.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("blocks", "prefixes"))
    a, b = (side != 1, np.ones(n, bool)) if side.max() < 2 else (side == 2, side == 3)
    counts, edges = np.zeros(n, np.int64), np.zeros((n, n), bool)
    for dim in np.unique(lengths):
        rows, cols = (np.flatnonzero(s & (lengths == dim)) for s in (a, b))
        if not len(rows) or not len(cols):
            continue
        linked = (matrix(vec.take(pa.array(rows))) @ matrix(vec.take(pa.array(cols))).T >= cosine) & (label[rows][:, None] == label[cols][None, :]) & (ball[rows][:, None] != ball[cols][None, :])
        i, j = np.nonzero(linked)
        i, j = rows[i], cols[j]
        old = np.zeros(len(i), bool)
        for p in range(run + (side.max() >= 2)):  # a long run leaves out what its windows have
            old |= np.abs(block[i, p] - block[j, p]) <= 1
            if p < run:
                old |= prefix[i, p] == prefix[j, p]
        i, j = i[~old], j[~old]
        edges[i, j] = edges[j, i] = True
    if side.max() < 2:
        counts = edges.astype(np.int64) @ size
    else:
        # a vector outside of the main ball that stands in the block as well has a tile of its own
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        counts[side == 2] = edges[side == 2][:, side == 3].astype(np.int64) @ size[side == 3]
        inside = (side == 3) & ~outside
        counts[inside] = edges[inside][:, side == 2].astype(np.int64) @ size[side == 2]
    found = np.flatnonzero(edges.any(1))
    root = least_linked(edges[np.ix_(found, found)]) if len(found) else found
    return pa.table({"no": no[found], "links": counts[found], "root": no[found[root]] if len(found) else no[found]})


def tiles(vectors: DataFrame, runs: DataFrame, long_runs: DataFrame, run: int) -> DataFrame:
    """The rows of one pass's tiles, by key."""
    columns = ["no", "label", "vec", "ball", "size", "blocks", "prefixes"]
    v = vectors.withColumn("_b", F.col("blocks")[run])
    here = lambda key, side, outside=F.lit(False): F.struct(key.alias("key"), F.lit(side).cast("int").alias("side"), outside.alias("outside"))
    first = F.struct(F.col("_b").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).cast("long").alias("cell"))
    second = F.struct((F.col("_b") - 1).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).cast("long").alias("cell"))
    windows = v.select(*columns, F.inline(F.array(here(first, 0), here(second, 1))))
    # runs that are longer than the window
    cells = long_runs.where(F.col("run") == run).select("label", "dim", F.col("prefix").alias("_p"), "low", "high", "main", "slots", "cell")
    r = v.withColumns({"_p": F.col("prefixes")[run], "dim": F.size("vec")}).join(cells, ["label", "dim", "_p"])
    r = r.withColumns({"outside": F.col("ball") != F.col("main"), "slot": F.pmod(F.xxhash64("no"), F.col("slots"))})
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.col("cell"))
    theirs = r.where("outside").select(*columns, F.explode(F.sequence("low", "high")).alias("_j"), "slot", "cell").select(*columns, here(pair(F.col("slot"), F.col("_j")), 2)["key"].alias("key"), F.lit(2).alias("side"), F.lit(True).alias("outside"))
    all_ = r.where("slots > 0").select(*columns, "outside", "_b", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("_s")).select(*columns, pair(F.col("_s"), F.col("_b")).alias("key"), F.lit(3).alias("side"), "outside")
    return windows.select(*columns, "key", "side", "outside").union(theirs).union(all_)


def classes(rows: DataFrame) -> DataFrame:
    """no, first_id, size, label, vec: the different vectors of each label that can link (written)."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("embedding"))
    groups = rows.where(ok).groupBy("label", F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    narrow = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"  # floats travel as floats, and are doubles where they are compared
    return written(groups.select(F.monotonically_increasing_id().alias("no"), "first_id", "size", "label", F.col("vec").cast(narrow).alias("vec"), F.col("vec").alias("embedding")), "classes")


def valid(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    every = classes(rows)
    vectors = every.select("no", F.col("label").cast("long").alias("label"), "vec", "size")
    counts = written(vectors.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n")), "counts")
    n, largest, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    total = passes(largest, cosine)
    of = balls(vectors, n, cosine)
    at = in_blocks(vectors, list(range(total)))
    bits = maybe_broadcast(counts.select("label", "dim", prefix_bits(F.col("n")).alias("bits")), kinds)
    at = at.join(bits, ["label", "dim"]).withColumn("prefix", F.expr(f"shiftrightunsigned(code, {BITS} - bits)"))
    gathered = at.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("run", "block", "prefix"))).alias("at"))
    wide = vectors.join(gathered, "no").join(of, "no", "left").select("no", "label", "vec", "size", F.coalesce("ball", "no").alias("ball"), F.col("at.block").alias("blocks"), F.col("at.prefix").alias("prefixes"))
    wide = written(wide, "vectors")
    # runs of equal first signs over more than two blocks, their largest ball, and how many blocks the other vectors fill
    spans = at.groupBy("run", "label", "dim", "prefix").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("high - low > 1")
    within = at.select("no", "run", "label", "dim", "prefix").join(spans, ["run", "label", "dim", "prefix"]).join(wide.select("no", "ball"), "no")
    by_ball = within.groupBy("run", "label", "dim", "prefix", "low", "high", "ball").agg(F.count("*").alias("m"))
    long_runs = by_ball.groupBy("run", "label", "dim", "prefix", "low", "high").agg(F.max_by("ball", F.struct("m", "ball")).alias("main"), (F.sum("m") - F.max("m")).alias("others"))
    long_runs = written(long_runs.select("*", F.ceil(F.col("others") / BLOCK).alias("slots"), F.monotonically_increasing_id().alias("cell")), "long-runs")
    found = None
    for run in range(total):
        tile = tiles(wide, at, long_runs, run).groupBy("key")
        told = written(tile.applyInArrow(in_group(link_table, run=run, cosine=cosine), "no long, links long, root long"), "links")
        found = told if found is None else found.union(told)
    inside = wide.groupBy("ball").agg(F.sum("size").alias("together"))
    linked = found.groupBy("no").agg(F.sum("links").alias("links"))
    edges = found.where("no <> root").select(F.col("no").alias("a"), F.col("root").alias("b")).union(of.select(F.col("no").alias("a"), F.col("ball").alias("b"))).distinct()
    groups = components(edges)
    named = every.select("no", "first_id", "size", "label", "embedding").join(wide.select("no", "ball").join(inside, "ball"), "no").join(linked, "no", "left").join(groups.withColumnRenamed("node", "no"), "no", "left")
    named = written(named.select("first_id", "label", "embedding", (F.col("together") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "no").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = named.join(least, "component").select("label", "embedding", "n_links", "component_id")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("embedding"))
    mine = rows.where(ok).join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.union(rest).select(F.col("vec_id"), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
