"""Near-duplicates by b-bit MinHash.

Of every document's distinct word shingles, ``BANDS`` x ``ROWS`` minima under random hash functions are taken. Bands
of full minima generate candidates; of each minimum the low ``BITS`` bits are kept, packed, and the share of equal
ones, corrected for chance, estimates the similarity of a candidate pair. Only pairs within five standard errors of
the threshold go on; those are confirmed on the full shingle sets.

Documents with equal sets are one class from the start and are represented by their smallest id. Within a bucket no
list of pairs is made. First every document is tried against one other, the smallest first of its buckets; links join
documents into components. In buckets that still hold several of these, the members are tried against the bucket's first.
What then is still open is compared in tiles of bounded size: a tile holds members of one bucket, tells first by signatures
which members have a partner in another component, gets the sets of those, and emits only confirmed links that
join something; so no link between components is lost to the shortcuts. A pair at the threshold shares no band with
probability 5e-8, and its estimate is five standard errors off with 3e-7.

Defined results: a document with fewer words than a shingle has one, its whole text; null and empty texts have
none, link with nothing and stay. A null id links with nothing and stays. Rows that share an id are one node. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.components import components
from webgauge.llm.shared import maybe_broadcast, without, written
from webgauge.llm.textarrays import Words, flat, mix, slices

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, BITS = 32, 4, 4
TILE = 256
_MEMBER = pa.schema([("tile", pa.string()), ("side", pa.int32()), ("band", pa.int32()), ("node", pa.int64()), ("component", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])
_rng = np.random.Generator(np.random.PCG64(77))
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHANCE = 2.0**-BITS


def shingles(part: pa.RecordBatch, column: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice: number of the text (ascending) and 64-bit hash (ascending in it)."""
    w = Words(*flat(part.column(column)), lower=True)
    at, keys = w.windows(n)
    of = w.texts()[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    for k in np.unique(w.counts[short]):
        begins, whole = w.windows(int(k))
        texts = w.texts()[begins]
        fits = w.counts[texts] == k
        of, keys = np.concatenate([of, texts[fits]]), np.concatenate([keys, mix(whole[fits] + np.uint64(k))])
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    return of[new], keys[new]


def sign_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text to size, digest, bands and packed signature of the shingle set."""
    for batch in batches:
        for part in slices(batch, 1):
            of, keys = shingles(part, 1, n)
            counts = np.bincount(of, minlength=part.num_rows)
            full = np.flatnonzero(counts)
            first = np.searchsorted(of, full)
            minima = np.zeros((BANDS * ROWS, len(full)), np.uint32)
            digests = np.zeros((2, len(full)), np.uint64)
            if len(full):
                for k in range(BANDS * ROWS):
                    minima[k] = np.minimum.reduceat((((keys ^ _ADD[k]) * _TIMES[k]) >> np.uint64(32)).astype(np.uint32), first)
                digests[0] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), first)
                digests[1] = np.add.reduceat(mix(keys + np.uint64(0x14057B7EF767814F)), first)
            bands = np.zeros((BANDS, len(full)), np.uint64)
            for b in range(BANDS):
                h = np.full(len(full), b + 1, np.uint64)
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
                bands[b] = h
            low = (minima & np.uint32(2**BITS - 1)).astype(np.uint8)
            packed = np.ascontiguousarray((low[0::2] << BITS | low[1::2]).T)
            rows = {int(r): i for i, r in enumerate(full)}
            pick = [rows.get(r) for r in range(part.num_rows)]
            flat_bands = np.ascontiguousarray(bands.T).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    *(pa.array([None if i is None else int(d[i]) for i in pick], pa.int64()) for d in digests.view(np.int64)),
                    pa.array([None if i is None else flat_bands[i] for i in pick], pa.list_(pa.int64())),
                    pa.array([None if i is None else packed[i].tobytes() for i in pick], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"],
            )


def set_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            of, keys = shingles(part, 1, n)
            at = np.searchsorted(of, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([keys[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["node", "shingles"]
            )


def least_equal(percent: int) -> int:
    """Equal packed minima that a pair at the threshold has, less five standard errors."""
    k = BANDS * ROWS
    p = _CHANCE + (1 - _CHANCE) * percent / 100
    return int(k * p - 5 * np.sqrt(k * p * (1 - p)))


def equal_minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the packed minima are equal, over the last axis."""
    d = x ^ y
    return ((d & 0xF) == 0).sum(-1) + ((d & 0xF0) == 0).sum(-1)


def estimate_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array(equal_minima(x, y) >= least if batch.num_rows else [], pa.bool_()))


def confirm_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class Tile:
    """Some members of one bucket: rows (tile, side, band, node, component, size, bits[, bands, shingles])."""

    def __init__(self, rows: list[dict], least: int, percent: int):
        self.rows, self.least, self.percent = rows, least, percent
        self.side, self.node, self.part, self.sizes = (np.array([r[c] for r in rows]) for c in ("side", "node", "component", "size"))
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.left, self.right = np.flatnonzero(self.side <= 1), np.flatnonzero(self.side >= 1)  # side 1: a block with itself

    def near(self, i: int) -> np.ndarray:
        """Members across from i, of other components, whose sizes and packed signatures allow for a link."""
        j = self.right[self.part[self.right] != self.part[i]]
        if self.side[i] == 1:
            j = j[self.node[j] > self.node[i]]
        small, large = np.minimum(self.sizes[j], self.sizes[i]), np.maximum(self.sizes[j], self.sizes[i])
        j = j[100 * small >= self.percent * large]
        return j[equal_minima(self.bits[j], self.bits[i]) >= self.least]

    def promising(self) -> pa.RecordBatch:
        """The members with a partner whose estimate passes; at most one row for each."""
        use = np.zeros(len(self.rows), bool)
        for i in self.left:
            j = self.near(i)
            use[j] = True
            use[i] |= len(j) > 0
        rows = [{c: self.rows[i][c] for c in _MEMBER.names} for i in np.flatnonzero(use)]
        return pa.RecordBatch.from_pylist(rows, schema=_MEMBER)

    def links(self) -> pa.RecordBatch:
        """Links between components, confirmed on full sets; none of those that join what the tile's links have joined."""
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in self.rows]
        bands = np.array([r["bands"] for r in self.rows])
        a, b = [], []
        for i in self.left:
            j = self.near(i)
            # a pair that shares several bands is looked at in the first one only
            j = j[np.argmax(bands[j] == bands[i], axis=1) == self.rows[i]["band"]]
            if not len(j):
                continue
            at = np.cumsum([0, *(len(sets[k]) for k in j)])
            every = np.concatenate([sets[k] for k in j])
            place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][place] == every).astype(np.int64), at[:-1])
            for k in j[100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both)]:
                if self.part[k] != self.part[i]:
                    a.append(min(self.node[i], self.node[k]))
                    b.append(max(self.node[i], self.node[k]))
                    self.part[self.part == self.part[k]] = self.part[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def tile_batches(batches: Iterator[pa.RecordBatch], least: int, percent: int, confirm: bool) -> Iterator[pa.RecordBatch]:
    """Members in order of tile to the promising ones, or to links."""

    def done(rows: list[dict]) -> pa.RecordBatch:
        tile = Tile(rows, least, percent)
        return tile.links() if confirm else tile.promising()

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["tile"] != held[0]["tile"]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def estimated(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose packed signatures agree enough."""
    x = bits.select(F.col("node").alias("a"), F.col("bits").alias("x"))
    y = bits.select(F.col("node").alias("b"), F.col("bits").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(partial(estimate_batches, least=least_equal(percent)), "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, shingles (written) of the given nodes (written)."""
    texts = docs.join(maybe_broadcast(nodes, nodes.count()), F.col("doc_id") == F.col("node")).select("node", "text")
    return written(texts.mapInArrow(partial(set_batches, n=n), "node long, shingles binary"), "sets")


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b), written, whose full shingle sets are similar enough."""
    pairs = written(pairs, "candidates")
    sets = shingle_sets(docs, written(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "nodes"), n)
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(partial(confirm_batches, percent=percent), "a long, b long"), "links")


def open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, band, first, node, component of the buckets that hold several components."""
    m = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = m.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return m.join(several.where("lo <> hi").select("key", "n"), "key").select("key", "band", "first", "n", "node", "component")


def across(docs: DataFrame, members: DataFrame, heads: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b), written, between components that meet in an open bucket.

    A bucket is compared in tiles of two blocks of about TILE members; its largest component isn't compared with itself.
    Signatures come first; the sets follow of the members that have a partner whose estimate passes.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("of"))
    top = sizes.groupBy("key").agg(F.max(F.struct("of", "component")).alias("top"), F.sum("of").alias("all"))
    blocks = lambda x: F.ceil(x / TILE).cast("int")
    top = top.select("key", F.col("top.component").alias("bulk"), blocks(F.col("all") - F.col("top.of")).alias("few"), blocks(F.col("top.of")).alias("many"))
    in_bulk, spread = F.col("component") == F.col("bulk"), F.xxhash64("node")
    block = F.when(in_bulk, F.col("few") + F.pmod(spread, F.col("many"))).otherwise(F.pmod(spread, F.col("few"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_bulk, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    m = members.join(top, "key").select("key", "band", "node", "component", block.alias("block"), F.explode(others).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    m = m.select(F.concat_ws("/", "key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), side.alias("side"), "band", "node", "component")

    def tiled(rows: DataFrame, confirm: bool, out: str) -> DataFrame:
        at_tile = rows.repartition("tile").sortWithinPartitions("tile")
        return at_tile.mapInArrow(partial(tile_batches, least=least_equal(percent), percent=percent, confirm=confirm), out)

    signed = m.join(heads.select("node", F.col("n_shingles").alias("size"), "bits"), "node")
    good = written(tiled(signed, False, "tile string, side int, band int, node long, component long, size long, bits binary"), "promising")
    nodes = written(good.select("node").distinct(), "nodes")
    sets = shingle_sets(docs, nodes, n)
    full = good.join(sets, "node").join(heads.select("node", "bands"), "node")
    return written(tiled(full, True, "a long, b long"), "across")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(
        d.mapInArrow(partial(sign_batches, n=n), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits binary"), "signatures"
    )
    some = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    of_class = F.col("doc_id") == F.col("node")
    same = of_class & (F.col("s.d1") == F.col("c.d1")) & (F.col("s.d2") == F.col("c.d2"))
    heads = some.alias("s").join(classes.alias("c"), same).select("node", "s.n_shingles", "bands", "bits").dropDuplicates(["node", "bands"])
    heads = written(heads, "heads")
    bits = heads.select("node", "bits")
    banded = heads.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key", "first")
    members = written(banded.join(shared, "key").select("key", "band", "node", "first"), "members")
    # everyone is tried against the smallest first of its buckets; then, in the buckets still open, against their firsts
    pairs = members.where("first < node").groupBy("node").agg(F.min("first").alias("a")).select("a", F.col("node").alias("b"))
    links = confirmed(d, estimated(pairs, bits, percent), n, percent)
    still = written(open_members(members, components(links)), "open")
    lead = still.where("first = node").select("key", F.col("component").alias("of_first"))
    pairs = still.join(lead, "key").where("component <> of_first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = written(links.unionByName(confirmed(d, estimated(pairs, bits, percent), n, percent)), "links")
    parts = components(links)
    still = written(open_members(still.drop("component", "n"), parts).where("n > 2"), "open")  # of two, the only pair has been tried
    if not still.isEmpty():
        links = links.unionByName(across(d, still, heads, n, percent))
        parts = components(links)
    of = signed.select("doc_id", "n_shingles", "d1", "d2").alias("s").join(
        classes.alias("c"), ["d1", "d2", "n_shingles"], "left"
    ).select("s.doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    out = of.join(parts, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, that are the smallest id of their group of near-duplicates."""
    gone = near_duplicates(docs.select("doc_id", "text"), n, percent).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, written(gone, "duplicates"))
