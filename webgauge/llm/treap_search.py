"""Ranked lexical search with inverted treaps.

An index row holds one shard of the documents, in order of their ids: its different terms as text, and for each term the places of the documents
that hold it, with how often. For a search, every asked term's postings in a shard become a treap: document order for searching,
impact (what one occurrence list can add to a score, before the term's weight) order as a heap, so a subtree's root bounds all below it.
The items' treaps are descended together. A state is an item, a stretch of documents, and of each of the item's terms the root of its treap within that
stretch; the weighted impacts of these roots, summed, bound every score in the stretch. Stretches that can't reach the item's k best so far are
dropped; the others are parted at the document of their heaviest root, which is scored. All states of all items take a step at once,
as numpy arrays; a task keeps the k best of each item from shard to shard, so later shards are pruned harder. What leaves a task is k rows an item.

Scores are whole numbers, exact in 64 bits; the bound is never below a score, so the result is exact. Terms are compared as text; nothing rests on a hash.

Items are asked in blocks of a bounded number of bytes, which the driver holds while it asks them: term texts, weights and which item has
which term. A block is one pass over the index, and over its terms' counts before.

Defined results: a null or empty text has no terms, isn't counted and never found; an item without terms finds nothing. Each row is a document of its own,
also if ids repeat or are null (null ids come last among equal scores); likewise items. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgauge.llm.shared import written
from webgauge.llm.textarrays import LOWER, flat, mix, slices

#: A term is a longest run of these bytes: ASCII digits and letters, and all of other characters.
TERM = np.ones(256, bool)
TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Index rows are large: so many at a time go through Arrow.
ROWS_AT_ONCE = 4
K = 20
K1000, TF, B100 = 12, 1_000_000_000, 25
INDEX = "ids binary, id_known binary, lengths binary, terms array<binary>, df binary, places binary, tf binary"


@contextmanager
def few_rows(spark: SparkSession):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def terms_of(text: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another, and the number of terms of each text."""
    text = LOWER[text]
    inside = TERM[text]
    starts = inside.copy()
    if len(text):
        starts[1:] &= ~inside[:-1]
        bounds = offsets[(offsets > 0) & (offsets < len(text))]
        starts[bounds] = inside[bounds]
    begin = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(begin, offsets))
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside, dtype=np.int64)])
    ends = np.append(kept[begin], kept[-1]).astype(np.int64)  # without what lies between terms they follow each other
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(text[inside])]), counts


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row a shard."""
    for batch in batches:
        for part in slices(batch, 1, SHARD_BYTES):
            ids, known = part.column(0).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), part.column(0).is_valid().to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, ~known))
            part, ids, known = part.take(pa.array(order)), ids[order], known[order]
            words, counts = terms_of(*flat(part.column(1)))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            key, tf = np.unique(code * len(counts) + doc, return_counts=True)
            df = np.bincount(key // len(counts), minlength=len(coded.dictionary))
            row = [ids.tobytes(), known.tobytes(), counts.astype(np.int64).tobytes(), coded.dictionary.cast(pa.binary()), df.astype(np.int32).tobytes(), (key % len(counts)).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.binary()) for x in row[:3]), pa.ListArray.from_arrays(pa.array([0, len(row[3])], pa.int32()), row[3]), *(pa.array([x], pa.binary()) for x in row[4:])],
                ["ids", "id_known", "lengths", "terms", "df", "places", "tf"],
            )


def index(docs: DataFrame) -> DataFrame:
    """The index of all documents, written in the shared folder."""
    return written(docs.select("doc_id", "text").mapInArrow(index_batches, INDEX), "treap-index")


def size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = words = 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            lengths = np.frombuffer(x, np.int64)
            n, words = n + int((lengths > 0).sum()), words + int(lengths.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], ["n", "words"])


class Block:
    """Items asked at once: terms in byte order, and per item (a row each) numbers of its terms and how often it has each."""

    def __init__(self, texts: list[str | None]):
        words, counts = terms_of(*flat(pa.array(texts, pa.string())))
        coded = words.dictionary_encode()
        self.terms = coded.dictionary.cast(pa.binary())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.repeat(np.arange(len(counts)), counts)
        key, self.times = np.unique(item * max(1, len(self.terms)) + code, return_counts=True)
        self.item, self.term = key // max(1, len(self.terms)), key % max(1, len(self.terms))
        self.n_items = len(counts)

    def found(self, terms: pa.Array) -> np.ndarray:
        """Of terms of a shard: their numbers here, -1 for others."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def df_batches(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(block.terms), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            at = block.found(batch.column(0)[i].values)
            total[at[at >= 0]] += np.frombuffer(batch.column(1)[i].as_py(), np.int32)[at >= 0]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])


class Treaps:
    """One treap for each stretch of postings between ``cuts``: roots and children as places in the postings, -1 for none."""

    def __init__(self, cuts: np.ndarray, impact: np.ndarray):
        n = len(impact)
        rank = impact.astype(np.uint64) << np.uint64(40) | mix(np.arange(n, dtype=np.uint64)) >> np.uint64(24)  # ties in random order keep treaps flat
        first, last = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        # the nearest heavier posting on either side: all between is lighter, so one may jump by what is known of others
        todo = np.flatnonzero(before >= first)
        while len(todo):
            todo = todo[rank[before[todo]] < rank[todo]]
            before[todo] = before[before[todo]]
            todo = todo[before[todo] >= first[todo]]
        todo = np.flatnonzero(after < last)
        while len(todo):
            todo = todo[rank[after[todo]] <= rank[todo]]
            after[todo] = after[after[todo]]
            todo = todo[after[todo] < last[todo]]
        has_b, has_a = before >= first, after < last
        by_b = has_b & (~has_a | (rank[np.where(has_b, before, 0)] < rank[np.where(has_a, after, 0)]))
        by_a = has_a & ~by_b
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        self.right[before[by_b]] = np.flatnonzero(by_b)
        self.left[after[by_a]] = np.flatnonzero(by_a)
        top = np.flatnonzero(~has_b & ~has_a)
        self.root = np.full(len(cuts) - 1, -1)
        self.root[np.searchsorted(cuts, top, "right") - 1] = top


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.bar = k, np.ones(n_items, np.int64)  # a score below the bar can't be among the k best
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        good = score >= self.bar[item]
        if not good.any():
            return
        item, score, doc, known = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, ~known, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[place < self.k], item[place < self.k]
        self.item, self.score, self.doc, self.known = item, score[order], doc[order], known[order]
        full = place[place < self.k] == self.k - 1
        self.bar[item[full]] = self.score[full]


def search_shard(row: dict, block: Block, weight: np.ndarray, n: int, words: int, best: Best) -> None:
    at = block.found(row["terms"])
    df = np.frombuffer(row["df"], np.int32).astype(np.int64)
    ends = np.cumsum(df)
    own = np.flatnonzero((at >= 0) & (weight[np.maximum(at, 0)] > 0))
    if not len(own):
        return
    ids, known, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_known"], bool), np.frombuffer(row["lengths"], np.int64)
    sizes = df[own]
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    pick = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes) + np.repeat(ends[own] - sizes, sizes)
    doc, tf = np.frombuffer(row["places"], np.int32)[pick].astype(np.int64), np.frombuffer(row["tf"], np.int32)[pick].astype(np.int64)
    m = 100 - B100 + (B100 * lengths * n) // words
    impact = (TF * tf) // (1000 * tf + K1000 * m[doc])
    treaps = Treaps(cuts, impact)
    here = np.full(len(block.terms), -1)
    here[at[own]] = np.arange(len(own))
    # (item, term) pairs of this shard, by item; a state holds the pairs whose treap has something in its stretch
    pairs = np.flatnonzero(here[block.term] >= 0)
    gain = (weight[block.term] * block.times)[pairs]
    item_of, node = block.item[pairs], treaps.root[here[block.term[pairs]]]
    states, state = np.unique(item_of, return_inverse=True)  # the item of each state; the state of each pair
    low, high = np.full(len(states), -1), np.full(len(states), len(ids))  # a state's stretch lies between these
    while len(states):
        heavy = gain * impact[node]
        bound = np.bincount(state, heavy, len(states)).astype(np.int64)  # sums stay far below 2**53
        alive = bound >= best.bar[states]
        if not alive.any():
            break
        keep = alive[state]
        renumber = np.cumsum(alive) - 1
        low, high = low[alive], high[alive]
        states, state, node, gain, heavy = states[alive], renumber[state[keep]], node[keep], gain[keep], heavy[keep]
        begin = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        most = np.maximum.reduceat(heavy, begin)
        first = np.flatnonzero(heavy == most[state])
        first = first[np.concatenate([[True], state[first][1:] != state[first][:-1]])]
        pivot = doc[node[first]]
        # part every treap at the pivot: roots of what lies before and after it, and its own posting if there is one
        p = pivot[state]
        before, after, hit = np.full(len(node), -1), np.full(len(node), -1), np.full(len(node), -1)
        go, cur = np.arange(len(node)), node
        while len(go):
            d, want, s = doc[cur], p[go], state[go]
            less, more = d < want, d > want
            new = less & (before[go] < 0) & (d > low[s])
            before[go[new]] = cur[new]
            new = more & (after[go] < 0) & (d < high[s])
            after[go[new]] = cur[new]
            same = ~less & ~more
            hit[go[same]] = cur[same]
            cur = np.where(less, treaps.right[cur], treaps.left[cur])
            on = ~same & (cur >= 0)
            go, cur = go[on], cur[on]
        # below the posting itself, unless a higher one was met: the first one within the stretch
        for side, child, turn, out in ((before, treaps.left, treaps.right, lambda d, s: d <= low[s]), (after, treaps.right, treaps.left, lambda d, s: d >= high[s])):  # noqa: B023
            go = np.flatnonzero((hit >= 0) & (side < 0))
            cur = child[hit[go]]
            while len(go):
                go, cur = go[cur >= 0], cur[cur >= 0]
                past = out(doc[cur], state[go])
                side[go[~past]] = cur[~past]
                go, cur = go[past], turn[cur[past]]
        score = np.bincount(state, np.where(hit >= 0, gain * impact[np.maximum(hit, 0)], 0), len(states)).astype(np.int64)
        best.add(states, score, ids[pivot], known[pivot])
        state, node, gain = np.concatenate([2 * state, 2 * state + 1]), np.concatenate([before, after]), np.concatenate([gain, gain])
        there = node >= 0
        order = np.argsort(state[there], kind="stable")
        state, node, gain = state[there][order], node[there][order], gain[there][order]
        used, state = np.unique(state, return_inverse=True)
        low, high = np.where(used % 2, pivot[used // 2], low[used // 2]), np.where(used % 2, high[used // 2], pivot[used // 2])
        states = states[used // 2]


def search_batches(batches: Iterator[pa.RecordBatch], block: Block, weight: np.ndarray, n: int, words: int, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(block.n_items, k)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            search_shard({name: x.values if name == "terms" else x.as_py() for name, x in row.items()}, block, weight, n, words, best)
    yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=~best.known), pa.array(best.score, pa.int64())], ["slot", "doc_id", "score"])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def search(indexed: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of an index for each item (item_id, text)."""
    spark = indexed.sparkSession
    out = "item_id bigint, rank int, doc_id bigint, score bigint"
    n, words = indexed.select("lengths").mapInArrow(size_batches, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("slot")), "items")
    blocks = max(1, math.ceil((numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    found = None
    for b in range(blocks if words else 0):
        asked = numbered.where(F.pmod(F.xxhash64("slot"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES, by the count above
        block = Block([x.text for x in asked])
        if not len(block.terms):
            continue
        with few_rows(spark):
            df = np.zeros(len(block.terms), np.int64)
            for x in indexed.select("terms", "df").mapInArrow(partial(df_batches, block=block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms at most
                df[x.term] = x.df
            kind = partial(search_batches, block=block, weight=np.where(df > 0, weights(df, n), 0), n=n, words=words, k=k)
            hits = indexed.mapInArrow(kind, "slot long, doc_id long, score long")
            ids = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(asked)], "slot long, item_id long")
            rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            top = hits.withColumn("rank", rank).where(F.col("rank") <= k)
            top = written(top.join(F.broadcast(ids), "slot").select("item_id", "rank", "doc_id", "score"), "hits")
        found = top if found is None else found.union(top)
    return spark.createDataFrame([], out) if found is None else found
