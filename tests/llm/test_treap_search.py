import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, corpus, expected, got
from webgauge.llm import treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    terms = [(d, Counter(TERM.findall((t or "").translate(AZ)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, words, df = len(terms), sum(sum(c.values()) for _, c in terms), Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 75 + (25 * sum(c.values()) * n) // words
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(TERM.findall((text or "").translate(AZ))).items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    more = [(1000 + i, " ".join(r.choice(["the", "of", "Rare%d" % r.randrange(30), "x1", "élan", "漢字"]) for _ in range(r.randint(1, 60)))) for i in range(400)]
    return corpus() + more + [(5000 + i, "copy of one rare3 text") for i in range(60)] + [(None, "rare3 null id"), (7, "rare3,rare3;RARE3"), (7, "rare3,rare3;RARE3"), (8, "a\0b.c"), (9, "..., !")]


ITEMS = [(1, "The rare3 of RARE3, and élan!"), (2, None), (3, ""), (4, "?!"), (5, "copy of one rare3 text"), (5, "rare7"), (None, "漢字 x1"), (6, "nothingofthiskind"), (7, "ab abc é ß 漢 bab a b c"), (8, "the " * 40)]


@pytest.mark.parametrize("shard", [1 << 10, 4 << 20])
def test_search(spark, rows, shard, monkeypatch):
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 1, 2, 3, 4, 5, "k") for d, t in rows], SCHEMA).repartition(3)
    items = spark.createDataFrame([(*x, 1, "z") for x in ITEMS], "item_id long, text string, rank int, doc_id string")
    monkeypatch.setattr(treap_search, "BLOCK_BYTES", shard)
    found = treap_search.search(treap_search.index(docs), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == expected(brute(rows, ITEMS))


def test_many_small_shards(rows):
    """Shard by shard with the bar carried along, as a task does it."""
    import pyarrow as pa

    treap_search_bytes, treap_search.SHARD_BYTES = treap_search.SHARD_BYTES, 2000
    try:
        table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
        index = list(treap_search.index_batches(table.to_batches()))
    finally:
        treap_search.SHARD_BYTES = treap_search_bytes
    assert len(index) > 10
    block = treap_search.Block([t for _, t in ITEMS])
    df = sum(np.bincount(x["term"].to_numpy(), x["df"].to_numpy(), len(block.terms)) for x in treap_search.df_batches([b.select(["terms", "df"]) for b in index], block))
    sizes = next(treap_search.size_batches([b.select(["lengths"]) for b in index])).to_pylist()
    n, words = sizes[0]["n"], sizes[0]["words"]
    best = next(treap_search.search_batches(index, block, np.where(df > 0, treap_search.weights(df, n), 0), n, words, 5))
    assert sorted((x["slot"], -x["score"], repr(x["doc_id"])) for x in best.to_pylist()) == sorted((s, -x[3], repr(x[2])) for s, item in enumerate(ITEMS) for x in brute(rows, [item], 5))


def test_treaps_are_heaps_in_document_order():
    r = np.random.Generator(np.random.PCG64(4))
    cuts = np.array([0, 1, 1, 40, 300])
    impact = r.integers(0, 9, 300)
    t = treap_search.Treaps(cuts, impact)

    def walk(i, depth=0):
        if i < 0:
            return [], 0
        (a, da), (b, db) = walk(t.left[i]), walk(t.right[i])
        assert all(impact[x] <= impact[i] for x in a + b)
        return a + [i] + b, 1 + max(da, db)

    for root, a, b in zip(t.root, cuts, cuts[1:]):
        nodes, depth = walk(root)
        assert nodes == list(range(a, b)) and depth <= 30


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert treap_search.search(treap_search.index(none), items).count() == 0
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert treap_search.search(treap_search.index(docs), items.limit(0)).count() == 0
