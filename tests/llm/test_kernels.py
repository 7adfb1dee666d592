"""The numpy kernels inside tasks, on drawn inputs."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webgauge.llm import packing, suffix_dedup, textarrays, tokens, warc
from webgauge.llm.textarrays import Words, covered, flat, slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢\n\t ", max_size=30)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_windows(texts, n):
    w = Words(*flat(pa.array(texts, pa.string())), lower=True)
    want = [(t or "").encode().replace(b"B", b"b").split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    assert [w.text[a:b].tobytes() for a, b in zip(w.begin, w.end)] == [x for y in want for x in y]
    at, keys = w.windows(n)
    windows = [(tuple(x[i : i + n])) for x in want for i in range(len(x) - n + 1)]
    assert len(at) == len(windows)
    seen = {}
    for k, win in zip(keys.tolist(), windows):
        assert seen.setdefault(k, win) == win
    assert len(seen) == len(set(windows))


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_slices_cover_a_batch(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
    parts = list(slices(batch, 1, limit))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    for p in parts:
        assert p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= limit
        text, offsets = flat(p.column(1))
        assert [text[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in p.column(1).to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_packed_ids_and_homes(ids):
    x = np.repeat(np.array(ids, np.int64), 2)
    assert packing.unpack_ids(*packing.pack_ids(x)).tolist() == x.tolist()
    assert all(0 <= h < 7 for h in packing.home(x, 7).tolist())


def test_home_is_the_same_in_sql(spark):
    ids = [0, 1, -1, 5, 2**62, -(2**63), 2**63 - 1, 123456789]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", packing.home_column(F.col("i"), 13).alias("h")).collect()
    assert [r.h for r in rows] == packing.home(np.array([r.i for r in rows], np.int64), 13).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=8), st.integers(1, 6), st.integers(31, 40))
def test_covered(starts, length, n):
    want = [any(s <= i < s + length for s in starts) for i in range(n)]
    assert covered(np.array(starts, np.int64), length, n).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=9, max_size=9), min_size=1, max_size=40))
def test_blind_trie(strings):
    trie = suffix_dedup.BlindTrie(9)
    for i, s in enumerate(strings):
        trie.insert(s.encode(), i)
    groups = list(trie.ordered())
    assert [strings[g[0]] for g in groups] == sorted(set(strings))
    assert all(len({strings[i] for i in g}) == 1 for g in groups) and sum(map(len, groups)) == len(strings)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcd", max_size=12), min_size=1, max_size=20), st.permutations(["a b", "b c", "ab c", "c d", "a a", "aa a", "aa aa", "cd ab", "abc d"]))
def test_merges_against_one_at_a_time(words, order):
    """The lowest-ranked pair, leftmost first, as long as one is ranked; merges use only symbols made before."""
    known, merges = set("abcd"), []
    for pair in order:
        a, b = pair.split()
        if a in known and b in known:
            merges.append([a, b])
            known.add(a + b)
    model = {"model": {"type": "BPE", "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []}
    ranks = {tuple(p): i for i, p in reversed(list(enumerate(merges)))}

    def plain(word):
        s = list(word)
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
            if not pairs:
                return len(s)
            _, i = min(pairs)
            s[i : i + 2] = [s[i] + s[i + 1]]

    assert tokens.Merges(model).count([w.encode() for w in words]).tolist() == [plain(w) for w in words]


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60), st.one_of(st.none(), st.integers(0, 9)))
def test_warc_record_parses_back(html, refers_to):
    html = html.encode("utf-8", "ignore").decode()
    text = warc.record(7, "http://e.com/", html, refers_to, warc.DATE).encode() + warc.END
    size, fields = warc.parse(text[len(warc.MAGIC) :])
    assert size == len(text) and fields["valid"] and fields["page_id"] == 7 and fields["refers_to"] == refers_to
    assert fields["payload_bytes"] == len(html.encode()) and fields["payload_digest"] == warc.digest(html.encode())


def test_short_ways_give_the_same():
    """Words of one lane, marks of white space and lower case have short ways; hashes are those of the long way."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 256, 4000, dtype=np.uint8)
    begin = rng.integers(0, 3950, 2000)
    size = rng.integers(0, 40, 2000)
    got = textarrays.span_hashes(text, begin, begin + size)[0]
    assert (got == textarrays.span_hashes(text, begin, begin + size, True)[0]).all()
    every = np.arange(256, dtype=np.uint8)
    assert (textarrays.spaces(every) == textarrays.SPACE).all() and (textarrays.lowered(every) == textarrays.LOWER).all()
