"""Texts that collide under every polynomial modulo 2**64: words or bytes in Thue-Morse order, and with the symbols swapped."""

import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.test_operators import expected, got
from webgauge.llm import language_model, minhash, substring_dedup, suffix_dedup
from webgauge.llm.textarrays import Words, flat


def morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


A, B = "".join(morse(2048)), "".join(morse(2048, "b", "a"))


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_words_and_windows():
    w = Words(*flat(pa.array([A, B, " ".join(morse(4096)), " ".join(morse(4096, "b", "a"))])))
    assert w.hashes[0] != w.hashes[1]
    _, keys = w.windows(2048)
    assert len(set(keys.tolist())) > 4000  # windows of one order are all different but for few


def test_substring_windows(frame):
    common = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(common[:30] + [A] + common[31:])), (2, " ".join(common[:30] + [B] + common[31:])), (3, " ".join(common[:30] + [A] + common[31:]))]
    assert got(substring_dedup.dedup(frame(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")) == expected(brute.op4(rows))


def test_near_duplicates(frame):
    rows = [(1, A), (2, B), (3, A)]
    assert got(minhash.near_duplicates(frame(rows), n=4)) == expected(brute.op5(rows))


def test_stretches(frame):
    head, gram = "commonheadofallthesetexts", "thefrequentgramofitall!!!"
    one, two = "x1y2z3a4b5c6d7e8f9g0hijkl", "m1n2o3p4q5r6s7t8u9v0wxyzz"
    rows = [(i, head + gram + "".join(morse(1024, *blocks))) for i, blocks in ((1, (one, two)), (2, (two, one)))]
    rows += [(3, gram + "q" * 60), (4, "z" * 60 + gram)]
    assert got(suffix_dedup.dedup(frame(rows))) == expected(brute.op1(rows))


def test_known_tokens(frame):
    from pyspark.sql import functions as F

    rows = [(1, A), (2, B), (3, A)]
    told = {x.doc_id: x.n_known for x in language_model.score(frame(rows), F.col("doc_id") == 2).collect()}
    assert told == {1: 2, 2: 1, 3: 2}


def test_second_hashes():
    """Two windows that share a key are told apart by their checks, wherever they stand among equal keys."""
    import numpy as np

    keys, checks, ids = np.array([7, 7, 7, 9, 9], np.uint64), np.array([3, 1, 3, 5, 4], np.uint64), np.array([5, 6, 4, 2, 8])
    index = substring_dedup.reduced(keys, checks, ids, ids)
    assert [x.tolist() for x in index] == [[7, 7, 9, 9], [1, 3, 4, 5], [6, 4, 8, 2], [6, 5, 8, 2]]
    asked = np.array([7, 7, 7, 7, 9, 9, 9, 8], np.uint64), np.array([0, 1, 2, 3, 4, 5, 6, 1], np.uint64)
    at, hit = substring_dedup.places(index, *asked)
    assert hit.tolist() == [False, True, False, True, True, True, False, False]
    assert at[hit].tolist() == [0, 1, 2, 3]
    texts = flat(pa.array(["a bb ccc a bb ccc ddddddddddd", "a bb", None]))
    w = Words(*texts)
    _, first = w.windows(2)
    _, second = w.windows(2, checks=True)
    assert len(set(zip(first.tolist(), second.tolist()))) == 4 and first[0] == first[3] == first[-1] and second[0] == second[3] == second[-1]
    assert not set(first.tolist()) & set(second.tolist())
