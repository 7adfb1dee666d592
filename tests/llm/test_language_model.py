"""The restaurants against plain Python: Stirling numbers, the seat draw, and a sampler that moves one customer at a time."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from webgauge.llm import language_model as lm
from webgauge.llm import restaurants


def stirling(c_most, d):
    s = {(0, 0): 0.0}
    for c in range(1, c_most + 1):
        for t in range(1, c + 1):
            terms = []
            if (c - 1, t - 1) in s:
                terms.append(s[c - 1, t - 1])
            if (c - 1, t) in s:
                terms.append(s[c - 1, t] + math.log(c - 1 - d * t))
            m = max(terms)
            s[c, t] = m + math.log(sum(math.exp(x - m) for x in terms))
    return s


def test_ratio_of_stirling_numbers(monkeypatch):
    s = stirling(600, 0.8)
    for c, most in ((7, 1e-9), (200, 1e-9), (256, 1e-9), (257, 0.02), (600, 0.01)):
        t = np.arange(1, c)
        got = restaurants.more_tables(np.full(c - 1, c), t, 0.8)
        want = np.array([math.exp(s[c, k + 1] - s[c, k]) for k in t])
        assert np.abs(got / want - 1).max() < most, c


@pytest.mark.parametrize("c, rest, at_parent, all_parent", [(2, 3, 4, 300), (6, 100, 900, 20_000), (90, 3000, 2000, 20_000), (5000, 90_000, 900, 20_000)])
def test_seat_draws_from_the_conditional(c, rest, at_parent, all_parent):
    words, n = 400, 6000
    k = np.arange(1, min(c, 6000))
    grown = (at_parent + k + restaurants.ROOT) / (all_parent + k + restaurants.ROOT * (words + 1))
    ratio = restaurants.more_tables(np.full(len(k), c), k) * (restaurants.STRENGTH + restaurants.DISCOUNT * (rest + k)) * grown
    log = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    p = np.exp(log - log.max())
    p /= p.sum()
    t = np.arange(1, len(p) + 1)
    mean = (p * t).sum()
    sd = math.sqrt((p * (t - mean) ** 2).sum())
    same = lambda x: np.full(n, x)
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    got = restaurants.seat(same(c), same(rest), same(at_parent), same(all_parent), words, keys, 3)
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(n) + 1e-9
    assert abs(got.std() - sd) < 0.1 * sd + 1e-9


def ordered(batches, *more):
    rows = [r for b in [*batches, *more] for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["bucket"], r["kind"]))
    return rows


def batches(rows):
    return [lm.batch_of(lm._PACKED, rows[i : i + 3]) for i in range(0, len(rows), 3)]


def swept(texts, sweeps, burn_in=2, buckets=3, hot=()):
    """Model, cells and parents after so many sweeps, by the batch functions without Spark; yields after each one."""
    docs = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([False] * len(texts))], names=["text", "held_out"])
    model = lm.Model(np.sort(np.array(hot, np.uint64)))
    step = list(lm.merge_batches(iter(batches(ordered(lm.count_batches(iter([docs]), model.hot, buckets)))), model, buckets))
    for sweep in range(-1, sweeps):
        if sweep >= 0:
            met = ordered([lm.batch_of(lm._PACKED, [r for r in rows if r["kind"] == lm.CELLS] + parents)])
            step = list(lm.sweep_batches(iter(batches(met)), SimpleNamespace(value=model), sweep, burn_in, buckets))
        rows = [r for b in step for r in b.to_pylist()]
        told = list(lm.parent_batches(iter(batches(ordered([lm.batch_of(lm._PACKED, [r for r in rows if r["kind"] == lm.WORDS])])))))
        parents = [r for b in told for r in b.to_pylist()]
        totals = [r["totals"] for r in parents if r["kind"] == lm.TOTALS]
        parents = [r for r in parents if r["kind"] == lm.PARENTS]
        model.customers[sweep] = sum(t[0] for t in totals)
        if sweep < 0:
            model.tokens, model.words = sum(t[1] for t in totals), sum(t[2] for t in totals)
        model.hot_tables[sweep] = np.zeros(len(model.hot))
        for r in rows:
            if r["kind"] == lm.RESTAURANTS:
                at = np.searchsorted(model.hot, lm.unplanes(r["contexts"], np.uint64))
                model.hot_tables[sweep][at] += lm.widened(r["tables"][0])
                if sweep < 0:
                    model.hot_counts[at] += lm.widened(r["counts"])
        yield model, [r for r in rows if r["kind"] == lm.CELLS], parents


def corpus(n, seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    return [" ".join(vocabulary[min(11, int(r.expovariate(0.35)))] if r.random() < 0.6 else "w0 w1" for _ in range(r.randint(3, 30))) for _ in range(n)]


def one_by_one(texts, sweeps, burn_in, seed=7):
    """Averaged predictive probabilities of all cells by taking out and seating single customers; tables are lists of sizes."""
    r, d, strength, root = random.Random(seed), restaurants.DISCOUNT, restaurants.STRENGTH, restaurants.ROOT
    uses = []
    for text in texts:
        w = ["<begin>", *text.split(), "<end>"]
        uses += zip(w, w[1:])
    cells = {u: [] for u in uses}
    count, of, parent, tables = Counter(uses), Counter(c for c, _ in uses), Counter(), Counter()
    words = {w for _, w in uses}

    def at_parent(w):
        return (parent[w] + root) / (sum(parent.values()) + root * (len(words) + 1))

    def seat(c, w):
        new = (strength + d * tables[c]) * at_parent(w)
        x = r.random() * (new + sum(cells[c, w]) - d * len(cells[c, w]))
        for i, n in enumerate(cells[c, w]):
            x -= n - d
            if x < 0:
                cells[c, w][i] += 1
                return
        cells[c, w].append(1)
        tables[c] += 1
        parent[w] += 1

    def leave(c, w):
        x = r.randrange(sum(cells[c, w]))
        for i, n in enumerate(cells[c, w]):
            x -= n
            if x < 0:
                cells[c, w][i] -= 1
                if n == 1:
                    del cells[c, w][i]
                    tables[c] -= 1
                    parent[w] -= 1
                return

    for u in uses:
        seat(*u)
    total = Counter()
    for sweep in range(sweeps):
        for u in uses:
            leave(*u)
            seat(*u)
        if sweep >= burn_in:
            for c, w in cells:
                total[c, w] += (count[c, w] - d * len(cells[c, w]) + (strength + d * tables[c]) * at_parent(w)) / (strength + of[c])
    return {u: x / (sweeps - burn_in) for u, x in total.items()}


def test_average_probabilities_are_those_of_a_plain_sampler():
    texts = corpus(25)
    want = one_by_one(texts, 260, 60)
    *_, (model, cells, parents) = swept(texts, 130, burn_in=20)
    got = {}
    for row in cells:
        index = lm.Index(row, [p for p in parents if p["bucket"] == row["bucket"]], model, 3)
        got |= dict(zip(index.keys.tolist(), (10**index.scores).tolist()))
    name = lambda w: {"<begin>": int(lm._BEGIN), "<end>": int(lm._END)}.get(w) or int(lm.Words(*lm.flat(pa.array([w]))).hashes[0])
    off = [got[int(lm.pairs(np.array([name(c)], np.uint64), np.array([name(w)], np.uint64))[0])] / p - 1 for (c, w), p in want.items()]
    assert len(got) == len(want)
    assert sum(map(abs, off)) / len(off) < 0.02 and max(map(abs, off)) < 0.12
    assert abs(sum(off) / len(off)) < 0.01


@pytest.mark.parametrize("shared", [False, True])
def test_probabilities_sum_to_one(shared):
    """Over all words of the vocabulary and the unseen one, in each context, also if its cells lie in several buckets."""
    texts = corpus(40)
    w0 = int(lm.Words(*lm.flat(pa.array(["w0"]))).hashes[0])
    *_, (model, cells, parents) = swept(texts, 4, hot=[w0] if shared else [])
    mass, seen, customers = {}, {}, {}
    last = max(model.customers)
    for row in cells:
        c = lm.Cells(row)
        at_parent, _ = lm.gathered([p for p in parents if p["bucket"] == row["bucket"]], c.words, 3)
        customers |= dict(zip(c.words.tolist(), at_parent.tolist()))
        t = c.tables(row["tables"][-1])
        assert ((t >= 1) & (t <= c.counts)).all() or (c.counts == 0).any()
        new = lm.STRENGTH + lm.DISCOUNT * c.totals(t, model.hot, model.hot_tables[last])
        room = lm.STRENGTH + c.totals(c.counts, model.hot, model.hot_counts)
        for k, context in enumerate(c.contexts.tolist()):
            at = c.of == k
            mass[context] = mass.get(context, 0) + (c.counts[at] - lm.DISCOUNT * t[at]).sum() / room[k]
            seen[context] = new[k] / room[k]
    p = model.parent(np.array(list(customers.values())), last)
    assert len(p) == model.words and sum(customers.values()) == model.customers[last]
    assert abs(p.sum() + model.parent(np.zeros(1), last)[0] - 1) < 1e-9
    assert all(abs(mass[c] + seen[c] - 1) < 1e-9 for c in mass)
    if shared:
        assert sum(w0 in lm.Cells(row).contexts.tolist() for row in cells) > 1


def test_questions_stream_past_the_cells(monkeypatch):
    """A bucket's questions are answered while they are read: never more than a buffer and a row of them is held."""
    monkeypatch.setattr(lm, "BUFFER", 4000)
    *_, (model, cells, parents) = swept(corpus(10), 1, burn_in=0, buckets=1)
    key = lm.Cells(cells[0]).pairs()[0]
    one = lambda k: lm.batch_of(
        lm._PACKED, [{"bucket": 0, "kind": lm.ASKED, "ids": lm.planes(np.array([k], np.int64)), "counts": lm.planes(np.array([250], np.int32)), "keys": np.full(250, key, np.uint64).tobytes()}]
    )
    read, most, answered = 0, 0, 0

    def questions():
        nonlocal read
        yield lm.batch_of(lm._PACKED, parents + cells)
        for k in range(40):
            read += 1
            yield one(k)

    for batch in lm.answer_batches(questions(), SimpleNamespace(value=model), 1):
        most = max(most, read - answered)
        answered += sum(len(lm.unplanes(r["ids"], np.int64)) for r in batch.to_pylist())
    assert answered == 40 and most <= 4
