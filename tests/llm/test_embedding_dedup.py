import numpy as np
import pytest

from webgauge.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, no long, ball long, size int, block string"


def brute(rows, cosine=0.93):
    good = [r[1] is not None and r[2] is not None and r[0] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {i: set() for i in range(len(rows))}
    for key in {(r[2], len(r[1])) for r, ok in zip(rows, good) if ok}:
        own = [i for i, r in enumerate(rows) if good[i] and (r[2], len(r[1])) == key]
        x = np.array([np.float32(rows[i][1]) for i in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[own[a]].add(own[b])
    least = {}
    for i in links:
        if i in least:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        least.update(dict.fromkeys(group, low))
    return sorted((repr(rows[i][0]), len(links[i]), repr(least[i]), rows[i][0] == least[i]) for i in links)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(3)


def told(spark, rows):
    return sorted((repr(x.vec_id), x.n_links, repr(x.component_id), x.kept) for x in embedding_dedup.near_duplicates(frame(spark, rows)).collect())


def around(g, center, n, noise):
    x = center + noise * g.standard_normal((n, len(center))) / np.sqrt(len(center))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    g = np.random.Generator(np.random.PCG64(7))
    unit = lambda d=32: (x := g.standard_normal(d)) / np.linalg.norm(x)
    parts = [(g.standard_normal((900, 32)).astype(np.float32), 1)]
    parts += [(around(g, unit(), 3, 0.2), 1) for _ in range(60)]  # pairs about the threshold and above it
    parts += [(around(g, unit(), 700, 0.05), 1)]  # near copies, more than a window has
    parts += [(around(g, c := unit(), 40, 0.25), 2), (around(g, c, 40, 0.05), 2), (around(g, c, 5, 0.25), 1)]
    same = unit().astype(np.float32)
    parts += [(np.repeat(same[None], 50, 0), 1), (np.repeat(same[None] * 2, 3, 0), 1), (same[None], 2)]
    out, no = [], 0
    for x, label in parts:
        for v in x:
            out.append((int(no * 7919 % 100003), v.tolist(), label))
            no += 1
    nan, inf = float("nan"), float("inf")
    one = same.tolist()
    out += [(200001, None, 1), (200002, [], 1), (200003, [0.0] * 32, 1), (200004, [None, *one[1:]], 1), (200005, [nan, *one[1:]], 1), (200006, [inf, *one[1:]], 1), (200007, one, None), (None, one, 1), (200008, one[:5], 1), (200009, one[:5], 1), (200010, [1e30] + [0.0] * 31, 3), (200011, [1e-30] + [0.0] * 31, 3), (out[0][0], one, 1)]
    return out


def test_links_against_brute_force(spark, rows):
    assert told(spark, rows) == brute(rows)


def test_wide_group_larger_than_a_window(spark):
    """Members that no ball holds: the windows miss most pairs, tiles of the long runs find the rest."""
    g = np.random.Generator(np.random.PCG64(8))
    center = g.standard_normal(64) / 8
    rows = [(i, v.tolist(), 1) for i, v in enumerate(around(g, center, 900, 0.27))]
    plain, found = brute(rows), told(spark, rows)
    assert sum(x[1] for x in found) >= 0.995 * sum(x[1] for x in plain)
    assert all(a[1] <= b[1] for a, b in zip(found, plain)) and [x[2:] for x in found] == [x[2:] for x in plain]


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among many others: at least nine of ten, as it is about all of them."""
    g = np.random.Generator(np.random.PCG64(9))
    x = g.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = g.standard_normal(x[:1000].shape)
    o -= (o * x[:1000]).sum(1)[:, None] * x[:1000]
    o /= np.linalg.norm(o, axis=1)[:, None]
    near = 0.931 * x[:1000] + np.sqrt(1 - 0.931**2) * o
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    plain, found = brute(rows), told(spark, rows)
    assert sum(x[1] for x in found) >= 0.99 * sum(x[1] for x in plain) >= 1900


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
