import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from webgauge.llm import decontam, language_model, minhash, mixing, quality, substring_dedup, suffix_dedup, tokens, toxicity, warc
from webgauge.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kind int, hash long, node long, size long, key string"


def corpus(seed=5):
    """Random texts with shared passages, near and exact copies, nulls, empties, repeats, a long and a periodic text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = say(70), say(150)
    rows = [(i, " ".join(say(r.randint(1, 120)))) for i in range(0, 60, 2)]
    for i in range(61, 75):
        rows.append((i, " ".join(say(r.randint(0, 30)) + passage[r.randint(0, 9) :] + say(r.randint(0, 30)))))
    for i in range(80, 120):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, (" " if i % 3 else "\n").join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (202, "ab " * 300), (203, "xab " * 300), (204, "ab " * 400)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, rows[3][1]), (None, None), (303, "One"), (304, "one"), (-5, " ".join(say(3000))), (305, "| " * 40 + "#$%\n" * 6)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, "en", f"s{(d or 0) % 4}" if d != 303 else None, len(t or ""), 1, 2, 3, 4, 5, "k") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(map(repr, (tuple(r) for r in (df.select(*columns) if columns else df).collect())))


def expected(rows):
    return sorted(map(repr, rows))


def test_suffix_dedup(docs, rows, empty):
    assert got(suffix_dedup.dedup(docs)) == expected(brute.op1(rows))
    assert suffix_dedup.dedup(empty).count() == 0


def test_deep_shallow_orders_suffixes():
    import numpy as np

    r = random.Random(1)
    data = np.frombuffer(("".join(r.choice("ab") for _ in range(300)) + "abab" * 60 + "".join(r.choice("ab") for _ in range(60))).encode(), np.uint8)
    starts = np.arange(len(data) - 50)
    order, group = suffix_dedup.deep_shallow(data, starts, 50)
    strings = [data[s : s + 50].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    equal = [strings[order[i]] == strings[order[i - 1]] for i in range(1, len(order))]
    assert equal == [group[i] == group[i - 1] for i in range(1, len(group))]


def test_substring_dedup(docs, rows, empty):
    assert got(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected(brute.op4(rows))
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_as_a_stage(docs, rows):
    kept = {(r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect()}
    for (doc, text), (_, u, gone) in zip(rows, brute.repeats(rows, lambda t: brute.WORD.findall(t or ""), 50)):
        left = " ".join(w for w, g in zip(u, gone) if not g)
        assert ((doc, text) in kept) if not any(gone) else ((doc, left) in kept) == bool(left)


@pytest.mark.parametrize("n", [4, 5])
def test_minhash(docs, rows, empty, n):
    assert got(minhash.near_duplicates(docs, n=n)) == expected(brute.op5(rows, n))
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_in_a_large_group(spark):
    """Many copies with more and more edits: links within the group are found though most pairs have none."""
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(330):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4)) == expected(brute.op5(rows))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 300), (300, 200), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 200, 300)}


def test_quality_measures(docs, rows, empty):
    assert got(quality.report(docs), "doc_id", *quality.MEASURES) == expected(brute.op6(rows))
    for r in quality.report(docs).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.report(empty).count() == 0


def test_quality_estimates_accuracies():
    """Votes drawn from known accuracies: the estimate tells good from bad nearly as well as the truth would."""
    from collections import Counter

    r = random.Random(2)
    good, bad = [0.95, 0.9, 0.97, 0.85], [0.9, 0.8, 0.6, 0.7]
    drawn = []
    for _ in range(6000):
        is_good = r.random() < 0.85
        drawn.append((is_good, tuple(0 if r.random() < 0.1 else (1 if is_good else -1) * (1 if r.random() < (g if is_good else b) else -1) for g, b in zip(good, bad))))
    e = quality.estimate(sorted(Counter(v for _, v in drawn).items()), 4)
    assert all(abs(a - b) < 0.05 for a, b in zip(e["good"], good))
    right = sum((quality.log_odds(v, e["prior"], e["good"], e["bad"]) >= 0) == g for g, v in drawn) / len(drawn)
    assert right > 0.96


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in quality.report(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) > 0.95 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) > 0.6 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_quality_as_a_stage(docs):
    kept = got(quality.report(docs).where("kept"), "doc_id")
    assert got(quality.keep_good(docs), "doc_id") == kept


def test_decontamination(spark, docs, rows, empty):
    texts = dict(rows)
    items = [("q1", " ".join(texts[2].split()[:25]) + "!"), ("q2", " ".join(texts[4].split()[2:30]).upper()), ("q3", "One"), (None, " ".join(texts[6].split()[:14])), ("q5", None), ("q6", "?!"), ("q1b", " ".join(texts[2].split()[3:20]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert got(decontam.digest(docs, bench)) == expected(brute.op8(rows, items))
    long = [i for i in items if i[0] != "q3"]
    assert got(decontam.digest(docs, bench.where("item_id is null or item_id <> 'q3'"))) == expected(brute.op8(rows, long))
    dirty = expected([(r[0],) for r in brute.op8(rows, items) if not r[5]])
    assert got(decontam.decontaminate(docs, bench), "doc_id") == dirty
    assert decontam.digest(empty, bench).count() == 0
    assert got(decontam.digest(docs, bench.limit(0)), "doc_id", "n_hit") == expected([(d, 0) for d, _ in rows])


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    items = [(str(d), t) for d, t in rows[:8]]
    monkeypatch.setattr(decontam, "BLOCK", 40)
    assert got(decontam.digest(docs, spark.createDataFrame(items, "item_id string, text string"))) == expected(brute.op8(rows, items))


def test_decontamination_in_blocks_of_bytes(spark, docs, rows, monkeypatch):
    """Items with one id, an n-gram that all items share, and one of words longer than a block."""
    texts, long = dict(rows), " ".join(c * 3000 for c in "abcdefghij")
    items = [(f"i{i % 5}", f"{texts[2]} {i}") for i in range(20)] + [("long", long), ("long", None), (None, texts[4])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    more = [*rows, (900, f"x {long} y"), (901, f"{texts[2]} {texts[4]}"), (901, f"{texts[2]} {texts[4]}")]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 8000)
    grams, ids = decontam.benchmark_windows(bench, 10)
    blocks = decontam.block_count(grams)
    assert blocks > 4 and ids.count() > grams.count()
    sizes = [r.b for r in grams.groupBy(F.pmod("hash", F.lit(blocks))).agg(F.sum("bytes").alias("b")).collect()]
    assert max(sizes) <= 8000 + 31000
    found = decontam.digest(spark.createDataFrame(more, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.n_hit) for r in found.collect()} == {(r[0], r[2]) for r in brute.op8(more, [(i, t) for i, t in items if t])}
    whole = [r for r in found.collect() if r.doc_id == 901]
    assert len(whole) == 2 and all(r.n_items == 5 and r.items_sha256 == hashlib.sha256(b"i0,i1,i2,i3,i4").hexdigest() for r in whole)
    assert [r.n_items for r in found.collect() if r.doc_id == 900] == [1]


def test_mix_where_a_third_of_all_rows_share_an_id(spark):
    """Rows without an id draw alike, so the target is crossed among them; no task may order them all."""
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 30), "s" if i % 3 else "t") for i in range(900)] + [(None, "w " * (1 + i % 7), "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, weights=(3, 2), seed=5)
    got_rows = out.collect()
    assert len(got_rows) == len(rows)
    for source in ("s", "t"):
        v = [x for x in got_rows if x.source == source]
        assert abs(sum(x.taken for x in v) - v[0].target) <= max(x.size for x in v)
    again = mixing.mix(docs.repartition(7), weights=(3, 2), seed=5).collect()
    assert sorted(map(repr, got_rows)) == sorted(map(repr, again))


def test_mix(docs, rows, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for source, v in by.items():
        assert all(r.taken == r.copies * r.size and r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9 for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v), source
    assert got(mixing.sample(docs)) == got(mixing.sample(docs.repartition(5)))
    assert mixing.sample(empty).count() == 0


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a stops at 30; the rest, 1480, goes by weights 2, 1 (and 0 for the source without words)
    assert t["a"] == 30 and t[None] == 0 and abs(t["b"] - 1480 * 2 / 3) < 1e-9 and abs(t["c"] - 1480 / 3) < 1e-9


def test_language_model(spark, docs, rows, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = language_model.score(docs, held).collect()
    az = brute.AZ
    toks = [(d, brute.WORD.findall((t or "").translate(az)) + [None]) for d, t in rows]
    is_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    from collections import Counter
    from math import log10

    c = Counter(w for d, ws in toks if not is_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), is_out(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in toks)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    again = {(r.doc_id, round(r.score, 4)) for r in language_model.score(docs.repartition(2), held).collect()}
    assert again == {(r.doc_id, round(r.score, 4)) for r in out}
    assert language_model.score(empty, held).count() == 0
    assert all(r.score == 0 for r in language_model.score(docs, F.lit(True)).collect())  # the one unseen word has all the mass


def test_tokens(spark, docs, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = ["a", "aa", "the ", "  ", "\n", "\t", "\x1c", "\x85", "​", "é", "漢", "½", "²", "<|endoftext|>", "'s", "'S", "!!", "́", "😀", "\x00", "　", "\r\n"]
    extra = [(1000 + i, "".join(r.choice(odd) for _ in range(r.randint(0, 40)))) for i in range(400)] + [(2000, "a" * 3000), (2001, "ab" * 2000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows + extra]
    assert got(tokens.count_tokens(every, P.path("byte_bpe_50k.json"))) == expected([(*x, x[2] > 1024) for x in want])


def test_tokens_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        tokens.Merges({"model": {"type": "WordPiece"}})


def test_suffix_buckets_of_a_hot_passage(monkeypatch):
    """Different text around a shared passage: its suffixes are spread over the buckets, and what is found stays the same."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from webgauge.llm.packing import unpack_ids

    sd = suffix_dedup
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(120)
    texts = [noise(60) + passage + noise(60) for _ in range(300)]

    def in_order(batches, schema, *more):
        rows = sorted([x for b in batches for x in b.to_pylist()] + list(more), key=lambda x: (x["bucket"], x["kind"]))
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(hot):
        monkeypatch.setattr(sd, "HOT_STRETCHES", hot, raising=False)
        docs = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, k + 50), pa.int64()), "text": texts[k : k + 50]}) for k in range(0, 300, 50)]
        met = in_order((x for d in docs for x in sd.meet_batches(iter([d]), 50, 16)), sd._MEET)
        homes = sd.home(np.arange(300), 16).tolist()
        rows = [{"bucket": h, "kind": 1, "doc_id": i, "text": t} for i, (h, t) in enumerate(zip(homes, texts))]
        schema = pa.schema([*(sd._MEET.field(c) for c in ("bucket", "kind", "ids", "counts", "keys", "flags")), ("doc_id", pa.int64()), ("text", pa.string())])
        step = [x for b in sd.send_batches(iter([in_order(sd.reply_batches(iter([met]), 16), schema, *rows)]), 50, 16) for x in b.to_pylist()]
        sent = in_order([], sd._STEP, *(x for x in step if x["kind"] == sd.STRETCH))
        load = Counter()
        for x in sent.to_pylist():
            load[x["bucket"]] += int((np.frombuffer(x["lengths"], np.int64) - 49).sum())
        gone = {(x["doc_id"], int(w)) for x in step if x["kind"] == sd.OPEN for a, b in np.frombuffer(x["repeats"], np.int64).reshape(-1, 2) for w in range(a, b + 1)}
        for x in (x for b in sd.sort_batches(iter([sent]), 50, 16) for x in b.to_pylist()):
            gone |= set(zip(unpack_ids(x["ids"], x["counts"]).tolist(), np.frombuffer(x["starts"], np.int64).tolist()))
        return load, gone

    load, gone = run(64)
    assert gone == {(d, w) for d in range(1, 300) for w in range(60, 131)} | {x for x in gone if x[1] in (*range(50, 60), *range(131, 141))}
    assert max(load.values()) < 3 * sum(load.values()) / 16
    assert gone == run(10**9)[1]


def test_toxicity_on_held_out_rows(spark, docs, empty):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = toxicity.severity(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = toxicity.score(every, toxicity.fit(every, train)).join(test, "doc_id").collect()
    clean, toxic = [r for r in scored if r.grade == 0], [r for r in scored if r.grade > 0]
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    assert sum(r.toxic for r in toxic) >= 0.4 * len(toxic)
    assert all(0 <= r.expected_severity <= 2 and (r.severity > 0) == r.toxic for r in scored)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(empty, nothing).count() == 0


def test_toxicity_of_inflected_stems(spark):
    """Held-out rows of each language of sf0.1: most of them share no whole word with the training rows' toxic ones."""
    every = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = toxicity.severity(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = toxicity.fit(every, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score(every, model).join(labels.where("doc_id % 2 = 1"), "doc_id").join(every.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        clean, toxic = ([r for r in scored if r.lang == lang and (r.grade > 0) == bad] for bad in (False, True))
        assert sum(r.toxic for r in toxic) >= 0.75 * len(toxic), lang
        assert sum(r.toxic for r in clean) <= 0.02 * len(clean), lang


def test_toxicity_thresholds_are_ordered(spark, docs):
    labels = docs.select("doc_id", (F.coalesce(F.col("doc_id"), F.lit(0)) % 4).cast("int").alias("grade"))
    t = toxicity.fit(docs, labels).thresholds
    assert len(t) == 3 and list(t) == sorted(t)


def test_warc_round_trip(spark, empty):
    inner = warc.record(99, "http://x/", "<p>inner</p>", None, warc.DATE) + "\r\n\r\n"
    pages = [(1, "http://a/1", "<p>é漢</p>"), (2, None, None), (3, "http://a/3", ""), (4, "http://a/4", "<p>é漢</p>"), (5, "a\r\nb", "x"), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", inner), (8, "u", inner + inner + "tail"), (9, "u", inner), (None, "u", "no id"), (10, "u", "y" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    want = []
    best = {}
    for p, _, h in pages:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    for p, _, h in pages:
        b = (h or "").encode()
        again = p is not None and p < best[h or ""]
        want.append((p, len(b), warc.digest(b), "revisit" if again else "response", best[h or ""] if again else None, True))
    assert got(warc.round_trip(df)) == expected(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_in_small_splits(spark):
    """Chains that run across the splits of a file."""
    pages = spark.range(120).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("WARC/1.1\r\n"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 30)).alias("html")).coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = warc.round_trip(pages)
        assert out.where("valid and record_type = 'response' and payload_bytes = 1930").count() == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_toxicity_fitted_on_repeated_and_null_rows(spark):
    """A model fitted on rows that repeat ids, in any order of partitions, is the same, and scores equal texts alike."""
    r = random.Random(6)
    say = lambda bad: " ".join(r.choice(["vile", "nasty", "foul"]) if bad and r.random() < 0.3 else f"w{r.randrange(200)}" for _ in range(60))
    rows = [(i, say(i % 3 == 0)) for i in range(240)]
    rows += [(3, "another text of that id"), (3, rows[3][1]), (None, rows[0][1]), (500, None), (501, ""), (502, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (7, None), (500, 0)], "doc_id long, grade int")
    scored = lambda d: sorted(((repr(x.doc_id), x.n_words, round(x.expected_severity, 9), x.toxic) for x in toxicity.score(docs, toxicity.fit(d, labels)).collect()))
    once = scored(docs.repartition(1))
    assert once == scored(docs.repartition(5)) and len(once) == len(rows)
    of = {}
    for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect():
        of.setdefault(x.doc_id, set()).add(x.expected_severity)
    assert of[0] == of[None] == of[502] and len(of[3]) == 2 and of[500] == of[501]
    found = {x[0] for x in once if x[3]}
    assert len({str(i) for i in range(0, 240, 3)} & found) > 76 and not {str(i) for i in range(240) if i % 3} & found
