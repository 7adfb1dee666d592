import random

from tests.llm import brute
from tests.llm.test_operators import corpus
from webgauge.llm import mixing, quality


def test_pipeline_against_plain_steps(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    rows = [(d, t) for d, t in corpus(9) if d is not None]
    clean = [" ".join(r.choice("lorem ipsum dolor sit amet magna aliqua enim minim veniam".split()) + r.choice(["", "us", "um", "a"]) + r.choice("bcdfgh") for _ in range(90)) for _ in range(40)]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    rows += [(1100 + i, t.rsplit(" ", 1)[0] + " end") for i, t in enumerate(clean[:8])]
    items = [("b1", " ".join(clean[3].split()[10:30])), ("b2", " ".join(clean[20].split()[:14]))]
    full = [(d, t, "en", f"s{d % 3}" if d % 7 else None, len(t or "")) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "source_mix":
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")

    texts = lambda name: sorted((r.doc_id, r.text) for r in seen[name])
    report = quality.report(spark.createDataFrame(full, schema)).where("kept").collect()
    ids = {r.doc_id for r in report}
    now = sorted((d, t) for d, t in rows if d in ids)
    assert texts("quality_rules") == now and {1000 + i for i in range(40)} <= ids

    kept = {d for d, _, _, k in brute.op5(now, 5) if k}
    now = [(d, t) for d, t in now if d in kept]
    assert texts("near_dedup") == sorted(now)

    cut = []
    for (d, t), (_, u, gone) in zip(now, brute.repeats(now, lambda t: brute.WORD.findall(t or ""), 50)):
        left = " ".join(w for w, g in zip(u, gone) if not g)
        if not any(gone) or left:
            cut.append((d, left if any(gone) else t))
    assert texts("substring_repeats") == sorted(cut)
    assert all(r.n_chars == len(r.text) for r in seen["substring_repeats"])

    dirty = {r[0] for r in brute.op8(cut, items) if r[5]}
    now = [(d, t) for d, t in cut if d not in dirty]
    assert texts("benchmark_leaks") == sorted(now) and {1003, 1020} & dirty

    mix = seen["source_mix"]
    assert sorted((r.doc_id, r.size) for r in mix) == sorted((d, len(brute.WORD.findall(t))) for d, t in now)
    total = sum(r.size for r in mix)
    assert abs(sum(r.taken for r in mix) - total) <= 4 * max(r.size for r in mix)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix))
    assert mixing.sample(docs.sparkSession.read.parquet(f"{tmp_path}/benchmark_leaks")).count() == len(mix)
