"""Tables with further columns of any name, null ids, texts over a slice, and empty tables, through every stage."""

import random

import pytest

from tests.llm import brute
from tests.llm.test_operators import corpus
from webgauge.llm import minhash, quality, substring_dedup, suffix_dedup

CLASHING = "_id _hash _tag _kept _gone _bad_id _bad_hash row key tag cut_id cut_tag cut_text gone_0 gone_1 key_0 key_1 node component first band bucket kind size target row_number".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = corpus(4)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows]
    items = [("b1", " ".join(dict(rows)[2].split()[:12])), (None, None), ("b2", "")]
    more = "".join(f", {c} string" for c in CLASHING)
    out = {}
    for name, docs, bench in (
        ("plain", spark.createDataFrame(full, schema), items),
        ("clashing", spark.createDataFrame([r + ("x",) * len(CLASHING) for r in full], schema + more), items),
        ("empty", spark.createDataFrame([], schema), items),
        ("no_benchmark", spark.createDataFrame(full, schema), []),
    ):
        path = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
        out[name] = path
    return out


def staged(spark, path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    return sorted(map(repr, docs.select("doc_id", "text", "n_chars").collect())), sorted(map(repr, last.collect()))


def test_stages_with_clashing_columns(spark, tables):
    plain = staged(spark, tables["plain"])
    assert plain[0] and staged(spark, tables["clashing"]) == plain
    assert any("doc_id=None" in r for r in plain[0])


def test_stages_on_empty_tables(spark, tables):
    assert staged(spark, tables["empty"]) == ([], [])
    texts = {r for r in staged(spark, tables["no_benchmark"])[0]}
    assert texts >= set(map(repr, spark.read.parquet(f"{tables['plain']}/benchmark_leaks").select("doc_id", "text", "n_chars").collect()))


def test_texts_over_a_slice(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(30_000)}" for _ in range(210_000)]  # about 1.3 MB
    rows = [(1, " ".join(words)), (2, " ".join(words[:200_000] + ["end"])), (3, " ".join(words[150_000:150_080])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: sorted(map(repr, map(tuple, x)))
    assert key(substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == key(brute.op4(rows))
    assert key(suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == key(brute.op1(rows))
    assert key(minhash.near_duplicates(docs, n=4).collect()) == key(brute.op5(rows, 4))
    assert key(quality.report(docs).select("doc_id", *quality.MEASURES).collect()) == key(brute.op6(rows))
