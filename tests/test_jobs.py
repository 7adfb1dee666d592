"""Background jobs, one document of a run, suffix rules, exact first sightings, command line."""

import json
import time

import pytest
from pyspark.sql import functions as F

from webgauge.__main__ import main
from webgauge.functions import suffixes, urls
from webgauge.operators import scan
from webgauge.plans import service
from webgauge.plans.runner import Runner
from webgauge.sources import exports
from webgauge.sources.tables import SCHEMAS, Store, stored
from webgauge.streaming import ingest


def test_runner(spark):
    r = Runner(spark)
    assert not r.running() and not r.stop() and r.wait()

    def rounds(stop):
        n = 0
        while not stop():
            spark.range(10).count()
            n += 1
        return n

    assert r.start(rounds) and r.running()
    assert not r.start(rounds)
    time.sleep(0.5)
    assert r.stop() and r.wait(30) and r.result >= 1 and r.error is None
    assert r.start(lambda stop: 1 / 0) and r.wait(30) and isinstance(r.error, ZeroDivisionError)

    def endless(stop):
        spark.range(0, 10**15, 1, 4).select(F.sum(F.length(F.sha2(F.col("id").cast("string"), 256)))).collect()

    assert r.start(endless)
    time.sleep(2)
    assert r.interrupt() and r.wait(60) and r.error is not None
    assert r.start(lambda stop: stop()) and r.wait(30) and r.result is False


RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "// a comment", "", "deep.er.com note"]
HOSTS = ["a.com", "x.a.com", "com", "co.uk", "b.co.uk", "c.b.co.uk", "www.ck", "x.www.ck", "shop.ck", "a.shop.ck", "b.a.shop.ck", "ck", "kawasaki.jp", "a.kawasaki.jp", "b.a.kawasaki.jp", "city.kawasaki.jp", "x.city.kawasaki.jp", "10.0.0.1", "::1", "localhost", "", "deep.er.com", "a.deep.er.com", "what.ever", "a.what.ever"]


def test_suffix_rules(spark):
    rules = suffixes.rules_of(spark.createDataFrame([(x,) for x in RULES], "value string"))
    plain = frozenset(x.split()[0] for x in RULES if x and not x.startswith("//"))
    got = {x.host: x.site for x in suffixes.domains(spark.createDataFrame([(h,) for h in HOSTS + [None, "a.com"]], "host string"), rules).collect()}
    assert got == {h: urls.domain_of(h, plain) for h in HOSTS}
    rows = [("https://User@X.B.co.uk:8080/p?q#f", "b.co.uk"), ("http://[::1]:80/", "::1"), ("no address", ""), (None, ""), ("https://a.shop.ck", "a.shop.ck")]
    out = suffixes.with_sites(spark.createDataFrame(rows, "url string, want string"), "url", rules).collect()
    assert len(out) == len(rows) and all(x.site == x.want for x in out)
    plan = suffixes.with_sites(spark.createDataFrame(rows, "url string, want string"), "url", rules)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("applySchemaToPythonRDD", "")


def test_first_sightings_whenever(spark, tmp_path):
    """Repeats are dropped in the same batch, days later, and after a restart from the checkpoint."""
    import datetime

    ingest.state_on_disk(spark)
    page = lambda run, url, day: {"run_id": run, "seq": day, "url": url, "fetched_at": datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)}

    def put(name, *rows):
        spark.createDataFrame([tuple(r.get(f.strip().split()[0]) for f in NAMES) for r in rows], SCHEMAS["pages"]).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    NAMES = "run_id seq url final_url status depth content_type bytes elapsed_ms fetched_at html redirect_chain headers error".split()

    def run():
        stream = ingest.page_stream(spark, f"{tmp_path}/in/*")
        q = ingest.first_sightings(stream).select("run_id", "url", "seq").writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        q.awaitTermination()
        return sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("run_id", "url", "seq").collect())

    put("a", page(1, "u", 0), page(1, "v", 0), page(2, "u", 0), page(1, "v", 0))
    assert run() == [(1, "u", 0), (1, "v", 0), (2, "u", 0)]
    put("b", page(1, "u", 400), page(1, "w", 401))
    assert run() == [(1, "u", 0), (1, "v", 0), (1, "w", 401), (2, "u", 0)]


def test_scans(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, i int, v int").repartition(5)
    by = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    place = {x.i: x.place for x in scan.placed(df, ["g", "o", "i"], stored).collect()}
    assert place == {r[2]: n for n, r in enumerate(by)}
    within, sums, seen = {}, {}, {}
    for g, _o, i, v in by:
        n, s = seen.get(g, (0, 0))
        seen[g] = within[i], sums[i] = n + 1, s + v
    assert {x.i: x.place for x in scan.placed_within(df, ["g"], ["o", "i"], stored).collect()} == within
    assert {x.i: x.s for x in scan.running(df, ["g"], ["o", "i"], {"s": F.col("v")}, stored).collect()} == sums
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[r[2]] = total = total + r[3]
    assert {x.i: x.s for x in scan.running(df, [], [F.desc("o"), F.asc("i")], {"s": F.col("v")}, stored).collect()} == want
    none = df.limit(0)
    assert scan.placed(none, ["g"], stored).count() == scan.placed_within(none, ["g"], ["o"], stored).count() == scan.running(none, ["g"], ["o"], {"s": F.col("v")}, stored).count() == 0


@pytest.fixture(scope="module")
def crawled(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cli"))
    assert main([root, "init"]) == 0
    fake = ["--delay", "0", "--transport", "tests.test_crawling:web_get", "--resolver", "tests.test_crawling:addresses"]
    assert main([root, "crawl", "https://a.com/", "--max-pages", "9", *fake]) == 0
    return root


def test_document_and_command_line(spark, crawled, tmp_path, capsys):
    root, store = crawled, Store(spark, crawled)
    assert main([root, "version"]) == 0 and capsys.readouterr().out.strip()
    assert main([root, "ai", "1"]) == 0
    assert "no model is configured" in capsys.readouterr().out
    path = f"{tmp_path}/run.json"
    assert main([root, "export", "1", path, "--format", "document"]) == 0
    with open(path) as f:
        got = json.load(f)
    views = service.page_views(store, 1)
    assert got["run"]["run_id"] == 1 and got["run"]["status"] == "complete" and got["ai"]["calls"] == 0 and got["ai"]["skipped"] > 0
    assert [p["url"] for p in got["pages"]] == [x.url for x in views.orderBy(*exports.sort_keys("score", False)).collect()] and len(got["pages"]) == views.count() > 3
    assert got["summary"].keys() == {x for x in service.summary(store, 1).columns}
    bad = views.withColumn("url", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        exports.write_document(store.run(1), service.summary(store, 1), service.ai_block(store, 1), bad, f"{tmp_path}/bad.json")
    none = f"{tmp_path}/none.json"
    exports.write_document(store.run(1), service.summary(store, 1), service.ai_block(store, 1), views.limit(0), none)
    with open(none) as f:
        assert json.load(f)["pages"] == []
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["none.json", "run.json"]
