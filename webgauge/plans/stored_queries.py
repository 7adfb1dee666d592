"""Queries over what is written and read back: the store, exports, streams, sitemaps and robots files, enrichment; with their SQL.

Every query works on the whole of the derived runs or of a given table, in a store of its own in the shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions import policy, robots, text
from webgauge.operators import audit as A
from webgauge.operators import diff as D
from webgauge.operators import enrich as E
from webgauge.operators import graph as G
from webgauge.operators import summary as S
from webgauge.operators import views as W
from webgauge.plans.oracles import _SUGGEST, _WEAK, FACTS, ISSUES, over
from webgauge.plans.snapshot import Snapshot
from webgauge.sources import exports, sitemaps
from webgauge.sources.tables import Store, shared_dir, stored
from webgauge.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Snapshot(spark, sf_dir))
        SQL[name] = sql
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_store(spark: SparkSession) -> Store:
    store = Store(spark, folder(spark, "store"))
    store.init()
    return store


def page_rows(s: Snapshot) -> DataFrame:
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in s.spark.createDataFrame([], "content_type string, fetched_at timestamp, error string").schema}
    p = s.pages()
    return p.select("*", *(none[k] for k in none if k not in p.columns))


@add("m03_inserted_once", over(FACTS, "SELECT run_id, url, seq, status::INT AS status FROM p"))
def _(s):
    """A page that is there already stays as it was, whatever comes with its address later."""
    store, pages = new_store(s.spark), page_rows(s)
    store.insert_ignore("pages", pages.where("run_id = 1"))
    store.insert_ignore("pages", pages.withColumn("status", F.when(c("run_id") == 1, 599).otherwise(c("status"))))
    return store.read("pages").select("run_id", "url", "seq", "status")


@add("m04_replaced_runs", over(ISSUES, "SELECT run_id, page_seq, rule_ord, url, rule_id FROM i WHERE run_id = 1 OR severity = 'warning'"))
def _(s):
    """A run's issues are replaced as a whole, and the other run's stay; twice is as good as once."""
    store, found = new_store(s.spark), A.issues(s.audit())
    store.replace_runs("issues", found)
    for _twice in range(2):
        store.replace_runs("issues", found.where("run_id = 2 and severity = 'warning'"))
    return store.read("issues").select("run_id", "page_seq", "rule_ord", "url", "rule_id")


@add("m05_upserted_cache", over(FACTS, "SELECT url AS key, CASE WHEN max(run_id) = 2 THEN 'rejected' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY url"))
def _(s):
    """The later row of a key wins; keys are the pages' addresses."""
    store = new_store(s.spark)
    entry = lambda run, status: s.pages().where(c("run_id") == run).select(c("url").alias("key"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.lit(status).alias("status"))
    for run, status in ((1, "ok"), (2, "rejected")):
        store.upsert("ai_cache", entry(run, status))
    runs = s.pages().groupBy(c("url").alias("key")).agg(F.count("*").alias("n"))
    return store.read("ai_cache").join(runs, "key").select("key", "status", "n")


@add("m06_appended_calls", over(ISSUES, f"{_SUGGEST} SELECT run_id, count(*) * 2 AS calls, (sum(prompt_tokens) * 2)::BIGINT AS prompt_tokens FROM ca GROUP BY run_id"))
def _(s):
    store, calls = new_store(s.spark), s.calls(s.audit())
    for _twice in range(2):
        store.write("ai_calls", calls.withColumn("created_at", F.lit(None).cast("timestamp")))
    return store.read("ai_calls").groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))


@add("m08_deleted_run", over(FACTS, "SELECT 'pages' AS kind, run_id, count(*) AS n FROM p WHERE run_id = 2 GROUP BY run_id UNION ALL SELECT 'links', run_id, count(*) FROM e WHERE run_id = 2 GROUP BY run_id UNION ALL SELECT 'sitemap_urls', run_id, count(*) FROM s WHERE run_id = 2 GROUP BY run_id"))
def _(s):
    """A deleted run takes its rows in all tables with it."""
    store = new_store(s.spark)
    for table, rows in (("pages", page_rows(s)), ("links", s.links()), ("sitemap_urls", s.sitemap())):
        store.insert_ignore(table, rows)
    store.delete_run(1)
    counts = [store.read(t).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "run_id", "n") for t in ("pages", "links", "sitemap_urls")]
    return counts[0].union(counts[1]).union(counts[2])


@add("q04_csv_round_trip", over(ISSUES, "SELECT sc.url, p.status::INT AS status, sc.score, coalesce(array_to_string(rules, ';'), '') AS issues FROM sc JOIN p ON p.run_id = sc.run_id AND p.url = sc.url"))
def _(s):
    path = folder(s.spark, "csv")
    exports.write_csv(W.page_views(s.pages(), s.audit(), s.suggestions(s.audit())), path)
    back = s.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("url", c("status").cast("int").alias("status"), c("score").cast("int").alias("score"), F.coalesce("issues", F.lit("")).alias("issues"))


@add("q05_document_round_trip", over(ISSUES, "SELECT run_id, url, score, n_issues, critical FROM sc"))
def _(s):
    """Both runs' documents, each one file, read back as one JSON value and taken apart."""
    path = folder(s.spark, "documents")
    audit, calls = s.audit(), s.calls(s.audit())
    for run in (1, 2):
        one = s.runs().where(c("run_id") == run)
        found = audit.where(c("run_id") == run)
        exports.write_document(one, S.summary(found, A.issues(found)), S.ai_usage(calls.where(c("run_id") == run)), W.page_views(s.pages(), found), f"{path}/run={run}.json")
    shape = "run struct<run_id:long>, pages array<struct<run_id:long,url:string,score:int,n_issues:int,critical:int>>"
    return s.spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("pages").alias("p")).select("p.*")


@add(
    "s16_sitemap_indexes",
    r"""WITH i AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '[#?].*$', '') AS u, page_id FROM pages),
h AS (SELECT host, row_number() OVER (ORDER BY host) AS n FROM (SELECT DISTINCT host FROM i))
SELECT DISTINCT u AS url FROM i JOIN h USING (host) WHERE n <= 49""",
)
def _(s):
    """One index names a sitemap for each host; the index and at most 49 of them, by name, are read."""
    raw = s.raw.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace("url", "[#?].*$", "").alias("u"))
    loc = lambda kind, u: F.concat(F.lit(f"<{kind}><loc>"), u, F.lit(f"</loc></{kind}>"))
    listed = raw.distinct().groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc("url", c("u"))), ""), F.lit("</urlset>")).alias("xml"))
    # sitemaps are named so that their order is that of the hosts
    files = listed.select(F.concat(F.lit("https://maps.example.com/"), "host").alias("file"), "xml")
    index = files.groupBy().agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc("sitemap", c("file"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("https://index.example.com/").alias("file"), "xml")
    starts = index.select("file")
    return sitemaps.traverse(starts, stored(index.union(files), "files"), stored).select("url").distinct()


_BODY = "concat('User-agent: *\\nDisallow: ', regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '\\nAllow: /ok\\nCrawl-delay: ', page_id % 9, '.5\\nSitemap: https://e.com/', page_id, '.xml\\n')"


@add(
    "x30_robots_policies",
    r"""SELECT page_id::VARCHAR AS host, CASE WHEN page_id % 6 = 0 OR page_id % 6 = 5 THEN 'none' WHEN page_id % 6 = 4 THEN 'all' ELSE 'parsed' END AS state,
CASE WHEN page_id % 6 IN (1, 2, 3) THEN (page_id % 9)::DOUBLE + 0.5 END AS delay, CASE WHEN page_id % 6 IN (1, 2, 3) THEN 'https://e.com/' || page_id || '.xml' END AS sitemap,
CASE WHEN page_id % 6 IN (1, 2, 3) THEN CASE WHEN regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) = '' THEN 1 ELSE 2 END END::INT AS n_rules FROM pages""",
)
def _(s):
    """A robots file for each page's address: unreachable or broken servers forbid all, missing files nothing; delays and sitemaps as written."""
    status = F.when(c("page_id") % 6 == 0, F.lit(None)).when(c("page_id") % 6 == 5, 503).when(c("page_id") % 6 == 4, 404).otherwise(200).cast("int")
    files = s.raw.select(c("page_id").cast("string").alias("host"), status.alias("http_status"), F.expr(_BODY).alias("body"))
    return robots.policies(files, "webgauge").select("host", "state", "delay", F.get("sitemaps", F.lit(0)).alias("sitemap"), F.size("rules").alias("n_rules")).withColumn("n_rules", F.when(c("n_rules") >= 0, c("n_rules")))


@add(
    "x34_target_gate",
    """SELECT page_id, page_id % 4 NOT IN (1, 2) AS ok FROM pages""",
)
def _(s):
    """Hosts with only public addresses pass; one private address among them, or none at all, refuses."""
    u = s.raw.select("page_id", F.concat(F.lit("https://h"), "page_id", F.lit(".example.com/")).alias("url"), F.concat(F.lit("h"), "page_id", F.lit(".example.com")).alias("host"))
    public = u.where("page_id % 4 <> 1").select("host", F.lit("93.184.216.34").alias("ip"))
    private = u.where("page_id % 4 = 2").select("host", F.concat(F.lit("10.0."), (c("page_id") % 256).cast("string"), F.lit(".7")).alias("ip"))
    return policy.targets_ok(u, public.union(private)).select("page_id", "ok")


def streamed(s: Snapshot) -> tuple[DataFrame, str]:
    """The derived pages as a stream of files, and a folder for its checkpoint."""
    at = folder(s.spark, "stream")
    page_rows(s).select(*(f.strip().split()[0] for f in "run_id, seq, url, final_url, status, depth, content_type, bytes, elapsed_ms, fetched_at, html, redirect_chain, headers, error".split(","))).write.parquet(f"{at}/in")
    return ingest.page_stream(s.spark, f"{at}/in"), at


@add("st1_ingested_pages", over(FACTS, "SELECT run_id, url, seq FROM p"))
def _(s):
    """A stream of page files into a store, and the same files once more: nothing comes twice."""
    store = new_store(s.spark)
    for attempt in range(2):
        pages, at = streamed(s)
        ingest.ingest(pages, store, f"{at}/check{attempt}").awaitTermination()
    return store.read("pages").select("run_id", "url", "seq")


@add("st2_live_counts", over(FACTS, "SELECT run_id, count(*) AS pages, count(html) AS auditable FROM p GROUP BY run_id"))
def _(s):
    pages, at = streamed(s)
    q = ingest.live_counts(pages).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return s.spark.read.parquet(f"{at}/out")


@add("st3_first_sightings", over(FACTS, "SELECT DISTINCT run_id, url FROM p"))
def _(s):
    pages, at = streamed(s)
    q = ingest.first_sightings(pages.unionByName(pages)).select("run_id", "url").writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).format("parquet").option("path", f"{at}/out").start()
    q.awaitTermination()
    return s.spark.read.parquet(f"{at}/out")


ANSWER = json.dumps({"diagnosis": "What the page is for.", "title": "A rewritten title about page words", "meta_description": "A rewritten description about the words of this page, long enough for the band."})


def answer(messages: list[dict]) -> E.Completion:
    """A model that goes by the length of the page's address: fine at once, after a repair, or never."""
    url = messages[1]["content"].partition(E.URL_LABEL)[2].partition("\n")[0]
    fine = len(url) % 3 == 0 or len(url) % 3 == 1 and len(messages) > 2
    return E.Completion(ANSWER if fine else '{"title": "x"}', 100, 10)


@add(
    "ai08_outcomes",
    over(ISSUES, f", we AS (SELECT DISTINCT run_id, url FROM i WHERE {_WEAK}) SELECT run_id, url, CASE length(url) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' ELSE 'rejected' END AS status, CASE length(url) % 3 WHEN 0 THEN 1 ELSE 2 END AS calls FROM we"),
)
def _(s):
    """Weak pages through the loop of answer, check and one repair, with a scripted model and money enough."""
    found = stored(E.candidates(s.facts(), A.issues(s.audit())), "candidates")
    none = s.spark.createDataFrame([], "key string, model string, prompt_version string, status string, suggestion struct<diagnosis:string,title:string,meta_description:string>, reason string")
    outcomes, calls = E.enrich(found, none, answer, "gpt-4o", 1e6, stored)
    n = calls.groupBy("run_id", "url").agg(F.count("*").cast("int").alias("calls"))
    return outcomes.join(n, ["run_id", "url"]).select("run_id", "url", "status", "calls")


@add("p15_source_texts", over(FACTS, "SELECT run_id, url, concat_ws(' ', title, meta) AS source FROM f"))
def _(s):
    return s.facts().select("run_id", "url", text.source_text(c("title"), c("meta_description"), F.lit("")).alias("source"))


@add("d09_markdown_changes", over(ISSUES, " , x1 AS (SELECT url, score FROM sc WHERE run_id = 1), x2 AS (SELECT url, score FROM sc WHERE run_id = 2) SELECT '| ' || url || ' | ' || x1.score || ' | ' || x2.score || ' | ' || CASE WHEN x2.score > x1.score THEN '+' ELSE '' END || (x2.score - x1.score) || ' |' AS line FROM x1 JOIN x2 USING (url) WHERE x1.score <> x2.score"))
def _(s):
    audit = s.audit()
    scores, found = A.scores(audit), A.issues(audit)
    report = D.Report(1, 2, D.snapshot(scores, found, 1), D.snapshot(scores, found, 2))
    return report.markdown().where("startswith(line, '| http')")


@add(
    "c03_capped_breadth_first",
    over(FACTS, """, g AS (SELECT url, seq AS pos FROM p WHERE run_id = 1),
v AS (SELECT to_url AS url, min((g.pos, to_url)) AS first FROM e JOIN g ON g.url = e.from_url WHERE run_id = 1 AND g.pos % 2 = 0 GROUP BY to_url),
n AS (SELECT url FROM v WHERE url NOT IN (SELECT url FROM g WHERE pos % 2 = 0) ORDER BY first, url LIMIT 25)
SELECT url, 0 AS depth FROM g WHERE pos % 2 = 0 UNION ALL SELECT url, 1 AS depth FROM n"""),
)
def _(s):
    """Every other page of the first run as a seed, and 25 pages more at most, in order of first mention."""
    seeds = s.pages().where("run_id = 1 and seq % 2 = 0").select("url", c("seq").alias("pos"))
    return G.breadth_first(seeds, s.links().where("run_id = 1"), 1, stored, max_pages=seeds.count() + 25)
