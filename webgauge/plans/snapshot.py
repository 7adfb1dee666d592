"""Two audited runs derived from a table of raw pages (page_id, url, html), by SQL that any engine takes.

The raw pages have no HTTP facts, descriptions, canonicals, robots, previews or images; these are added, changed or
removed by rules on page_id, so that every audit rule finds something. ``w`` are the raw pages, ``x`` adds dead pages
that some link to, ``d`` keeps the first of equal addresses, ``e`` are links, ``s`` the sitemap. ``p`` are both runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.operators.audit import audited, facts
from webgauge.sources.tables import stored

DERIVED = """
b AS (
  SELECT page_id AS seq, url AS raw_url, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS url,
         CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 503 ELSE 200 END AS status,
         CASE WHEN page_id % 43 = 1 THEN regexp_replace(html, '<title>[^<]*</title>', '')
              WHEN page_id % 8 = 6 THEN replace(html, '<title>', '<title>An intentionally long synthetic prefix for this page title ')
              ELSE html END AS h0
  FROM raw_pages),
h AS (
  SELECT seq, raw_url, url, status,
         CASE WHEN seq % 31 = 2 THEN regexp_replace(h0, '<h1>[^<]*</h1>', '')
              WHEN seq % 9 = 4 THEN replace(h0, '<article>', '<article><h1>Extra</h1>')
              WHEN seq % 6 = 5 THEN replace(h0, '<article>', '<article><img src="/a.png"><img src="/b.png" alt="">')
              WHEN seq % 37 = 3 THEN regexp_replace(h0, '<html lang="[a-z]*">', '<html>')
              WHEN seq % 5 = 1 THEN replace(h0, '<article>', '<article><a href="/gone">lost</a><a href="/gone?x=1">found</a>')
              ELSE h0 END AS h1
  FROM b),
w AS (
  SELECT seq, url, raw_url AS final_url, status,
         CASE WHEN seq % 50 = 7 THEN length(h1) * 2000 ELSE length(h1) END AS bytes,
         (seq * 37) % 3000 AS elapsed_ms,
         CASE WHEN seq % 23 = 6 THEN 'noindex' WHEN seq % 31 = 6 THEN 'NONE' END AS x_robots_tag,
         CASE WHEN seq % 37 = 8 THEN 2 WHEN seq % 41 = 8 THEN 1 ELSE 0 END AS hops,
         CASE WHEN status <> 200 THEN NULL ELSE
           replace(h1, '<meta charset="utf-8">', concat('<meta charset="utf-8">',
             CASE seq % 4 WHEN 0 THEN ''
                  WHEN 1 THEN '<meta name="description" content="Short one.">'
                  WHEN 2 THEN concat('<meta name="description" content="Page ', CAST(seq AS VARCHAR(20)), ' describes one synthetic topic in enough words to sit inside the band.">')
                  ELSE CASE WHEN seq % 3 = 0 THEN concat('<meta name="description" content="Page ', CAST(seq AS VARCHAR(20)), repeat(' keeps describing itself', 8), '">')
                       ELSE '<meta name="description" content="Shared text reused on many pages so that the duplicate rule has something to find here.">' END END,
             CASE seq % 5 WHEN 0 THEN '<link rel="canonical" href="https://elsewhere.example.org/x">'
                  WHEN 1 THEN '' WHEN 2 THEN '<link rel="canonical" href="/other">'
                  ELSE concat('<link rel="canonical" href="', url, '">') END,
             CASE WHEN seq % 19 = 1 THEN '<meta name="robots" content="noindex, follow">'
                  WHEN seq % 19 = 2 THEN '<meta name="robots" content="None">'
                  WHEN seq % 19 = 3 THEN '<meta name="robots" content="nofollow">' ELSE '' END,
             CASE WHEN seq % 2 = 0 THEN '<meta property="og:title" content="t">' ELSE '' END,
             CASE WHEN seq % 3 = 0 THEN '<meta property="og:description" content="d">' ELSE '' END)) END AS html
  FROM h),
x AS (
  SELECT * FROM w UNION ALL
  SELECT seq + 10000000 AS seq, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/gone') AS url, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/gone') AS final_url,
         404 AS status, 0 AS bytes, 1 AS elapsed_ms, NULL AS x_robots_tag, 0 AS hops, NULL AS html
  FROM w WHERE seq % 5 = 1),
d AS (SELECT x.* FROM x JOIN (SELECT url AS u, min(seq) AS s FROM x GROUP BY url) k ON x.url = k.u AND x.seq = k.s),
e1 AS (SELECT url, (seq * 11 + 5) % (SELECT max(page_id) + 1 FROM raw_pages) AS target FROM d WHERE seq % 3 <> 1),
e0 AS (SELECT a.url AS from_url, c.url AS to_url FROM d a JOIN d c ON c.seq = (a.seq * 7 + 3) % 200 UNION
       SELECT a.url AS from_url, c.url AS to_url FROM e1 a JOIN d c ON c.seq = a.target),
p AS (
  SELECT CAST(1 AS BIGINT) AS run_id, seq, url, final_url, status, bytes, elapsed_ms, x_robots_tag, hops, html FROM d WHERE seq % 11 <> 0 UNION ALL
  SELECT CAST(2 AS BIGINT) AS run_id, seq, url, final_url, status, bytes, elapsed_ms, x_robots_tag, hops,
         CASE WHEN seq % 5 = 0 THEN replace(html, '<title>', '<title>Updated title text ')
              WHEN seq % 7 = 0 THEN regexp_replace(html, '<meta name="description" content="[^"]*">', '') ELSE html END AS html
  FROM d WHERE seq % 13 <> 0),
e AS (SELECT DISTINCT a.run_id, from_url, to_url FROM e0 JOIN p a ON a.url = e0.from_url JOIN p c ON c.url = e0.to_url AND c.run_id = a.run_id),
s AS (SELECT run_id, url FROM p WHERE seq % 3 = 0)
"""

#: A run for each raw page: its site, a state by its number, a start within a hundred days, as many pages as its html has characters.
RUNS = """
runs AS (
  SELECT page_id AS run_id, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/') AS start_url,
         CASE page_id % 5 WHEN 0 THEN 'complete' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial' ELSE 'running' END AS status,
         CAST(DATE '2024-01-01' + CAST(page_id % 100 AS INT) AS TIMESTAMP) AS started_at, length(html) AS pages
  FROM raw_pages)
"""


#: Derived tables, facts and audit that this process has stored, by application and the files that they come from.
_KEPT: dict[tuple, DataFrame] = {}


def forget() -> None:
    """The next query computes all of it anew; the stored tables lie in the shared folder until that is cleared."""
    _KEPT.clear()


class Snapshot:
    """The derived tables over one folder of Parquet tables; facts and audit are computed once for the same files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.raw = raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
        files = raw.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row for each file
        self.files = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
        cores = spark.sparkContext.defaultParallelism
        if raw.rdd.getNumPartitions() < cores:  # a small file is one partition; parsing is the work here
            raw = raw.repartition(cores)
        self.sql = lambda query: spark.sql(f"WITH {DERIVED.replace('raw_pages', '{raw_pages}')} {query}", raw_pages=raw)

    def pages(self) -> DataFrame:
        return self.kept("pages", self._pages)

    def _pages(self) -> DataFrame:
        hop = F.transform(F.when(F.col("hops") > 0, F.sequence(F.lit(1), F.col("hops"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat("url", F.lit("?hop="), i.cast("string")).alias("url"), F.lit(302).alias("status")))
        return self.sql("SELECT * FROM p").select(
            F.col("run_id").cast("long").alias("run_id"),
            F.col("seq").cast("long").alias("seq"),
            "url",
            "final_url",
            F.col("status").cast("int").alias("status"),
            F.lit(0).alias("depth"),
            F.col("bytes").cast("long").alias("bytes"),
            F.col("elapsed_ms").cast("int").alias("elapsed_ms"),
            "html",
            hop.alias("redirect_chain"),
            F.when(F.col("x_robots_tag").isNotNull(), F.create_map(F.lit("X-Robots-Tag"), F.col("x_robots_tag"))).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        )

    def links(self) -> DataFrame:
        return self.kept("links", lambda: self.sql("SELECT CAST(run_id AS BIGINT) AS run_id, from_url, to_url FROM e"))

    def sitemap(self) -> DataFrame:
        return self.kept("sitemap", lambda: self.sql("SELECT CAST(run_id AS BIGINT) AS run_id, url FROM s"))

    def kept(self, name: str, build) -> DataFrame:
        key = (name, *self.files)
        if key not in _KEPT:
            _KEPT[key] = stored(build(), name)
        return _KEPT[key]

    def facts(self) -> DataFrame:
        return self.kept("facts", lambda: facts(self.pages()))

    def audit(self) -> DataFrame:
        return self.kept("audit", lambda: audited(self.facts(), self.pages().drop("html"), self.links(), self.sitemap()))

    def runs(self) -> DataFrame:
        query = f"WITH {RUNS.replace('raw_pages', '{raw_pages}')} SELECT CAST(run_id AS BIGINT) AS run_id, start_url, status, started_at, CAST(pages AS BIGINT) AS pages FROM runs"
        return self.spark.sql(query, raw_pages=self.raw)

    def suggestions(self, audit: DataFrame) -> DataFrame:
        """Made-up suggestions for weak pages: their status goes by the page's number."""
        weak = audit.where(F.exists("issues", lambda i: i["rule_id"].startswith("title_") | i["rule_id"].startswith("meta_description_"))).select("run_id", "seq", "url")
        status = F.element_at(F.array(*map(F.lit, ("ok", "repaired", "rejected", "skipped", "unavailable"))), (F.col("seq") % 5 + 1).cast("int"))
        text = lambda x: F.concat(F.lit(x), F.col("seq").cast("string"))
        return weak.select(
            "run_id", "url", "seq", text("=old title ").alias("original_title"), F.lit(None).cast("string").alias("original_meta"), F.lit("d").alias("diagnosis"),
            text("Title ").alias("title"), text("-meta ").alias("meta_description"), status.alias("status"), F.lit(None).cast("string").alias("reason"),
            (F.col("seq") % 4 == 0).alias("cached"), F.lit(0.0).alias("cost_usd"),
        )

    def calls(self, audit: DataFrame) -> DataFrame:
        s = self.suggestions(audit).select("run_id", "url", "seq", (400 + F.col("seq") % 300).alias("prompt_tokens"), (50 + F.col("seq") % 20).alias("completion_tokens"))
        both = s.withColumn("kind", F.lit("initial")).unionByName(s.where("seq % 5 IN (1, 2)").withColumn("kind", F.lit("repair")))
        return both.withColumn("usd", (F.col("prompt_tokens") * 2.5 + F.col("completion_tokens") * 10.0) / 1_000_000.0)
