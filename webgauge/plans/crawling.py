"""A crawl of many sites from their starts: rounds over a written frontier.

Each site's frontier is a queue in the shared folder: places from 0 without gaps. A round takes the next ``step`` places of every site that is
still running, asks for them in order (a site is one task's, since its requests have to wait for each other), reads the pages' links and appends
those of the same site that robots file and targets allow and that weren't seen before, in order of first mention. So pages
are visited, numbered and cut off exactly as by one queue that is worked off page by page, also where a redirect's end counts as seen only for
links met after it. No address passes through the driver; it only asks whether a site is still running.

All of a round is below ``round=N`` in the crawl's folder, its sites' state last. A crawl that was ended somehow goes on behind
the last round whose state is there; what had been asked for in a round that broke off is asked for again.

A site ends complete (queue empty, or as many pages as allowed), partial (time over, three failures of transport in a row, stopped) or
failed (its target is refused, or its robots file forbids all or can't be had).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions.html import facts
from webgauge.functions.urls import link_pair, normalize, registrable_domain, suffix_rules
from webgauge.operators.scan import placed_within
from webgauge.sources.crawl import MAX_FAILURES, site_tools
from webgauge.sources.sitemaps import Reader

SEEDS = "home string, key string, url string, at long, listed boolean, policies string, error string"
FETCHED = (
    "home string, pos long, key string, url string, depth int, final_url string, final_key string, status int, content_type string, bytes long, elapsed_ms int, html string, "
    "redirect_chain array<struct<url:string,status:int>>, headers map<string,string>, error string, failures int, policies string, links array<struct<key:string,url:string,allowed:boolean>>"
)
HTML_AT_ONCE = 8 << 20


@dataclass(frozen=True)
class Limits:
    """Of each site: pages, links away from a seed, seconds for all; step is how many pages a round asks of a site."""

    max_pages: int = 500
    max_depth: int = 10
    seconds: float | None = None
    step: int = 1000


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def seed_batches(batches: Iterator[pa.RecordBatch], options: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """home, url of starts to the site's first addresses: the start, then what its sitemaps list."""
    for batch in batches:
        for home, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tools, error, policy = site_tools(options), None, None
            why = tools.gate.target(url)
            if why is not None:
                error = f"target_{why}"
            else:
                policy = tools.gate.policy(url)
                tools.paced.delay = max(tools.least, policy["delay"] or 0.0)
                if policy["state"] == "none":
                    error = "robots file unreachable"
            row = lambda key, url, at, listed: {"home": home, "key": key, "url": url, "at": at, "listed": listed, "policies": json.dumps(tools.gate.policies), "error": error}  # noqa: B023, E731
            rows = [row(home, url, 0, False)]
            if error is None:
                for n, (_file, key, spelling) in enumerate(Reader(url, tools.get, tools.gate.why_not, tools.timeout).pages(policy["sitemaps"]), 1):
                    if tools.gate.why_not(spelling) is None:
                        rows.append(row(key, spelling, n, True))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def fetch_batches(batches: Iterator[pa.RecordBatch], options: dict, schema: pa.Schema, rules: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """home, pos, key, url, depth, failures, policies, until in order of home and pos to rows of FETCHED.

    Past its time, or after too many failures in a row, nothing more is given out for a site.
    """
    now = tools = site = None
    failures, rows, size = 0, [], 0
    met: dict[str, bool] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["home"] != now:
                now, failures, site, met = r["home"], r["failures"], registrable_domain(r["home"], rules), {}
                tools = site_tools(options)
                tools.gate.policies = json.loads(r["policies"] or "{}")
            if failures >= MAX_FAILURES or r["until"] is not None and time.time() >= r["until"]:
                continue
            got = tools.fetch(r["url"])
            failures = failures + 1 if got["status"] == 0 and got["error"] != "too_many_redirects" else 0
            links = []
            for link in (facts(got["html"], got["final_url"], rules) or {"links": []})["links"]:
                if link["site"] == site:
                    if link["url"] not in met:
                        met[link["url"]] = tools.gate.why_not(link["url"]) is None
                    links.append({"key": link["key"], "url": link["url"], "allowed": met[link["url"]]})
            same = {k: r[k] for k in ("home", "pos", "key", "depth")}
            rows.append(got | same | {"url": r["url"], "final_key": normalize(got["final_url"]), "failures": failures, "policies": json.dumps(tools.gate.policies), "links": links})
            rows[-1]["redirect_chain"], rows[-1]["headers"] = list(got["redirect_chain"]), list(got["headers"].items())
            size += len(got["html"] or "") + 200 * len(links) + 500
            if size >= HTML_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


class Crawl:
    """A crawl below a folder that all of the cluster can reach. ``options``: as of the crawl source, without urls."""

    def __init__(self, spark: SparkSession, root: str, options: dict[str, str] | None = None, limits: Limits = Limits()):
        self.spark, self.root, self.options, self.limits = spark, root.rstrip("/"), dict(options or {}), limits
        self.round = self._last_round()

    def _path(self, round_: int, table: str) -> str:
        return f"{self.root}/round={round_:06d}/{table}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _last_round(self) -> int:
        """The last round that was finished; -1 if none was."""
        n = -1
        while self._there(self._path(n + 1, "sites")):
            n += 1
        return n

    def _write(self, df: DataFrame, round_: int, table: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self._path(round_, table))
        return self.spark.read.schema(schema).parquet(self._path(round_, table))

    def _read(self, round_: int, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(round_, table))

    def _all(self, table: str, first: int = 0) -> DataFrame:
        return self.spark.read.parquet(*(self._path(n, table) for n in range(first, self.round + 1)))

    def _by_site(self, df: DataFrame, *order: str) -> DataFrame:
        """A site's rows in one task; the number of tasks is given, so that small sites aren't put into one."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, "home").sortWithinPartitions("home", *order)

    def begin(self, starts: DataFrame) -> None:
        """Round 0: the seeds of all starts (url). Starts that are no addresses of web pages are left out; spellings of one page are one site."""
        if self.round >= 0:
            return
        pair = F.udf(link_pair, "struct<key:string,url:string>", useArrow=True)
        sites = starts.select(pair(F.col("url")).alias("p")).where("p is not null").groupBy(F.col("p.key").alias("home")).agg(F.min("p.url").alias("url"))
        found = self._write(self._by_site(sites).select("home", "url").mapInArrow(partial(seed_batches, options=self.options, schema=arrow_schema(self.spark, SEEDS)), SEEDS), 0, "seeds")
        first = found.where("error is null").groupBy("home", "key").agg(F.min("at").alias("at"), F.min_by("url", "at").alias("url"))
        queue = placed_within(first, ["home"], ["at"], lambda df, name: self._write(df, 0, name))
        queue = self._write(queue.select("home", (F.col("place") - 1).alias("pos"), "key", "url", F.lit(0).alias("depth")), 0, "queue")
        self._write(queue.select("home", "key"), 0, "seen")
        n = queue.groupBy("home").agg(F.count("*").alias("queued"))
        until = F.lit(None if self.limits.seconds is None else time.time() + self.limits.seconds).cast("double")
        state = found.where("at = 0").join(n, "home", "left")
        self._write(
            state.select(
                "home",
                F.lit(0).cast("long").alias("scheduled"),
                F.coalesce("queued", F.lit(0)).alias("queued"),
                F.lit(0).alias("failures"),
                "policies",
                until.alias("until"),
                F.when(F.col("error").isNotNull(), "failed").otherwise("running").alias("status"),
                "error",
            ),
            0,
            "sites",
        )
        self.round = 0

    def step(self) -> bool:
        """One more round; False if no site is running any more."""
        last = self.round
        sites = self._read(last, "sites")
        running = sites.where("status = 'running'")
        if running.isEmpty():
            return False
        now = last + 1
        upto = F.least(F.col("scheduled") + self.limits.step, F.lit(self.limits.max_pages))
        queue = self._read(last, "queue")
        due = queue.join(running.select("home", "scheduled", upto.alias("upto"), "failures", "policies", "until"), "home").where("pos >= scheduled and pos < upto")
        asked = self._by_site(due.select("home", "pos", "key", "url", "depth", "failures", "policies", "until"), "pos")
        kind = partial(fetch_batches, options=self.options, schema=arrow_schema(self.spark, FETCHED), rules=suffix_rules())
        got = self._write(asked.mapInArrow(kind, FETCHED), now, "fetched")
        # first allowed mention of each address, unless it was queued before or was a redirect's end by then
        met = got.where(F.col("depth") < self.limits.max_depth).select("home", "pos", "depth", F.posexplode("links").alias("n", "link")).where("link.allowed")
        first = met.groupBy("home", F.col("link.key").alias("key")).agg(F.min(F.struct("pos", "n", F.col("link.url").alias("url"), "depth")).alias("m"))
        ends = got.where("status <> 0").groupBy("home", F.col("final_key").alias("key")).agg(F.min("pos").alias("end"))
        fresh = first.join(self._all("seen"), ["home", "key"], "left_anti").join(ends, ["home", "key"], "left").where("end is null or end > m.pos")
        fresh = fresh.select("home", "key", "m.pos", "m.n", "m.url", (F.col("m.depth") + 1).alias("depth"))
        place = placed_within(fresh, ["home"], ["pos", "n"], lambda df, name: self._write(df, now, name))
        new = place.join(sites.select("home", "queued"), "home").select("home", (F.col("queued") + F.col("place") - 1).alias("pos"), "key", "url", "depth")
        new = self._write(new, now, "new")
        self._write(new.select("home", "key").union(ends.select("home", "key")).distinct().join(self._all("seen"), ["home", "key"], "left_anti"), now, "seen")
        told = got.groupBy("home").agg(F.count("*").alias("asked"), F.max_by("failures", "pos").alias("_failures"), F.max_by("policies", "pos").alias("_policies"))
        more = new.groupBy("home").agg(F.count("*").alias("more"))
        s = sites.join(told, "home", "left").join(more, "home", "left")
        s = s.withColumns({"scheduled": F.col("scheduled") + F.coalesce("asked", F.lit(0)), "queued": F.col("queued") + F.coalesce("more", F.lit(0)), "failures": F.coalesce("_failures", "failures"), "policies": F.coalesce("_policies", "policies")})
        over = F.col("until") <= time.time()
        error = F.when(F.col("failures") >= MAX_FAILURES, F.format_string("%d failures of transport in a row", "failures"))
        drained = (F.col("scheduled") >= F.col("queued")) | (F.col("scheduled") >= self.limits.max_pages)
        error = error.when(~drained & F.coalesce(over, F.lit(False)), "time over")
        status = F.when(error.isNotNull(), "partial").when(drained, "complete").otherwise("running")
        is_running = F.col("status") == "running"
        s = s.select("home", "scheduled", "queued", "failures", "policies", "until", F.when(is_running, status).otherwise(F.col("status")).alias("status"), F.when(is_running, error).otherwise(F.col("error")).alias("error"))
        # what is still to be asked for; sites that have ended keep nothing
        rest = queue.union(new).join(s.where("status = 'running'").select("home", "scheduled"), "home").where("pos >= scheduled").drop("scheduled")
        self._write(rest.select("home", "pos", "key", "url", "depth"), now, "queue")
        self._write(s, now, "sites")
        self.round = now
        return True

    def run(self, starts: DataFrame, stop: Callable[[], bool] | None = None) -> DataFrame:
        """Begins, or goes on, until all sites have ended or ``stop`` says so; the sites' state."""
        self.begin(starts)
        while not (stop is not None and stop()):
            if not self.step():
                break
        return self.sites()

    def sites(self) -> DataFrame:
        """home, pages, status, error; a site that wasn't finished is partial."""
        is_running = F.col("status") == "running"
        s = self._read(self.round, "sites")
        return s.select("home", F.col("scheduled").alias("pages"), F.when(is_running, "partial").otherwise(F.col("status")).alias("status"), F.when(is_running, "stopped").otherwise(F.col("error")).alias("error"))

    def pages(self) -> DataFrame:
        """All pages: home, seq, key as url, the spelling asked for, depth and what was answered."""
        empty = self.spark.createDataFrame([], FETCHED)
        got = self._all("fetched", 1) if self.round >= 1 else empty
        return got.select("home", F.col("pos").alias("seq"), F.col("key").alias("url"), F.col("url").alias("asked"), *(c for c in got.columns if c not in ("home", "pos", "key", "url", "failures", "policies")))

    def links(self) -> DataFrame:
        """home, from_url, to_url of all links within a site."""
        return self.pages().select("home", F.col("url").alias("from_url"), F.explode("links.key").alias("to_url"))

    def listed(self) -> DataFrame:
        """home, url of what the sitemaps named."""
        return self._read(0, "seeds").where("listed").select("home", F.col("key").alias("url")).distinct()
