"""Read models: pages with scores, issues and suggestions; filters, sorts, paging; runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.functions.text import as_text
from webgauge.operators.rules import WEIGHTS
from webgauge.operators.scan import placed_within, running
from webgauge.sources.tables import stored

CSV_COLUMNS = "url final_url status depth score critical warning notice issues ai_status original_title ai_title original_meta ai_meta ai_reason".split()
MAX_PAGE_SIZE = 500
SUGGESTION = "original_title original_meta diagnosis title meta_description status reason cached cost_usd".split()


def page_views(pages: DataFrame, audit: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """A row for each scored page: its fields without html, score, counts of severities, issues, and ai if there is any."""
    p = pages.select("run_id", "seq", "url", "final_url", "status", "depth", "bytes", "elapsed_ms")
    v = p.join(audit.select("run_id", "url", "score", "issues"), ["run_id", "url"])
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    v = v.select(*p.columns, "score", *[count(s).alias(s) for s in WEIGHTS], F.size("issues").alias("n_issues"), "issues")
    if suggestions is None:
        return v
    ai = suggestions.select("run_id", "url", F.struct(*SUGGESTION).alias("ai"))
    return v.join(ai, ["run_id", "url"], "left")


def sort_keys(sort: str, descending: bool) -> list[Column]:
    """By score the order turns round as a whole; for other keys, ties stay in the order of fetching both ways."""
    way = (lambda x: F.desc(x)) if descending else (lambda x: F.asc(x))
    if sort == "score":
        return [way("score"), F.asc("n_issues") if descending else F.desc("n_issues"), way("url"), F.asc("seq")]
    columns = {"url": "url", "issues": "n_issues", "status": "status"}
    return [way(columns[sort]), F.asc("seq")]


def select_pages(views: DataFrame, severity: str | None = None, rule: str | None = None) -> DataFrame:
    if severity is not None:
        views = views.where(F.exists("issues", lambda i: i["severity"] == severity))
    if rule is not None:
        views = views.where(F.exists("issues", lambda i: i["rule_id"] == rule))
    return views


def ordered(views: DataFrame, sort: str = "score", descending: bool = False) -> DataFrame:
    """With each page's place in its run's order. A run may be as large as the table: it is sorted in ranges, not in one window."""
    return placed_within(views, ["run_id"], sort_keys(sort, descending), stored).withColumn("place", F.col("place").cast("int"))


def page_of(views: DataFrame, number: int = 1, size: int = 50, sort: str = "score", descending: bool = False) -> tuple[int, DataFrame]:
    """(how many there are, one page of them); beyond the end a page is empty. For the views of one run."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page numbers start at 1; a page has 1 to 500 rows")
    return views.count(), views.orderBy(*sort_keys(sort, descending)).offset((number - 1) * size).limit(size)


def export_rows(views: DataFrame) -> DataFrame:
    """The columns of the CSV export; what a spreadsheet would take for a formula is marked as text."""
    ai = lambda name: F.coalesce(F.col(f"ai.{name}"), F.lit(""))
    rows = views.select(
        "url",
        "final_url",
        "status",
        "depth",
        "score",
        *WEIGHTS,
        F.array_join(F.transform("issues", lambda i: i["rule_id"]), ";").alias("issues"),
        ai("status").alias("ai_status"),
        ai("original_title").alias("original_title"),
        ai("title").alias("ai_title"),
        ai("original_meta").alias("original_meta"),
        ai("meta_description").alias("ai_meta"),
        ai("reason").alias("ai_reason"),
    )
    kinds = dict(rows.dtypes)
    return rows.select(*[as_text(F.col(k)).alias(k) if kinds[k] == "string" else k for k in CSV_COLUMNS])


def runs_view(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs, newest first; one that is still running shows how many pages it has now."""
    live = pages.groupBy("run_id").agg(F.count("*").alias("_live"))
    n = F.when(F.col("status") == "running", F.coalesce("_live", F.lit(0))).otherwise(F.col("pages"))
    return runs.join(live, "run_id", "left").withColumn("pages", n.cast("long")).drop("_live").orderBy(F.desc("run_id"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """run_id, previous: the latest earlier run of the same start that didn't fail."""
    earlier = Window.partitionBy("start_url").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("run_id", F.max(F.when(F.col("status") != "failed", F.col("run_id"))).over(earlier).alias("previous"))


def stale(now: Column, seconds: float) -> Column:
    """Whether a run is marked as running though its time is over."""
    return (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def failure_streaks(pages: DataFrame) -> DataFrame:
    """run_id, first_seq, failures: stretches of consecutive fetches that never completed (status 0)."""
    reached = F.when(F.col("status") != 0, 1).otherwise(0)
    island = running(pages.select("run_id", "seq", "status"), ["run_id"], ["seq"], {"island": reached}, stored)
    return island.where("status = 0").groupBy("run_id", "island").agg(F.min("seq").alias("first_seq"), F.count("*").alias("failures")).drop("island")
