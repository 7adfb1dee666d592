"""Summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.operators.rules import WEIGHTS

BUCKETS = ("0-19", "20-39", "40-59", "60-79", "80-100")
WORST = 10
STATUSES = ("ok", "repaired", "rejected", "skipped", "unavailable")


def bucket(score: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BUCKETS)), F.least(F.floor(score / 20), F.lit(4)).cast("int") + 1)


def histogram(scores: DataFrame) -> DataFrame:
    """run_id, bucket, pages; buckets without pages are 0."""
    counts = [F.count_if(bucket(F.col("score")) == b).alias(b) for b in BUCKETS]
    return scores.groupBy("run_id").agg(*counts).unpivot("run_id", list(BUCKETS), "bucket", "pages")


def by_rule(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "rule_id").agg(F.count("*").alias("issues"))


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "severity").agg(F.count("*").alias("issues"))


def per_page(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "url").agg(F.count("*").alias("issues"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "url").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])


def rule_sets(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "url").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def averages(scores: DataFrame) -> DataFrame:
    """run_id, pages_audited, score_sum, average; rounding to one decimal is left to the reader (see rounded())."""
    return scores.groupBy("run_id").agg(F.count("*").alias("pages_audited"), F.sum("score").alias("score_sum"), (F.sum("score") / F.count("*")).alias("average"))


def rounded(total: int | None, n: int) -> float:
    """One decimal of an average, as the double rounds; 0.0 without pages."""
    return round((total or 0) / n, 1) if n else 0.0


def worst(audit: DataFrame, most: int = WORST) -> DataFrame:
    """Of each run, the pages with issues that score lowest; more issues first, then by url."""
    order = Window.partitionBy("run_id").orderBy("score", F.desc("n_issues"), "url")
    ranked = audit.select("run_id", "url", "score", F.size("issues").alias("n_issues")).where("n_issues > 0").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most)


def severity_line(issues: DataFrame) -> DataFrame:
    """run_id, issues, line: the total, and each severity's count in one text."""
    n = {s: F.count_if(F.col("severity") == s) for s in WEIGHTS}
    text = F.concat_ws(", ", *[F.when(k > 0, F.concat(k.cast("string"), F.lit(f" {s}"))) for s, k in n.items()])
    return issues.groupBy("run_id").agg(F.count("*").alias("issues"), text.alias("line"))


def summary(audit: DataFrame, issues: DataFrame) -> DataFrame:
    """A row a run: pages_audited, score_sum, histogram, issues by rule and severity as maps, worst pages."""
    pairs = lambda df, k, v: df.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(f"{v}_by_{k}"))
    base = averages(audit.select("run_id", "score"))
    out = base.join(pairs(histogram(audit), "bucket", "pages"), "run_id", "left")
    out = out.join(pairs(by_rule(issues), "rule_id", "issues"), "run_id", "left").join(pairs(by_severity(issues), "severity", "issues"), "run_id", "left")
    top = worst(audit).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "url", "score", "n_issues"))).alias("worst_pages"))
    return out.join(top, "run_id", "left")


def ai_usage(calls: DataFrame) -> DataFrame:
    """One row, also without calls: calls, prompt_tokens, completion_tokens, usd."""
    zero = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return calls.agg(F.count("*").alias("calls"), zero("prompt_tokens"), zero("completion_tokens"), zero("usd"))


def ai_statuses(suggestions: DataFrame) -> DataFrame:
    """One row: how many suggestions have each status, zeros included, and how many are cached."""
    return suggestions.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if("cached").alias("cached"))
