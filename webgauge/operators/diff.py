"""Differences between two runs, and how they are told."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.operators.summary import averages, rule_sets, rounded


def snapshot(scores: DataFrame, issues: DataFrame, run_id: int) -> DataFrame:
    """url, score, rules of a run."""
    s = scores.where(F.col("run_id") == run_id).select("url", "score")
    r = rule_sets(issues.where(F.col("run_id") == run_id)).select("url", "rules")
    return s.join(r, "url", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(a, "url", "left_anti").select("url")


def removed(a: DataFrame, b: DataFrame) -> DataFrame:
    return added(b, a)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("url", F.col("score").alias("before"), F.col("rules").alias("rules_before")).join(b.select("url", F.col("score").alias("after"), F.col("rules").alias("rules_after")), "url")


def score_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """url, before, after, delta of pages whose score changed; worst first when ordered by (delta, url)."""
    return common(a, b).where("before <> after").select("url", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def fixed(a: DataFrame, b: DataFrame) -> DataFrame:
    """url, rule_id of issues that pages in both runs no longer have."""
    return common(a, b).select("url", F.explode(F.array_except("rules_before", "rules_after")).alias("rule_id"))


def introduced(a: DataFrame, b: DataFrame) -> DataFrame:
    return fixed(b, a)


def totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pages and sums of scores before and after, and how many of each difference; one join of both runs."""
    before = a.select("url", F.lit(True).alias("was"), F.col("score").alias("before"), F.col("rules").alias("rules_before"))
    after = b.select("url", F.lit(True).alias("is"), F.col("score").alias("after"), F.col("rules").alias("rules_after"))
    was, now = F.col("was").isNotNull(), F.col("is").isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    gone = lambda x, y: total(F.when(was & now, F.size(F.array_except(x, y))))
    t = before.join(after, "url", "full_outer").agg(
        F.count_if(was).alias("pages_before"), total("before").alias("sum_before"), F.count_if(now).alias("pages_after"), total("after").alias("sum_after"),
        F.count_if(~was).alias("added"), F.count_if(~now).alias("removed"), F.count_if(was & now & (F.col("before") != F.col("after"))).alias("changed"),
        gone("rules_before", "rules_after").alias("fixed"), gone("rules_after", "rules_before").alias("introduced"),
    )
    return t.withColumn("is_empty", F.expr(f"{' + '.join(PARTS)} = 0"))


#: The differences in the order in which they are told.
PARTS = ("added", "removed", "changed", "fixed", "introduced")


class Report:
    """What differs between two runs, told as lines. Totals are on the driver; rows and lines stay frames of any size."""

    def __init__(self, run_a: int, run_b: int, a: DataFrame, b: DataFrame):
        self.runs = run_a, run_b
        t = totals(a, b).first()
        self.pages = t["pages_before"], t["pages_after"]
        self.averages = rounded(t["sum_before"], self.pages[0]), rounded(t["sum_after"], self.pages[1])
        self.counts = {part: t[part] for part in PARTS}
        self.is_empty = t["is_empty"]
        self.added, self.removed, self.changed, self.fixed, self.introduced = (f(a, b) for f in (added, removed, score_changes, fixed, introduced))

    def headline(self) -> str:
        before, after = self.averages
        return f"mean score {before:g}, now {after:g} ({after - before:+g}); {self.pages[0]} pages, now {self.pages[1]}"

    def _lines(self, headings: list[tuple[int, int, str]], texts: dict[str, Column]) -> DataFrame:
        """``line`` in order of part (-1 is the top) and place (rows have 0, headings come before or after them)."""
        fixed_lines = [(part, place, None, None, None, text) for part, place, text in headings]
        top = self.added.sparkSession.createDataFrame(fixed_lines, "part int, place int, delta int, url string, rule_id string, line string")
        for n, part in enumerate(PARTS):
            rows = getattr(self, part)
            has = lambda name, kind: F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)  # noqa: B023, E731
            top = top.unionByName(rows.select(F.lit(n).alias("part"), F.lit(0).alias("place"), has("delta", "int"), "url", has("rule_id", "string"), texts[part].alias("line")))
        return top.orderBy("part", "place", "delta", "url", "rule_id").select("line")

    def table(self) -> DataFrame:
        """The difference for a terminal; parts without rows are left out."""
        titles = ("new pages", "pages gone", "other scores", "issues mended", "new issues")
        top = [(-1, -2, "run {1} against run {0}".format(*self.runs)), (-1, -1, self.headline())]
        if self.is_empty:
            top.append((-1, 0, "nothing differs"))
        heads = [(n, -1, f"{title} ({self.counts[part]}):") for n, (part, title) in enumerate(zip(PARTS, titles)) if self.counts[part]]
        width = self.changed.agg(F.max(F.length("url"))).first()[0] or 1
        issue = F.format_string("  %s  %s", "url", "rule_id")
        change = F.format_string(f"  %-{width}s  %3d -> %3d  (%+d)", "url", "before", "after", "delta")
        return self._lines(top + heads, {"added": F.concat(F.lit("  + "), "url"), "removed": F.concat(F.lit("  - "), "url"), "changed": change, "fixed": issue, "introduced": issue})

    def markdown(self) -> DataFrame:
        """The difference as a Markdown document; a part without rows says so."""
        titles = ("New pages", "Pages gone", "Other scores", "Issues mended", "New issues")
        top = [(-1, n, text) for n, text in enumerate(["# Run {1} against run {0}".format(*self.runs), "", f"**{self.headline()}**", ""])]
        heads = []
        for n, (part, title) in enumerate(zip(PARTS, titles)):
            inside = ["| URL | before | after | delta |", "|---|---|---|---|"] if part == "changed" else [] if self.counts[part] else ["None."]
            heads += [(n, place - 9, text) for place, text in enumerate([f"## {title}", *inside])] + [(n, 1, "")]
        if self.is_empty:
            heads = [(0, -9, "Nothing differs.")]
        issue = F.format_string("- %s: %s", "url", "rule_id")
        change = F.format_string("| %s | %d | %d | %+d |", "url", "before", "after", "delta")
        return self._lines(top + heads, {"added": F.concat(F.lit("- "), "url"), "removed": F.concat(F.lit("- "), "url"), "changed": change, "fixed": issue, "introduced": issue})

    def as_json(self) -> DataFrame:
        """JSON lines: the totals, then an object for each difference, named by its part."""
        head = json.dumps({"runs": self.runs, "pages": self.pages, "averages": self.averages, **self.counts})
        told = lambda part: F.to_json(F.struct(F.lit(part).alias("part"), *(F.col(x) for x in getattr(self, part).columns)))
        return self._lines([(-1, 0, head)], {part: told(part) for part in PARTS})

    def line(self, site: str) -> str:
        before, after = self.averages
        n = self.counts
        return (
            f"{site}, run {self.runs[1]} against run {self.runs[0]}: mean score {before:g}, now {after:g} ({after - before:+g}); "
            f"{n['added']} pages new and {n['removed']} gone of {self.pages[0]}; {n['fixed']} issues mended, {n['introduced']} new."
        )
