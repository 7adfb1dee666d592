"""Auditing runs: facts, cross-page context as joins, rules, scores. Everything is keyed by run_id, so many runs go at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.html import parse_pages
from webgauge.functions.urls import same
from webgauge.operators.rules import issue_array, weight

FACTS = "title title_key meta_description meta_key canonical canonical_key robots_meta og_title og_description lang h1s text word_count images_total images_missing_alt links page_site final_key canonical_site".split()


def facts(pages: DataFrame) -> DataFrame:
    """Auditable pages with the facts as columns, the sites of page and canonical, and header names in lower case."""
    p = parse_pages(pages)
    p = p.select("*", *[F.col(f"facts.{k}").alias(k) for k in FACTS]).drop("facts")
    return p.withColumn("headers", F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)))


def frequencies(parsed: DataFrame, key: str, name: str) -> DataFrame:
    """How many pages of a run share a text; pages without it aren't counted."""
    return parsed.where(F.col(key).isNotNull()).groupBy("run_id", key).agg(F.count("*").alias(name))


def inbound(links: DataFrame) -> DataFrame:
    """run_id, url, inbound: distinct pages that link to a page, itself included."""
    return links.dropDuplicates(["run_id", "from_url", "to_url"]).groupBy("run_id", F.col("to_url").alias("url")).agg(F.count("*").alias("inbound"))


def internal_links(parsed: DataFrame) -> DataFrame:
    """run_id, url, pos, key, link_url: links of a page that stay on its site, in order of the document."""
    at = parsed.select("run_id", "url", "page_site", F.posexplode("links").alias("pos", "link"))
    return at.where(same(F.col("link.site"), F.col("page_site"))).select("run_id", "url", "pos", F.col("link.key").alias("key"), F.col("link.url").alias("link_url"))


def broken_links(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """run_id, url, broken: keys of internal links whose page failed, in order. A page never fetched isn't broken."""
    status = pages.select("run_id", F.col("url").alias("key"), "status").where("status >= 400")
    hit = internal_links(parsed).join(status, ["run_id", "key"])
    return hit.groupBy("run_id", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("broken"))


def with_context(parsed: DataFrame, pages: DataFrame, links: DataFrame, sitemap: DataFrame) -> DataFrame:
    listed = sitemap.select("run_id", "url").distinct().withColumn("in_sitemap", F.lit(True))
    p = parsed.join(frequencies(parsed, "title_key", "title_count"), ["run_id", "title_key"], "left")
    p = p.join(frequencies(parsed, "meta_key", "meta_count"), ["run_id", "meta_key"], "left")
    p = p.join(listed, ["run_id", "url"], "left").join(inbound(links), ["run_id", "url"], "left").join(broken_links(parsed, pages), ["run_id", "url"], "left")
    return p.withColumns(
        {
            "in_sitemap": F.coalesce("in_sitemap", F.lit(False)),
            "inbound": F.coalesce("inbound", F.lit(0)),
            "broken": F.coalesce("broken", F.array().cast("array<string>")),
        }
    )


def audited(parsed: DataFrame, pages: DataFrame, links: DataFrame, sitemap: DataFrame) -> DataFrame:
    """run_id, seq, url, score, issues (array in order of the rules) of every auditable page."""
    p = with_context(parsed, pages, links, sitemap).select("run_id", "seq", "url", issue_array().alias("issues"))
    return p.withColumn("score", score(F.col("issues")))


def score(issues: Column) -> Column:
    lost = F.aggregate(issues, F.lit(0), lambda a, x: a + weight(x["severity"]))
    return F.greatest(F.lit(0), 100 - lost)


def issues(audit: DataFrame) -> DataFrame:
    """run_id, page_seq, rule_ord, url, rule_id, severity, message: a row for each issue."""
    return audit.select("run_id", F.col("seq").alias("page_seq"), "url", F.explode("issues").alias("i")).select(
        "run_id", "page_seq", "i.rule_ord", "url", "i.rule_id", "i.severity", "i.message"
    )


def scores(audit: DataFrame) -> DataFrame:
    return audit.select("run_id", "url", "score")
