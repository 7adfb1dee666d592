"""The catalogue: a query for each operator over the derived runs, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions import text, urls
from webgauge.operators import audit as A
from webgauge.operators import diff as D
from webgauge.operators import enrich as E
from webgauge.operators import graph as G
from webgauge.operators import summary as S
from webgauge.operators import validate as V
from webgauge.operators import views as W
from webgauge.operators.rules import RULES
from webgauge.plans.more import MORE, MORE_SQL
from webgauge.plans.oracles import ORACLES
from webgauge.plans.snapshot import Snapshot
from webgauge.plans.stored_queries import QUERIES as STORED
from webgauge.plans.stored_queries import SQL as STORED_SQL
from webgauge.sources.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Snapshot(spark, sf_dir))
        return f

    return add


def page_facts(snap: Snapshot) -> DataFrame:
    return snap.facts()


def issues(snap: Snapshot) -> DataFrame:
    return A.issues(snap.audit())


query("s03_pages_in_order")(lambda s: s.pages().select("run_id", "seq", "url", "status").orderBy("run_id", "seq"))
query("s04_redirect_chains")(
    lambda s: s.pages().select("run_id", "url", F.size("redirect_chain").alias("n_hops"), F.get("redirect_chain", F.lit(0))["url"].alias("first_hop"), F.lower(F.col("headers")["X-Robots-Tag"]).alias("x_robots_tag"))
)
query("s08_sitemap_set")(lambda s: s.sitemap().distinct())
query("s05_issues_in_order")(lambda s: issues(s).select("run_id", "page_seq", "rule_ord", "url", "rule_id").orderBy("run_id", "page_seq", "rule_ord"))
query("s09_suggestions_in_order")(lambda s: s.suggestions(s.audit()).select("run_id", "url", "original_title", "title", "meta_description", "status", "cached").orderBy("run_id", "url"))
query("p01_titles")(lambda s: page_facts(s).select("run_id", "url", "title", "title_key"))
query("p03_meta_fields")(lambda s: page_facts(s).select("run_id", "url", "meta_description", "robots_meta", "og_title", "og_description", "lang"))
query("p06_canonicals")(lambda s: page_facts(s).select("run_id", "url", "canonical", "canonical_site"))
query("p08_h1_counts")(lambda s: page_facts(s).select("run_id", "url", F.size("h1s").alias("n_h1")))
query("p10_word_counts")(lambda s: page_facts(s).select("run_id", "url", "word_count"))
query("p11_image_counts")(lambda s: page_facts(s).select("run_id", "url", "images_total", "images_missing_alt"))
query("p12_page_links")(lambda s: page_facts(s).select("run_id", "url", F.posexplode("links").alias("pos", "l")).select("run_id", "url", "l.key", "pos"))
query("a01_page_count")(lambda s: s.pages().groupBy("run_id").agg(F.count("*").alias("pages"), F.count("html").alias("auditable")))
query("a02_title_frequency")(lambda s: A.frequencies(page_facts(s), "title_key", "title_count"))
query("a03_meta_frequency")(lambda s: A.frequencies(page_facts(s), "meta_key", "meta_count"))
query("a04_inbound_counts")(lambda s: A.inbound(s.links()))
query("j01_broken_links")(lambda s: A.broken_links(s.facts(), s.pages()).withColumn("broken", F.array_join("broken", " ")))
query("j06_sitemap_flags")(lambda s: A.with_context(s.facts(), s.pages(), s.links(), s.sitemap()).select("run_id", "url", "in_sitemap", "inbound"))
query("all_issues")(issues)
for _n, _r in enumerate(RULES, 1):
    query(f"r{_n:02d}_{_r.rule_id}")(lambda s, r=_r: issues(s).where(F.col("rule_id") == r.rule_id).select("run_id", "url", "severity", "message"))
query("a05_page_scores")(lambda s: A.scores(s.audit()))
query("a06_score_histogram")(lambda s: S.histogram(s.audit()))
query("a07_issues_by_rule")(lambda s: S.by_rule(issues(s)))
query("a08_issues_by_severity")(lambda s: S.by_severity(issues(s)))
query("a09_average_score")(lambda s: S.averages(s.audit()))
query("a11_issues_per_page")(lambda s: S.per_page(issues(s)))
query("a12_severity_counts")(lambda s: S.severity_counts(issues(s)))
query("a14_rule_sets")(lambda s: S.rule_sets(issues(s)).withColumn("rules", F.array_join("rules", ",")))
query("a20_severity_line")(lambda s: S.severity_line(issues(s)))
query("o02_worst_pages")(lambda s: S.worst(s.audit()))
query("p17_page_views")(
    lambda s: W.page_views(s.pages(), s.audit()).select("run_id", "url", "status", "score", "critical", "warning", "notice", "n_issues", F.nullif(F.array_join(F.transform("issues", lambda i: i["rule_id"]), ";"), F.lit("")).alias("rules"))
)
for _sort in ("score", "url", "issues", "status"):
    for _way in ("asc", "desc"):
        query(f"o04_sorted_{_sort}_{_way}")(lambda s, sort=_sort, way=_way: W.ordered(W.page_views(s.pages(), s.audit()), sort, way == "desc").select("run_id", "url", "place"))
query("f06_critical_pages")(lambda s: W.select_pages(W.page_views(s.pages(), s.audit()), severity="critical").select("run_id", "url", "score"))
query("f07_pages_with_rule")(lambda s: W.select_pages(W.page_views(s.pages(), s.audit()), rule="thin_content").select("run_id", "url", "score"))
query("o06_second_page")(lambda s: W.page_of(W.page_views(s.pages(), s.audit()).where("run_id = 1"), 2, 20)[1].select("url", "score"))


@query("s19_export_rows")
def _(s):
    audit = s.audit()
    return W.export_rows(W.page_views(s.pages(), audit, s.suggestions(audit)))


query("o01_runs")(lambda s: s.runs().select("run_id", "start_url", "status", "pages"))
query("j09_live_page_counts")(lambda s: W.runs_view(s.runs(), s.pages().select((F.col("run_id") + 5).alias("run_id"))).select("run_id", "status", "pages"))
query("f10_previous_runs")(lambda s: W.previous_runs(s.runs()))
query("f11_stale_runs")(lambda s: s.runs().select("run_id", W.stale(F.lit("2024-02-20 10:00:00").cast("timestamp"), 1800.0).alias("stale")))
query("a23_failure_streaks")(lambda s: W.failure_streaks(s.pages().withColumn("status", F.when(F.col("status") >= 400, 0).otherwise(F.col("status")))))


def both(s: Snapshot) -> tuple[DataFrame, DataFrame]:
    audit = s.audit()
    scores, found = A.scores(audit), A.issues(audit)
    return D.snapshot(scores, found, 1), D.snapshot(scores, found, 2)


query("d01_snapshot")(lambda s: both(s)[0].withColumn("rules", F.array_join("rules", ",")))
query("d02_pages_added")(lambda s: D.added(*both(s)))
query("d02_pages_removed")(lambda s: D.removed(*both(s)))
query("d03_score_changes")(lambda s: D.score_changes(*both(s)))
query("d04_issues_fixed")(lambda s: D.fixed(*both(s)))
query("d04_issues_introduced")(lambda s: D.introduced(*both(s)))
query("d05_diff_totals")(lambda s: D.totals(*both(s)))
query("ai01_weak_pages")(lambda s: E.weak_pages(issues(s)))
query("a15_ai_usage")(lambda s: S.ai_usage(s.calls(s.audit())).drop("usd"))
query("a16_ai_statuses")(lambda s: S.ai_statuses(s.suggestions(s.audit())))
query("a19_cost_by_page")(lambda s: s.calls(s.audit()).groupBy("run_id", "url").agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") * 250 + F.col("completion_tokens") * 1000).alias("micro_cents")))
query("a21_budget_window")(
    lambda s: E.affordable(s.calls(s.audit()).where("kind = 'initial'").withColumn("estimate", F.col("prompt_tokens")), 20000).select("run_id", "url", "affordable")
)
query("ai_cache_key")(lambda s: page_facts(s).select("run_id", "url", text.cache_key(F.col("url"), F.col("title"), F.col("meta_description"), F.lit(""), "m", "1").alias("key")))
query("v01_length_checks")(lambda s: page_facts(s).where("title is not null").select("run_id", "url", F.coalesce(F.get(V.length("title", F.col("title")), F.lit(0))["code"], F.lit("")).alias("code")))
query("x05_sites")(lambda s: s.pages().select("url").distinct().withColumn("site", urls.site(F.col("url"))))
query("x01_keys")(
    lambda s: s.pages().where("status = 200").select("final_url").distinct().withColumn("l", urls.link_struct(F.col("final_url"), F.lit(None).cast("string"))).select("final_url", "l.key", "l.url")
)
QUERIES["x26_formula_guard"] = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.as_text(F.col("text")).alias("guarded"))
QUERIES["x13_clean_text"] = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.clean(F.col("text")).alias("cleaned"))
query("t04_seeds")(
    lambda s: G.seeds(s.pages().where("run_id = 1 and seq = 7").select("url"), s.pages().where("run_id = 1 and seq % 3 = 0").select("url", F.col("seq").alias("pos")))
)
query("c01_breadth_first")(
    lambda s: G.breadth_first(s.pages().where("run_id = 1 and seq in (1, 2, 3)").select("url", F.col("seq").alias("pos")), s.links().where("run_id = 1"), 4, stored)
)


QUERIES.update(MORE | STORED)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLES | MORE_SQL | STORED_SQL).items() if k in QUERIES}
