"""What a user does with a store: import pages, audit a run, read it, compare it, enrich it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.functions.policy import network_kind, refusal
from webgauge.functions.urls import host_of, link_pair, suffix_rules
from webgauge.operators import audit as A
from webgauge.operators import diff as D
from webgauge.operators import enrich as E
from webgauge.operators import summary as S
from webgauge.operators import views as W
from webgauge.plans.crawling import Crawl, Limits
from webgauge.sources import crawl, exports
from webgauge.sources.tables import Store, stored


def accept(typed: str, allowed: Sequence[str] = (), addresses: Callable[[str], list[str]] | None = None) -> tuple[str | None, str | None]:
    """(address to crawl, None), or (None, why not), of what a person typed; ``addresses`` resolves a host, if given."""
    text = typed.strip()
    pair = link_pair(text if "://" in text else f"https://{text}")
    if pair is None:
        return None, "that is not an address of a web page"
    why = refusal(pair[1], allowed, suffix_rules())
    if why is None and addresses is not None:
        found = addresses(host_of(pair[1]))
        why = next(filter(None, map(network_kind, found)), None) if found else "unresolved"
    return (pair[1], None) if why is None else (None, why)


def import_pages(store: Store, start_url: str, pages: DataFrame, sitemap: DataFrame | None = None, settings: dict | None = None) -> int:
    """A new run with these pages (the columns of the pages table but run_id); links come from their html."""
    run_id = store.new_run(start_url, settings or {})
    store.insert_ignore("pages", pages.withColumn("run_id", F.lit(run_id).cast("long")))
    parsed = stored(A.facts(store.pages(run_id)), "facts")
    links = A.internal_links(parsed).select("run_id", F.col("url").alias("from_url"), F.col("key").alias("to_url"))
    store.insert_ignore("links", links)
    if sitemap is not None:
        store.insert_ignore("sitemap_urls", sitemap.select(F.lit(run_id).cast("long").alias("run_id"), "url"))
    store.finish_run(run_id, "complete", store.pages(run_id, html=False).count())
    return run_id


def crawl_run(store: Store, start_url: str, fetched: Callable[[], DataFrame], settings: dict | None = None) -> int:
    """A new run of what ``fetched`` reads with the crawl source; its state is the outcome of the rows.

    Pages get rising places, with gaps, in order of address. If reading or storing them fails, the run is marked failed with the
    reason, and the error goes on to the caller.
    """
    run_id = store.new_run(start_url, settings or {})
    try:
        rows = stored(fetched(), "fetched")
        end = crawl.outcome(rows).first()
        asked = rows.where(~crawl.was_left(F.col("error")) & ~crawl.was_refused(F.col("error"))).orderBy("url")
        made = {"run_id": F.lit(run_id).cast("long"), "seq": F.monotonically_increasing_id(), "depth": F.lit(0), "fetched_at": F.current_timestamp()}
        kept = store.read("pages").columns
        store.insert_ignore("pages", asked.select(*(made.get(name, F.col(name) if name in rows.columns else F.lit(None)).alias(name) for name in kept)))
        links = A.internal_links(stored(A.facts(store.pages(run_id)), "facts"))
        store.insert_ignore("links", links.select("run_id", F.col("url").alias("from_url"), F.col("key").alias("to_url")))
        store.finish_run(run_id, end["status"], end["pages"], end["error"])
    except Exception as e:
        store.finish_run(run_id, "failed", 0, f"{type(e).__name__}: {e}"[:500])
        raise
    return run_id


def crawl_site(store: Store, start_url: str, options: dict[str, str], limits: Limits = Limits(), stop: Callable[[], bool] | None = None) -> int:
    """A new run that crawls a site from its start and its sitemaps; pages are stored in the order of the visit, with their depths.

    A run that is stopped, runs out of time or loses its host is partial and keeps its pages; an error marks it failed and goes on to the caller.
    """
    pair = link_pair(start_url)
    if pair is None:
        raise ValueError(f"not an address of a web page: {start_url!r}")
    run_id = store.new_run(pair[0], {"max_pages": limits.max_pages, "max_depth": limits.max_depth, "wall_clock_seconds": limits.seconds})
    try:
        c = Crawl(store.spark, f"{store.root}/crawls/run={run_id}", options, limits)
        end = c.run(store.spark.createDataFrame([(start_url,)], "url string"), stop).first()
        got, run = c.pages(), F.lit(run_id).cast("long").alias("run_id")
        made = {"run_id": run, "fetched_at": F.current_timestamp()}
        store.insert_ignore("pages", got.select(*(made.get(name, F.col(name) if name in got.columns else F.lit(None)).alias(name) for name in store.read("pages").columns)))
        store.insert_ignore("links", c.links().select(run, "from_url", "to_url").distinct())
        store.insert_ignore("sitemap_urls", c.listed().select(run, "url"))
        store.finish_run(run_id, end["status"], end["pages"], end["error"])
    except Exception as e:
        store.finish_run(run_id, "failed", 0, f"{type(e).__name__}: {e}"[:500])
        raise
    return run_id


def audit_run(store: Store, run_id: int) -> DataFrame:
    """Audits a run anew, replacing its issues and scores; its summary. A failed run isn't audited."""
    run = store.run(run_id).first()
    if run is None:
        raise LookupError(f"no run {run_id}")
    if run["status"] == "failed":
        raise ValueError(f"run {run_id} failed; there is nothing to audit")
    of = lambda table: store.read(table).where(F.col("run_id") == run_id)
    parsed = stored(A.facts(store.pages(run_id)), "facts")
    found = stored(A.audited(parsed, store.pages(run_id, html=False), of("links"), of("sitemap_urls")), "audit")
    store.replace_runs("issues", A.issues(found))
    store.replace_runs("page_scores", A.scores(found))
    return S.summary(found, A.issues(found))


def audit_table(store: Store, run_id: int) -> DataFrame:
    """run_id, seq, url, score, issues of a run's stored audit."""
    of = lambda table: store.read(table).where(F.col("run_id") == run_id)
    listed = of("issues").groupBy("run_id", "url").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "rule_id", "severity", "message"))).alias("issues"))
    pages = store.pages(run_id, html=False).select("run_id", "seq", "url")
    none = F.array().cast("array<struct<rule_ord:int,rule_id:string,severity:string,message:string>>")
    return pages.join(of("page_scores"), ["run_id", "url"]).join(listed, ["run_id", "url"], "left").withColumn("issues", F.coalesce("issues", none))


def page_views(store: Store, run_id: int) -> DataFrame:
    suggestions = store.read("ai_suggestions").where(F.col("run_id") == run_id)
    return W.page_views(store.pages(run_id, html=False), audit_table(store, run_id), suggestions)


def summary(store: Store, run_id: int) -> DataFrame:
    found = audit_table(store, run_id)
    return S.summary(found, A.issues(found))


def ai_block(store: Store, run_id: int) -> DataFrame:
    """One row: calls, tokens and cost of a run, how many suggestions have which status, and how many were known before."""
    of = lambda table: store.read(table).where(F.col("run_id") == run_id)
    calls = of("ai_calls").agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 8).alias("cost_usd"))
    states = of("ai_suggestions").agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("ok", "repaired", "rejected", "skipped", "unavailable")), F.count_if("cached").alias("cached"))
    return calls.crossJoin(F.broadcast(states))  # one row each


def export_document(store: Store, run_id: int, path: str) -> None:
    """All of a run as one JSON file: the run, its summary, its ai block, its pages worst first."""
    exports.write_document(store.run(run_id), summary(store, run_id), ai_block(store, run_id), page_views(store, run_id), path)


def compare(store: Store, a: int, b: int) -> D.Report:
    for run_id in (a, b):
        if store.run(run_id).isEmpty():
            raise LookupError(f"no run {run_id}")
    scores, issues = store.read("page_scores"), store.read("issues")
    return D.Report(a, b, D.snapshot(scores, issues, a), D.snapshot(scores, issues, b))


def compare_with_previous(store: Store, run_id: int) -> D.Report | None:
    """None if there is no earlier run of the same start: this one is the baseline."""
    row = W.previous_runs(store.read("runs")).where(F.col("run_id") == run_id).first()
    return compare(store, row["previous"], run_id) if row and row["previous"] is not None else None


def enrich_run(store: Store, run_id: int, completer: E.Completer | None, model: str, budget: float, counter: E.Counter = E.token_estimate, at_once: int = E.AT_ONCE) -> DataFrame:
    """Suggestions for a run's weak pages, stored with their calls and cache; a one-row report with a warning if there is something to know."""
    parsed = stored(A.facts(store.pages(run_id)), "facts")
    found = stored(E.candidates(parsed, store.read("issues").where(F.col("run_id") == run_id)), "candidates")
    outcomes, calls = E.enrich(found, store.read("ai_cache"), completer, model, budget, stored, counter, at_once)
    outcomes = stored(outcomes, "outcomes")
    at = F.date_trunc("second", F.current_timestamp())
    store.write("ai_calls", calls.withColumn("created_at", at))
    rows = outcomes.join(found.select("run_id", "url", F.col("title").alias("original_title"), F.col("meta_description").alias("original_meta")), ["run_id", "url"])
    store.replace_runs("ai_suggestions", rows.select("*", "suggestion.diagnosis", "suggestion.title", "suggestion.meta_description"))
    store.upsert("ai_cache", E.cache_rows(outcomes, model).dropDuplicates(["key"]).withColumn("created_at", at))
    told = E.warning(outcomes, budget).first()[0] if completer is not None else "no model is configured: results of the rules only"
    return E.report(outcomes).withColumn("warning", F.lit(told))
