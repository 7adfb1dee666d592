"""python -m webgauge STORE COMMAND ...: init, runs, import, crawl, audit, ai, summary, pages, diff, report, export, version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webgauge import __version__
from webgauge.operators import views
from webgauge.plans import service
from webgauge.plans.crawling import Limits
from webgauge.sources import endpoint, exports
from webgauge.sources.tables import Store


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webgauge")
    p.add_argument("store")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("runs")
    commands.add_parser("version")
    c = commands.add_parser("crawl", help="crawl a site from its start and sitemaps, then audit it")
    c.add_argument("start_url")
    c.add_argument("--max-pages", type=int, default=500)
    c.add_argument("--max-depth", type=int, default=10)
    c.add_argument("--seconds", type=float)
    c.add_argument("--delay", type=float, default=0.5)
    c.add_argument("--transport", help="module:name of a function to fetch with")
    c.add_argument("--resolver", help="module:name of a function to look names up with")
    c = commands.add_parser("ai", help="suggestions for a run's weak pages; the key is read from WEBGAUGE_KEY")
    c.add_argument("run", type=int)
    c.add_argument("--model", default="gpt-4o")
    c.add_argument("--endpoint", default="https://api.openai.com/v1/chat/completions")
    c.add_argument("--max-cost", type=float, default=1.0)
    c.add_argument("--at-once", type=int, default=8)
    c = commands.add_parser("import")
    c.add_argument("start_url")
    c.add_argument("parquet", help="pages with the columns of the pages table but run_id")
    for name in ("audit", "summary", "report"):
        commands.add_parser(name).add_argument("run", type=int)
    c = commands.add_parser("pages")
    c.add_argument("run", type=int)
    c.add_argument("--severity", choices=("critical", "warning", "notice"))
    c.add_argument("--rule")
    c.add_argument("--sort", choices=("score", "url", "issues", "status"), default="score")
    c.add_argument("--desc", action="store_true")
    c.add_argument("--page", type=int, default=1)
    c.add_argument("--size", type=int, default=50)
    c = commands.add_parser("diff")
    c.add_argument("a", type=int)
    c.add_argument("b", type=int)
    c = commands.add_parser("export")
    c.add_argument("run", type=int)
    c.add_argument("path")
    c.add_argument("--format", choices=("csv", "json", "document"), default="csv")
    return p


def main(given: list[str] | None = None) -> int:
    a = arguments().parse_args(given)
    if a.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.appName("webgauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    try:
        if a.command == "init":
            store.init()
        elif a.command == "runs":
            for r in views.runs_view(store.read("runs"), store.read("pages")).collect():
                print(r.run_id, r.status, r.pages, r.start_url, sep="\t")
        elif a.command == "import":
            print(service.import_pages(store, a.start_url, spark.read.parquet(a.parquet)))
        elif a.command == "crawl":
            options = {"delay": str(a.delay)} | {k: v for k, v in (("transport", a.transport), ("resolver", a.resolver)) if v}
            run_id = service.crawl_site(store, a.start_url, options, Limits(a.max_pages, a.max_depth, a.seconds))
            row = store.run(run_id).first()
            print(run_id, row["status"], row["pages"], row["error"] or "", sep="\t")
            if row["status"] == "failed":
                return 1
            service.audit_run(store, run_id)
        elif a.command == "ai":
            key = os.environ.get("WEBGAUGE_KEY")
            asked = endpoint.completer(a.endpoint, key, a.model) if key else None
            for r in exports.as_json(service.enrich_run(store, a.run, asked, a.model, a.max_cost, at_once=a.at_once)).collect():  # one row
                print(r.json)
        elif a.command in ("audit", "summary"):
            found = service.audit_run(store, a.run) if a.command == "audit" else service.summary(store, a.run)
            for r in exports.as_json(found).collect():  # one row
                print(r.json)
        elif a.command == "pages":
            total, rows = views.page_of(views.select_pages(service.page_views(store, a.run), a.severity, a.rule), a.page, a.size, a.sort, a.desc)
            for r in rows.select("score", F.array_join(F.transform("issues", lambda i: i["rule_id"]), ";").alias("rules"), "url").collect():
                print(r.score, r.url, r.rules, sep="\t")
            print(f"{total} pages", file=sys.stderr)
        elif a.command == "diff":
            for r in service.compare(store, a.a, a.b).table().toLocalIterator():  # a partition at a time
                print(r.line)
        elif a.command == "report":
            found = service.compare_with_previous(store, a.run)
            for r in found.markdown().toLocalIterator() if found else ():
                print(r.line)
            if not found:
                print(f"Run {a.run} is the first of its site.")
        elif a.format == "document":
            service.export_document(store, a.run, a.path)
        elif a.format == "csv":
            exports.write_csv(service.page_views(store, a.run), a.path)
        else:
            exports.write_json(store.run(a.run), service.summary(store, a.run), service.page_views(store, a.run), a.path)
    except (LookupError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
