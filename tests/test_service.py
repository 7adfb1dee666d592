import pytest
from pyspark.sql import functions as F

from tests.test_engine import GOOD, page, scripted
from webgauge.__main__ import main
from webgauge.plans import service
from webgauge.sources.tables import SCHEMAS, Store


def test_accept():
    assert service.accept("e.com/x") == ("https://e.com/x", None)
    assert service.accept("ftp://e.com")[1] == "that is not an address of a web page"
    assert service.accept("intranet") == (None, "bare_name")
    assert service.accept("e.com", addresses=lambda h: []) == (None, "unresolved")
    assert "private" in service.accept("e.com", addresses=lambda h: ["8.8.8.8", "10.0.0.1"])[1]


def test_two_runs(spark, tmp_path, capsys):
    store = Store(spark, f"{tmp_path}/store")
    assert main([store.root, "init"]) == 0
    assert main([store.root, "audit", "5"]) == 1 and "no run 5" in capsys.readouterr().err
    u = [f"https://good.com/{i}" for i in range(3)]
    html = [GOOD.format(url=x).replace("A title", f"{i} title").replace("A description", f"{i} description") for i, x in enumerate(u)]
    rows = lambda pages: spark.createDataFrame(pages, SCHEMAS["pages"]).drop("run_id")
    sitemap = spark.createDataFrame([(u[1],)], "url string")
    one = service.import_pages(store, "https://good.com/", rows([page(i, u[i], html[i].replace("<body>", f'<body><a href="{u[2]}">x</a>')) for i in range(3)]), sitemap)
    first = service.audit_run(store, one).first()
    assert first.pages_audited == 3 and first.issues_by_rule_id == {"orphan_page": 1}
    two = service.import_pages(store, "https://good.com/", rows([page(0, u[0], html[0].replace("0 title", "")), page(1, u[1], "<p>weak")]))
    service.audit_run(store, two)
    service.audit_run(store, two)
    assert store.read("page_scores").where(F.col("run_id") == two).count() == 2
    report = service.compare_with_previous(store, two)
    pairs = lambda df: [tuple(r) for r in df.collect()]
    assert pairs(report.removed) == [(u[2],)] and (u[1], "orphan_page") in pairs(report.fixed) and (u[1], "title_missing") in pairs(report.introduced)
    assert service.compare_with_previous(store, one) is None
    out = service.enrich_run(store, two, scripted, "gpt-4o", 1.0).first()
    assert out.candidates == 1 and store.read("ai_suggestions").count() == 1 and store.read("ai_cache").count() == 1
    again = service.enrich_run(store, two, scripted, "gpt-4o", 1.0).first()
    assert again.cached == 1 and again.cost_usd == 0
    capsys.readouterr()
    assert main([store.root, "runs"]) == 0 and "https://good.com/" in capsys.readouterr().out
    assert main([store.root, "diff", "1", "2"]) == 0 and "pages gone (1):" in capsys.readouterr().out
    assert main([store.root, "report", "1"]) == 0 and "first of its site" in capsys.readouterr().out
    assert main([store.root, "pages", "2", "--severity", "critical"]) == 0 and u[1] in capsys.readouterr().out
    assert main([store.root, "summary", "2"]) == 0 and '"pages_audited":2' in capsys.readouterr().out
    assert main([store.root, "export", "2", f"{tmp_path}/csv"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    with pytest.raises(LookupError):
        service.compare(store, 1, 9)
