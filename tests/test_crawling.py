"""Crawls of sites behind an offline transport, against one queue worked off page by page."""

import gzip
import zlib
from collections import deque

import pytest
from pyspark.sql import functions as F

from webgauge.functions.html import facts
from webgauge.functions.urls import link_pair, normalize, registrable_domain, suffix_rules
from webgauge.plans import crawling, service
from webgauge.plans.crawling import Crawl, Limits
from webgauge.sources import crawl, sitemaps
from webgauge.sources.tables import Store

PAGES = 60


def number(url):
    return int(url.rsplit("/", 1)[1]) if url.rsplit("/", 1)[1].isdigit() else None


def web_get(url, timeout, most):
    host, _, path = url.partition("://")[2].partition("/")
    html = {"content-type": "text/html"}
    if path == "robots.txt":
        if host.startswith("closed"):
            return 503, {}, b""
        return 200, {}, b"User-agent: *\nDisallow: /private\nSitemap: https://" + host.encode() + b"/maps/index.xml.gz\n"
    if path == "maps/index.xml.gz":
        return 302, {"location": "/maps/one"}, b""
    if path in ("maps/one", "maps/two", "maps/three"):
        to = {"maps/one": "/maps/two", "maps/two": "/maps/three" if host == "far.com" else "/maps/real.xml.gz", "maps/three": "/maps/real.xml.gz"}[path]
        return 301, {"location": to}, b""
    if path == "maps/real.xml.gz":
        return 200, {}, gzip.compress(f"<sitemapindex><sitemap><loc>https://{host}/maps/a.xml</loc></sitemap><sitemap><loc>https://other.com/b.xml</loc></sitemap></sitemapindex>".encode())
    if path == "maps/a.xml":
        locs = "".join(f"<url><loc>https://{host}/p/{n}</loc></url>" for n in (3, 17, 3)) + "<url><loc>https://other.com/x</loc></url><url><loc>https://" + host + "/private/1</loc></url>"
        return 200, {}, f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{locs}</urlset>'.encode()
    if host.startswith("dead"):
        raise OSError("no route")
    n = number("/" + path) if path.startswith("p/") else 0 if not path else None
    if n is None or n >= PAGES:
        return 404, html, b"gone"
    roll = zlib.crc32(f"{host}{n}".encode())
    if n and roll % 9 == 0:
        return 301, {"location": f"/p/{(n * 5 + 1) % PAGES}"}, b""
    refs = "".join(f'<a href="/p/{(n * k + roll) % (PAGES + 5)}{"/" if roll % 4 == 0 else ""}">x</a>' for k in (2, 3, 7))
    return 200, html, f'<html><body>{refs}<a href="https://www.{host}/p/1">w</a><a href="/private/2">p</a><a href="https://other.com/">o</a></body></html>'.encode()


def addresses(host):
    return ["192.168.1.1"] if host.startswith("inner") else ["93.184.216.34"]


OPTIONS = {"transport": "tests.test_crawling:web_get", "resolver": "tests.test_crawling:addresses", "delay": "0"}


def by_queue(start, max_pages, max_depth):
    """The same crawl in one process: (seq, key, asked, depth, status, final_url)."""
    tools, rules = crawl.site_tools(OPTIONS), suffix_rules()
    home, url = link_pair(start)
    if tools.gate.target(url) or tools.gate.policy(url)["state"] == "none":
        return []
    seen, queue, out, failures = set(), deque(), [], 0

    def add(key, spelling, depth):
        if key not in seen and tools.gate.why_not(spelling) is None and depth <= max_depth:
            seen.add(key)
            queue.append((key, spelling, depth))

    add(home, url, 0)
    for _, key, spelling in sitemaps.Reader(url, tools.get, tools.gate.why_not).pages(tools.gate.policy(url)["sitemaps"]):
        add(key, spelling, 0)
    while queue and len(out) < max_pages and failures < 3:
        key, spelling, depth = queue.popleft()
        got = tools.fetch(spelling)
        out.append((len(out), key, spelling, depth, got["status"], got["final_url"]))
        failures = failures + 1 if got["status"] == 0 else 0
        if got["status"]:
            seen.add(normalize(got["final_url"]))
        for link in (facts(got["html"], got["final_url"], rules) or {"links": []})["links"]:
            if link["site"] == registrable_domain(home, rules):
                add(link["key"], link["url"], depth + 1)
    return out


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setattr(crawl, "FIRST_WAIT", 0.0)


STARTS = ["https://a.com/", "https://b.co.uk/p/5/", "https://www.c.org/p/7", "https://closed.com/", "https://inner.com/", "https://dead.com/", "https://far.com/", "not an address", None]


def frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def visited(found, home):
    return [tuple(x) for x in found.where(F.col("home") == home).select("seq", "url", "asked", "depth", "status", "final_url").orderBy("seq").collect()]


def test_cut_off_within_a_round(spark, tmp_path):
    c = Crawl(spark, f"{tmp_path}/crawl", OPTIONS, Limits(25, 10, None, 15))
    c.run(frame(spark, STARTS[:3]))
    found = c.pages().cache()
    for start in STARTS[:3]:
        assert visited(found, link_pair(start)[0]) == by_queue(start, 25, 10), start


def test_same_order_as_one_queue(spark, tmp_path):
    max_pages, max_depth = 1000, 3
    c = Crawl(spark, f"{tmp_path}/crawl", OPTIONS, Limits(max_pages, max_depth))
    state = {x.home: x for x in c.run(frame(spark, STARTS)).collect()}
    found = c.pages().cache()
    assert len(state) == 7
    for start in STARTS[:7]:
        home = link_pair(start)[0]
        assert visited(found, home) == by_queue(start, max_pages, max_depth), start
    assert state["https://closed.com/"].status == "failed" and state["https://inner.com/"].error == "target_private"
    assert state["https://dead.com/"].status == "partial" and "in a row" in state["https://dead.com/"].error
    assert state["https://a.com/"].status == "complete"
    assert {x.url for x in c.listed().where("home = 'https://a.com/'").collect()} == {"https://a.com/p/3", "https://a.com/p/17"}
    assert c.listed().where("home = 'https://far.com/'").isEmpty()  # a fourth redirect isn't followed
    inside = c.links().where("home = 'https://a.com/' and from_url = 'https://a.com/'").select("to_url").collect()
    assert {"https://www.a.com/p/1", "https://a.com/private/2"} <= {x[0] for x in inside} and not any("other.com" in x[0] for x in inside)


def test_goes_on_after_an_end(spark, tmp_path, monkeypatch):
    limits = Limits(40, 10, None, 6)
    c = Crawl(spark, f"{tmp_path}/crawl", OPTIONS, limits)
    c.begin(frame(spark, STARTS[:1]))
    c.step()
    real = Crawl._write

    def breaks(self, df, round_, table):
        if table == "sites":
            raise RuntimeError("ended midway")
        return real(self, df, round_, table)

    monkeypatch.setattr(Crawl, "_write", breaks)
    with pytest.raises(RuntimeError):
        c.step()
    monkeypatch.setattr(Crawl, "_write", real)
    again = Crawl(spark, f"{tmp_path}/crawl", OPTIONS, limits)
    assert again.round == 1
    again.run(frame(spark, STARTS[:1]))
    assert visited(again.pages(), "https://a.com/") == by_queue(STARTS[0], 40, 10)


def test_stop_and_time(spark, tmp_path):
    c = Crawl(spark, f"{tmp_path}/stopped", OPTIONS, Limits(40, 10, None, 5))
    rounds = iter([False, True])
    assert [tuple(x) for x in c.run(frame(spark, STARTS[:1]), stop=lambda: next(rounds)).collect()] == [("https://a.com/", 3, "partial", "stopped")]  # a round of the three seeds
    assert c.pages().count() == 3
    late = Crawl(spark, f"{tmp_path}/late", OPTIONS, Limits(40, 10, 0.0, 5))
    assert [x.status for x in late.run(frame(spark, STARTS[:1])).collect()] == ["partial"] and late.pages().count() == 0


def test_stored_run(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.init()
    run = service.crawl_site(store, "https://a.com/", OPTIONS, Limits(20, 5))
    row = store.run(run).first()
    assert (row["status"], row["pages"]) == ("complete", 20)
    pages = [(x.seq, x.url, x.depth) for x in store.pages(run).orderBy("seq").collect()]
    assert pages == [(x[0], x[1], x[3]) for x in by_queue("https://a.com/", 20, 5)]
    assert store.read("sitemap_urls").count() == 2 and store.read("links").count() > 20
    with pytest.raises(ValueError):
        service.crawl_site(store, "mailto:x", OPTIONS)


def test_sitemap_source(spark):
    sitemaps.register(spark)
    read = lambda start: [tuple(x) for x in spark.read.format("sitemaps").options(**OPTIONS).option("start", start).load().collect()]
    assert read("https://a.com/") == [("https://a.com/maps/a.xml", f"https://a.com/p/{n}", f"https://a.com/p/{n}") for n in (3, 17, 3)] + [("https://a.com/maps/a.xml", "https://a.com/private/1", "https://a.com/private/1")]
    assert read("https://far.com/") == [] and read("https://inner.com/") == []


def test_sitemap_entries():
    ok = b"<urlset><url><loc> https://a.com/1 </loc></url><url><loc></loc></url><url/></urlset>"
    assert list(sitemaps.entries(ok)) == list(sitemaps.entries(gzip.compress(ok))) == [("url", "https://a.com/1")]
    for bad in (b"", b"<html></html>", b"<urlset><url>", gzip.compress(ok)[:-12], b"\x1f\x8bxx"):
        with pytest.raises(ValueError):
            list(sitemaps.entries(bad))


def test_robots_requests_are_paced(monkeypatch):
    now, waits = [0.0], []
    monkeypatch.setattr(crawl.time, "sleep", waits.append)
    tools = crawl.site_tools(OPTIONS | {"delay": "2"})
    tools.paced.clock, tools.paced.wait = lambda: now[0], waits.append
    assert tools.gate.why_not("https://a.com/p/1") is None
    tools.fetch("https://a.com/p/1")
    assert waits and waits[0] == 2.0


def test_empty(spark, tmp_path):
    c = Crawl(spark, f"{tmp_path}/none", OPTIONS)
    assert c.run(frame(spark, ["mailto:x"])).count() == 0 and c.pages().count() == 0
    assert crawling.Limits().max_pages == 500
