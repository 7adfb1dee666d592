"""Sitemaps: XML to rows, indexes followed level by level, seeds by precedence; and the reading of them from sites.

``Reader`` asks one site for its sitemaps, each request and each redirect (three at most) past the same gate as pages. Files are parsed
as they are read, also packed ones, so that an entry is a row before the next one is looked at. ``seeds`` does so for a table of
starts, a site a task; the data source "sitemaps" for one start given as an option.
"""

from __future__ import annotations

import gzip
import io
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from webgauge.functions.urls import link_pair, registrable_domain, resolve

MAX_FILES = 50
#: Redirects of one sitemap, and guesses below the start's path.
MAX_MOVES, MAX_GUESSES = 3, 3
PARSED = "struct<children:array<string>,pages:array<string>>"


def parse(xml: str | None) -> dict | None:
    """Addresses of child sitemaps and of pages; None for what is no sitemap, malformed or not."""
    name = lambda e: e.tag.rpartition("}")[2].lower()
    try:
        root = ElementTree.fromstring(xml or "")
    except (ElementTree.ParseError, ValueError):
        return None
    if name(root) not in ("urlset", "sitemapindex"):
        return None
    found: dict[str, list[str]] = {"sitemap": [], "url": []}
    for entry in root.iter():
        for loc in entry if name(entry) in found else ():
            if name(loc) == "loc" and loc.text:
                found[name(entry)].append(loc.text.strip())
    return {"children": found["sitemap"], "pages": found["url"]}


def parsed(xml: Column) -> Column:
    return F.udf(parse, PARSED, useArrow=True)(xml)


def traverse(starts: DataFrame, files: DataFrame, write: Callable[[DataFrame, str], DataFrame], most: int = MAX_FILES) -> DataFrame:
    """url, file, pos of the pages listed in sitemaps reached from starts (file) over files (file, xml).

    At most ``most`` files are read from a start list, nearest first; a file is read once.
    """
    level = write(starts.select("file").distinct(), "sitemaps")
    read = pages = None
    n = 0
    while n < most:
        level = write(level.orderBy("file").limit(most - n), "sitemaps")
        if level.isEmpty():
            break
        n += level.count()
        read = level if read is None else read.unionByName(level)
        got = write(level.join(files, "file").select("file", parsed(F.col("xml")).alias("s")).where("s is not null"), "sitemap-entries")
        here = got.select("file", F.posexplode("s.pages").alias("pos", "url"))
        pages = here if pages is None else pages.unionByName(here)
        level = got.select(F.explode("s.children").alias("file")).distinct().join(read, "file", "left_anti")
    return pages if pages is not None else starts.select(F.col("file").alias("url"), "file", F.lit(0).alias("pos")).limit(0)


def discover(guesses: list[str], robots: list[str], root: str, fetch: Callable[[str], str | None]) -> list[str]:
    """Which sitemaps to start from: the first guess below the start's path that is one, then those that robots.txt names; the root's only if there are neither."""
    out = []
    for url in guesses:
        if parse(fetch(url)) is not None:
            out.append(url)
            break
    out += [u for u in robots if u not in out]
    return out or [root]


def entries(body: bytes) -> Iterator[tuple[str, str]]:
    """("sitemap" or "url", address) of a file, as they are met; ValueError if it is no sitemap or breaks off."""
    source = gzip.GzipFile(fileobj=io.BytesIO(body)) if body[:2] == b"\x1f\x8b" else io.BytesIO(body)
    name = lambda e: e.tag.rpartition("}")[2].lower()
    root = None
    try:
        for event, e in ElementTree.iterparse(source, ("start", "end")):
            if root is None:
                root = e
                if name(e) not in ("urlset", "sitemapindex"):
                    raise ValueError("not a sitemap")
            if event == "end" and name(e) in ("sitemap", "url"):
                for loc in e:
                    if name(loc) == "loc" and loc.text:
                        yield name(e), loc.text.strip()
                e.clear()
                root.clear()  # else all entries stay in memory
    except (ElementTree.ParseError, OSError, EOFError) as e:
        raise ValueError(str(e)) from e


class Reader:
    """The sitemaps of one site. ``get`` makes one request, ``why_not`` is the gate, both as in the crawl source."""

    def __init__(self, start: str, get: Callable, why_not: Callable[[str], str | None], timeout: float = 15.0, most_bytes: int = 50 << 20, most_files: int = MAX_FILES):
        self.start, self.get, self.why_not, self.timeout, self.most_bytes, self.most_files = start, get, why_not, timeout, most_bytes, most_files
        self.site, self.read = registrable_domain(start), set()

    def body(self, url: str) -> bytes | None:
        """A file's bytes; None if it can't be had, whatever the reason."""
        for _ in range(MAX_MOVES + 1):
            if self.why_not(url) is not None:
                return None
            try:
                status, headers, body = self.get(url, self.timeout, self.most_bytes)
            except OSError:
                return None
            if status == 200:
                return body if len(body) <= self.most_bytes else None
            to = headers.get("location") if status in (301, 302, 303, 307, 308) else None
            url = resolve(urljoin(url, to)) if to else None
            if url is None:
                return None
        return None

    def mine(self, text: str) -> tuple[str, str] | None:
        pair = link_pair(text)
        return pair if pair and registrable_domain(pair[0]) == self.site != "" else None

    def drain(self, files: list[str]) -> Iterator[tuple[str, str, str]]:
        """(file, key, url) of the pages listed by these files and the indexes' children, so many files at most."""
        queue, n = deque(files), 0
        while queue and n < self.most_files:
            file = queue.popleft()
            if file in self.read:
                continue
            self.read.add(file)
            n += 1
            body = self.body(file)
            if body is None:
                continue
            children, pages = [], []
            try:
                for kind, text in entries(body):
                    pair = self.mine(text)
                    if pair:
                        (children if kind == "sitemap" else pages).append(pair)
            except ValueError:
                continue
            self.answered = True
            queue.extend(url for _, url in children)
            yield from ((file, *pair) for pair in pages)

    def pages(self, named: list[str]) -> Iterator[tuple[str, str, str]]:
        """From the deepest folder of the start that has one, then those that robots.txt names; the root's only if there are neither."""
        at = urlsplit(self.start)
        parts = [x for x in at.path.split("/") if x]
        self.answered = False
        for n in range(len(parts), max(0, len(parts) - MAX_GUESSES), -1):
            yield from self.drain([urljoin(self.start, "/" + "/".join(parts[:n]) + "/sitemap.xml")])
            if self.answered:
                break
        if named:
            yield from self.drain(named)
        elif not self.answered:
            yield from self.drain([urljoin(self.start, "/sitemap.xml")])


class SitemapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        from webgauge.sources.crawl import site_tools

        tools = site_tools(dict(self.options))
        pair = link_pair(self.options["start"])
        if pair is None:
            raise ValueError(f"not an address of a web page: {self.options['start']!r}")
        reader = Reader(pair[1], tools.get, tools.gate.why_not, tools.timeout)
        yield from reader.pages(tools.gate.policy(pair[1])["sitemaps"] if tools.gate.target(pair[1]) is None else [])


class SitemapSource(DataSource):
    """Options: start, and transport, resolver, allowed, agent, delay, timeout as of the crawl source."""

    @classmethod
    def name(cls):
        return "sitemaps"

    def schema(self):
        return "file string, key string, url string"

    def reader(self, schema):
        return SitemapReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SitemapSource)
