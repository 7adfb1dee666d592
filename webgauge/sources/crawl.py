"""A data source "crawl": fetches the given addresses, a partition per host, under the gates of target, robots, size, type and redirects.

Before anything is asked of a host, its name has to be a public one of the allowed sites, and all its addresses have to be
public; then its robots file decides. Both gates hold for each address and again for each redirect. An address that they
refuse gives a row without a request: ``target_`` and the kind of refusal, ``target_unresolved``, or ``disallowed``.

Not every address need be asked for: beyond a number of seconds for the whole read, once a stop function says so, and after three
failures of transport in a row at one host, those left give a row without a request, with one of ``NOT_ASKED`` as error.
``outcome`` sums rows up as the state of a run. A dry run asks for robots files only: rows without an error could be fetched.

Options: urls (separated by blanks), transport, resolver, head and stop (importable functions, "module:name", so that tests
and offline runs need no network; head is not used with another transport unless given), allowed (sites, separated by commas;
all if not given), agent, delay (between the starts of any two requests to a host; the robots file may ask for more), timeout,
max_bytes, seconds, dry_run. The names' addresses are looked up once a host; the transport looks them up again, so a
name server that changes its answer in between isn't caught.
"""

from __future__ import annotations

import socket
import time
from importlib import import_module
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webgauge.functions import robots
from webgauge.functions.policy import network_kind, refusal
from webgauge.functions.urls import BINARY_EXTENSIONS, host_of, registrable_domain, resolve

#: Types of pages; requests for one page; attempts for one request.
HTML_TYPES = ("text/html", "application/xhtml+xml")
MAX_HOPS, TRIES, FIRST_WAIT = 10, 3, 0.5
#: Fixed value: failures of transport in a row after which a host is left alone.
MAX_FAILURES = 3
#: Why an address was left when the read ended early.
NOT_ASKED = ("left_at_deadline", "left_on_stop", "left_after_failures")
SCHEMA = "url string, final_url string, status int, content_type string, bytes long, elapsed_ms int, html string, redirect_chain array<struct<url:string,status:int>>, headers map<string,string>, error string"


def http_head(url: str, timeout: float, most: int) -> tuple[int, dict[str, str], bytes]:
    """As http_get, for the headers only."""
    return http_get(url, timeout, 0, "HEAD")


def http_get(url: str, timeout: float, most: int, method: str = "GET") -> tuple[int, dict[str, str], bytes]:
    """One request by the standard library, without following redirects."""
    from urllib import request
    from urllib.error import HTTPError

    class Stay(request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    try:
        with request.build_opener(Stay).open(request.Request(url, headers={"User-Agent": "webgauge"}, method=method), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most + 1)
    except HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def attempt(get, url: str, timeout: float, most: int, wait=time.sleep) -> tuple[int, dict[str, str], bytes, str | None]:
    """A request, tried again on overload, server errors and failures of transport; a numeric Retry-After sets the wait."""
    status, headers, body, error, pause = 0, {}, b"", None, FIRST_WAIT
    for n in range(TRIES):
        try:
            status, headers, body = get(url, timeout, most)
            error = None
        except OSError as e:
            status, headers, body, error = 0, {}, b"", str(e)[:200] or type(e).__name__
        if error is None and status != 429 and status < 500:
            break
        if n + 1 < TRIES:
            told = headers.get("retry-after", "")
            wait(float(told) if told.replace(".", "", 1).isdigit() and float(told) else pause)
            pause *= 2
    return status, headers, body, error


def media_type(headers: dict[str, str] | None) -> str:
    return (headers or {}).get("content-type", "").partition(";")[0].strip().lower()


def looks_binary(url: str) -> bool:
    path = urlsplit(url).path.lower()
    return "." in path and "." + path.rpartition(".")[2] in BINARY_EXTENSIONS


class Paced:
    """Requests that start at least ``delay`` seconds after each other."""

    def __init__(self, delay: float = 0.0, clock=time.monotonic, wait=time.sleep):
        self.delay, self.clock, self.wait, self.last = delay, clock, wait, None

    def __call__(self, request):
        def after_pause(*given):
            pause = 0.0 if self.last is None else self.last + self.delay - self.clock()
            if pause > 0:
                self.wait(pause)
            self.last = self.clock()
            return request(*given)

        return after_pause


def fetch(get, url: str, timeout: float = 15.0, most: int = 5 << 20, allowed=lambda url: True, wait=time.sleep, head=None) -> dict:
    """A page's row. Each redirect is tested: bad target, other site, loop, not allowed; ten requests at most.

    An address that looks like a file is asked for its headers first, if ``head`` is given, so that a file isn't loaded to learn that it is one.
    """
    began, at, chain, site = time.monotonic(), url, [], registrable_domain(url)

    def row(status=0, headers=None, html=None, size=0, error=None) -> dict:
        return {
            "url": url, "final_url": at, "status": status, "content_type": media_type(headers) or None, "bytes": size, "elapsed_ms": int(1000 * (time.monotonic() - began)),
            "html": html, "redirect_chain": chain, "headers": headers or {}, "error": error,
        }

    for _ in range(MAX_HOPS):
        if head is not None and looks_binary(at):
            status, headers, _, error = attempt(head, at, timeout, most, wait)
            if error is None and 0 < status < 300 and media_type(headers) not in HTML_TYPES:
                return row(status, headers, error="non_html")
        status, headers, body, error = attempt(get, at, timeout, most, wait)
        if error:
            return row(error=error)
        if status in (301, 302, 303, 307, 308):
            to = resolve(urljoin(at, headers.get("location", ""))) if headers.get("location") else None
            if to is None:
                return row(status, headers, error="bad_redirect")
            if registrable_domain(to) != site:
                return row(status, headers, error="off_site_redirect")
            if to == at or any(h["url"] == to for h in chain):
                return row(status, headers, error="redirect_loop")
            if not allowed(to):
                return row(status, headers, error="disallowed_redirect")
            chain.append({"url": at, "status": status})
            at = to
            continue
        kind = media_type(headers)
        declared = headers.get("content-length", "")
        if kind and kind not in HTML_TYPES:
            return row(status, headers, size=len(body), error="non_html")
        if len(body) > most or declared.isdigit() and int(declared) > most:
            return row(status, headers, size=max(len(body), int(declared or 0) if declared.isdigit() else 0), error="too_large")
        charset = headers.get("content-type", "").lower().partition("charset=")[2].strip("\"' ;") or "utf-8"
        try:
            html = body.decode(charset, "replace")
        except LookupError:
            html = body.decode("utf-8", "replace")
        return row(status, headers, html if status == 200 else None, len(body))
    return row(error="too_many_redirects")


def addresses_of(host: str) -> list[str]:
    """The addresses of a name; none if it has none."""
    try:
        return sorted({str(found[4][0]) for found in socket.getaddrinfo(host, None)})
    except OSError:
        return []


class Gate:
    """Whether an address may be asked for: its target, then the robots file of its origin, each looked at once."""

    def __init__(self, get, resolver, allowed: list[str], agent: str, timeout: float, most: int, wait=time.sleep):
        self.get, self.resolver, self.allowed, self.agent, self.timeout, self.most, self.wait = get, resolver, allowed, agent, timeout, most, wait
        self.targets: dict[str, str | None] = {}
        self.policies: dict[str, dict] = {}

    def target(self, url: str) -> str | None:
        """Why a host may not be asked; None if it may."""
        host = host_of(url)
        if host not in self.targets:
            why = refusal(url, self.allowed)
            if why is None:
                found = self.resolver(host)
                why = next(filter(None, map(network_kind, found)), None) if found else "unresolved"
            self.targets[host] = why
        return self.targets[host]

    def policy(self, url: str) -> dict:
        at = urlsplit(url)
        origin = f"{at.scheme}://{at.netloc}"
        if origin not in self.policies:
            self.policies[origin] = self.read_policy(origin)
        return self.policies[origin]

    def read_policy(self, origin: str) -> dict:
        """The robots file may be moved within public targets; where it can't be read, nothing is allowed."""
        at = f"{origin}/robots.txt"
        for _ in range(MAX_HOPS):
            status, headers, body, error = attempt(self.get, at, self.timeout, self.most, self.wait)
            if error is None and status in (301, 302, 303, 307, 308):
                to = resolve(urljoin(at, headers.get("location", ""))) if headers.get("location") else None
                if to is None or self.target(to) is not None:
                    break
                at = to
                continue
            return robots.policy_of(0 if error else status, body.decode("utf-8", "replace"), self.agent)
        return robots.policy_of(0, None, self.agent)

    def why_not(self, url: str) -> str | None:
        why = self.target(url)
        if why is not None:
            return f"target_{why}"
        return None if robots.permits(self.policy(url), url) else "disallowed"


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def _imported(path: str):
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def _refused(url: str, why: str) -> dict:
    """The row of an address that was never asked for."""
    return {
        "url": url, "final_url": url, "status": 0, "content_type": None, "bytes": 0, "elapsed_ms": 0, "html": None, "redirect_chain": [], "headers": {}, "error": why,
    }


class SiteTools:
    """What one site is asked with: paced requests, and the gate that asks through them too."""

    def __init__(self, options: dict):
        named = lambda option, default: _imported(options.get(option, f"webgauge.sources.crawl:{default}"))
        get = named("transport", "http_get")
        head = named("head", "http_head") if "head" in options or "transport" not in options else None
        self.timeout, self.most, self.least = float(options.get("timeout", "15")), int(options.get("max_bytes", str(5 << 20))), float(options.get("delay", "0.5"))
        self.paced = Paced(self.least)
        self.get, self.head = self.paced(get), self.paced(head) if head is not None else None
        sites = options.get("allowed", "").replace(",", " ").split()
        self.gate = Gate(self.get, named("resolver", "addresses_of"), sites, options.get("agent", "webgauge"), self.timeout, self.most)

    def fetch(self, url: str) -> dict:
        self.paced.delay = max(self.least, self.gate.policy(url)["delay"] or 0.0)
        return fetch(self.get, url, self.timeout, self.most, lambda to: self.gate.why_not(to) is None, head=self.head)


def site_tools(options: dict) -> SiteTools:
    return SiteTools(options)


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        seconds = options.get("seconds")
        self.until = time.time() + float(seconds) if seconds is not None else None  # one moment for all hosts

    def partitions(self):
        by_host: dict[str, list[str]] = {}
        for url in self.options["urls"].split():
            by_host.setdefault(host_of(url), []).append(url)
        return [HostPartition(u) for u in by_host.values()] or [HostPartition([])]

    def left(self, failures: int, stop) -> str | None:
        """Why no more is asked of a host."""
        if self.until is not None and time.time() >= self.until:
            return NOT_ASKED[0]
        if stop is not None and stop():
            return NOT_ASKED[1]
        return NOT_ASKED[2] if failures >= MAX_FAILURES else None

    def read(self, partition):
        tools = SiteTools(dict(self.options))
        stop = _imported(self.options["stop"]) if "stop" in self.options else None
        dry = self.options.get("dry_run", "false").lower() == "true"
        failures = 0
        for url in partition.urls:
            why = self.left(failures, stop) or tools.gate.why_not(url)
            if why is not None or dry:
                r = _refused(url, why)
            else:
                r = tools.fetch(url)
                failures = failures + 1 if r["status"] == 0 and r["error"] != "too_many_redirects" else 0
            yield tuple(r[k] for k in ("url", "final_url", "status", "content_type", "bytes", "elapsed_ms", "html", "redirect_chain", "headers", "error"))


class CrawlSource(DataSource):
    @classmethod
    def name(cls):
        return "crawl"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CrawlReader(self.options)


def was_left(error: Column) -> Column:
    return F.coalesce(error.isin(*NOT_ASKED), F.lit(False))


def was_refused(error: Column) -> Column:
    return F.coalesce((error == "disallowed") | error.startswith("target_"), F.lit(False))


def outcome(rows: DataFrame) -> DataFrame:
    """One row, pages, status, error, of what was read.

    A read that ended early is partial, with the reason of most of what it left; one whose addresses were all refused has
    failed; any other, also one of no address, is complete. Rows of addresses that were never asked for aren't pages.
    """
    error = F.col("error")
    counted = rows.agg(
        F.count("*").alias("n"), F.count_if(was_left(error)).alias("n_left"), F.count_if(was_refused(error)).alias("n_refused"), F.mode(F.when(was_left(error), error), True).alias("why"),
    )
    failed = (F.col("n") > 0) & (F.col("n_refused") == F.col("n"))
    return counted.select(
        (F.col("n") - F.col("n_left") - F.col("n_refused")).alias("pages"),
        F.when(failed, "failed").when(F.col("n_left") > 0, "partial").otherwise("complete").alias("status"),
        F.when(failed, "no address may be asked for").otherwise(F.col("why")).alias("error"),
    )


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("crawl").option("urls", "...") known."""
    spark.dataSource.register(CrawlSource)
