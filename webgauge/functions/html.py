"""Facts of an HTML document, from one pass over its tags in an Arrow UDF.

Regular markup is cut at its tags by one pattern, and attributes are read only of the few elements that give facts. Where a document isn't regular, the
standard library's parser reads it from the start; both call the same handlers, so a document has the same facts either way.
"""

from __future__ import annotations

import re
from html import parser as html_parser
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.urls import Resolver, domain_of, host_of, link_pair, normalize, registrable_domain, suffix_rules

FACTS = (
    "struct<title:string,title_key:string,meta_description:string,meta_key:string,canonical:string,canonical_key:string,robots_meta:string,"
    "og_title:string,og_description:string,lang:string,h1s:array<string>,text:string,word_count:int,images_total:int,images_missing_alt:int,"
    "links:array<struct<key:string,url:string,site:string>>,page_site:string,final_key:string,canonical_site:string>"
)
_LINK = pa.struct([(k, pa.string()) for k in ("key", "url", "site")])
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<struct<key:string,url:string,site:string>>": pa.list_(_LINK)}
#: The same struct for Arrow.
ARROW_FACTS = pa.struct([(name, _ARROW[kind]) for name, kind in re.findall(r"(\w+):((?:array<)?(?:struct<[^>]*>|\w+)>?)", FACTS.removeprefix("struct<").removesuffix(">"))])
#: Only so many bytes of html, or one longer document, are Python objects at a time.
SLICE_BYTES = 1 << 20
HEAD_TAGS = {"title", "meta", "link", "style", "script", "base", "head", "html"}
HIDDEN = {"script", "style", "noscript", "template", "svg"}
_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")


def clean(text: str | None) -> str | None:
    """White space collapsed; blank is None."""
    return " ".join((text or "").split()) or None


def text_key(text: str | None) -> str | None:
    cleaned = clean(text)
    return cleaned and cleaned.casefold()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.hrefs: list[str] = []
        self.canonicals: list[str] = []
        self.lang: str | None = None
        self.seen_html = False
        self.titles: list[str] | None = None
        self.title_open = False
        self.h1s: list[list[str]] = []
        self.h1_open = 0
        self.words: list[str] = []
        self.images = self.bare_images = self.hidden = 0
        self.in_body = False

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def handle_starttag(self, tag, attrs):
        if self.title_open:  # what looks like markup within a title is its text
            self.titles.append(self.get_starttag_text() or "")
            return
        have = dict(reversed(attrs))
        if tag == "body" or tag not in HEAD_TAGS:
            self.in_body = True
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "html" and not self.seen_html:
            self.seen_html, self.lang = True, have.get("lang")
        elif tag == "title" and self.titles is None:
            self.titles, self.title_open = [], True
        elif tag == "meta":
            name, content = have.get("name") or have.get("property"), have.get("content")
            if name and content is not None:
                self.meta.setdefault(name.lower(), content)
        elif tag == "link":
            if "canonical" in (have.get("rel") or "").lower().split() and have.get("href"):
                self.canonicals.append(have["href"])
        elif tag == "a":
            if have.get("href"):
                self.hrefs.append(have["href"])
        elif tag == "img":
            self.images += 1
            self.bare_images += "alt" not in have
        elif tag == "h1":
            self.h1s.append([])
            self.h1_open += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag == "svg":  # the only hidden element that can close itself
            self.hidden -= 1

    def handle_comment(self, data):
        if self.title_open:
            self.titles.append(f"<!--{data}-->")

    def handle_endtag(self, tag):
        if self.title_open and tag != "title":
            self.titles.append(f"</{tag}>")
        elif tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.title_open = False
        elif tag == "h1":
            self.h1_open = max(0, self.h1_open - 1)

    def handle_data(self, data):
        if self.title_open:
            self.titles.append(data)
            return
        if self.h1_open:
            self.h1s[-1].append(data)
        if not self.in_body and data.strip() and not self.hidden and self.lasttag not in ("title", "style", "script"):
            self.in_body = True
        if self.in_body and not self.hidden:
            self.words.append(data)


_NAME, _BLANK = r"[a-zA-Z][a-zA-Z0-9-]*", r"[ \t\n\r\f]"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[\w.-]+)"""
#: A whole tag, comment without double dashes, or doctype in regular spelling.
_TAG = re.compile(rf"<(?:(/?)({_NAME})((?:{_BLANK}+[a-zA-Z_:][\w:.-]*(?:={_VALUE})?)*){_BLANK}*(/?)>|!--(?!-?>)[^-]*(?:-[^-]+)*-->|![dD][oO][cC][tT][yY][pP][eE]{_BLANK}[^<>\"'\[\]-]*>)", re.ASCII)
_ATTRIBUTE = re.compile(rf"([a-zA-Z_:][\w:.-]*)(?:=({_VALUE}))?", re.ASCII)
_CLOSE = {tag: re.compile(rf"</{tag}{_BLANK}*>", re.IGNORECASE) for tag in ("script", "style", "title")}
_OPEN_CLOSE = {tag: re.compile(rf"</{tag}", re.IGNORECASE) for tag in ("script", "style")}
_WITH_FACTS = {"html", "meta", "link", "a", "img"}
#: Elements whose content parsers don't take apart; left to the parser.
_RAW = {"textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"}
_of_attribute = getattr(html_parser, "_unescape_attrvalue", unescape)


def _attributes(text: str) -> list[tuple[str, str | None]]:
    out = []
    for m in _ATTRIBUTE.finditer(text):
        value = m[2]
        if value is not None and value[0] in "\"'":
            value = value[1:-1]
        out.append((m[1].lower(), _of_attribute(value) if value and "&" in value else value))
    return out


def _scan(html: str) -> _Reader | None:
    """The reader after a regular document; None if the document isn't regular."""
    r, at, find, match = _Reader(), 0, html.find, _TAG.match
    data, start, end = r.handle_data, r.handle_starttag, r.handle_endtag
    while True:
        tag_at = find("<", at)
        text = html[at:] if tag_at < 0 else html[at:tag_at]
        if text:
            data(unescape(text) if "&" in text else text)
        if tag_at < 0:
            return r
        m = match(html, tag_at)
        if m is None:
            return None
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if m[3] or m[4]:
                return None
            end(name)
            continue
        if name in _RAW:
            return None
        r.lasttag = name
        attributes = _attributes(m[3]) if name in _WITH_FACTS and m[3] else []
        if m[4]:
            if name in _CLOSE:
                return None
            r.handle_startendtag(name, attributes)
            continue
        start(name, attributes)
        if name == "title":
            if not _CLOSE[name].match(html, find("<", at) if find("<", at) >= 0 else len(html)):
                return None
        elif name in _OPEN_CLOSE:
            found = _OPEN_CLOSE[name].search(html, at)
            if found is None or r.h1_open or not (close := _CLOSE[name].match(html, found.start())):
                return None
            at = close.end()
            end(name)


def _parse(html: str) -> _Reader:
    """The reader after any document; of what the parser can't take, what came up to there."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader


def facts(html: str | None, base: str | None, rules: frozenset[str], url: str | None = None) -> dict | None:
    """The facts of a document, whatever its markup.

    ``base``: the spelling it was read from, ``url``: the page's identity.
    """
    if html is None:
        return None
    whole = _CUT_TAG.sub("", html)
    reader = _scan(whole) or _parse(whole)
    links: dict[str, dict] = {}
    resolve = Resolver(base)
    here = resolve.origin and (resolve.origin + "/", domain_of(host_of(resolve.origin), rules))
    for href in reader.hrefs:
        pair = resolve(href)
        if pair and pair[0] not in links:
            links[pair[0]] = {"key": pair[0], "url": pair[1], "site": here[1] if here and pair[0].startswith(here[0]) else domain_of(host_of(pair[0]), rules)}
    canonical_key = canonical = None
    if reader.canonicals:
        pair = link_pair(reader.canonicals[0], base)
        canonical_key = pair and pair[0]
        canonical = canonical_key or clean(reader.canonicals[0])
    title, description = clean("".join(reader.titles or ())), clean(reader.meta.get("description"))
    text = clean(" ".join(reader.words)) or ""
    return {
        "title": title,
        "title_key": text_key(title),
        "meta_description": description,
        "meta_key": text_key(description),
        "canonical": canonical,
        "canonical_key": canonical_key,
        "robots_meta": clean(reader.meta.get("robots")),
        "og_title": clean(reader.meta.get("og:title")),
        "og_description": clean(reader.meta.get("og:description")),
        "lang": clean(reader.lang),
        "h1s": [h for h in map(clean, map("".join, reader.h1s)) if h],
        "text": text,
        "word_count": len(text.split()),
        "images_total": reader.images,
        "images_missing_alt": reader.bare_images,
        "links": list(links.values()),
        "page_site": registrable_domain(url or base, rules),
        "final_key": normalize(base),
        "canonical_site": registrable_domain(canonical, rules),
    }


def facts_of_batch(html: pa.Array, base: pa.Array, url: pa.Array, rules: frozenset[str]) -> pa.Array:
    """The facts of an Arrow batch, slice by slice, so that memory doesn't grow with the batch's number of documents."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [pa.array([], ARROW_FACTS)], 0
    while at < len(html):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        columns = (x.slice(at, to - at).to_pylist() for x in (html, base, url))
        parts.append(pa.array((facts(h, b, rules, u) for h, b, u in zip(*columns)), ARROW_FACTS, size=to - at))
        at = to
    return pa.concat_arrays(parts)


def facts_column(html: Column, base: Column, url: Column) -> Column:
    rules = suffix_rules()

    def of_batch(h: pa.Array, b: pa.Array, u: pa.Array) -> pa.Array:
        return facts_of_batch(h, b, u, rules)

    return F.arrow_udf(of_batch, FACTS)(html, base, url)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Auditable pages (those with html, even an empty one) with their facts in place of the html."""
    return pages.where(F.col("html").isNotNull()).withColumn("facts", facts_column(F.col("html"), F.col("final_url"), F.col("url"))).drop("html")
