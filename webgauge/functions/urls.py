"""URLs in two forms: the identity key that joins use, and the spelling to request."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is never followed, ports that are left out, extensions that aren't pages.
SKIPPED = ("mailto:", "tel:", "javascript:", "data:", "#")
DEFAULT_PORTS = {"http": 80, "https": 443}
BINARY_EXTENSIONS = (
    ".7z", ".avi", ".bmp", ".css", ".csv", ".dmg", ".doc", ".docx", ".eot", ".exe", ".flv", ".gif", ".gz", ".ico", ".jpeg",
    ".jpg", ".js", ".json", ".mov", ".mp3", ".mp4", ".msi", ".ogg", ".pdf", ".png", ".ppt", ".pptx", ".rar", ".svg", ".tar",
    ".tiff", ".ttf", ".wav", ".webm", ".webp", ".wmv", ".woff", ".woff2", ".xls", ".xlsx", ".xml", ".zip",
)
#: Used where the system has no public suffix list; single labels are suffixes anyway.
COMMON_SUFFIXES = frozenset(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk com.au edu.au gov.au net.au org.au ac.nz co.nz net.nz org.nz ac.jp co.jp go.jp ne.jp or.jp "
    "com.br gov.br net.br org.br com.cn gov.cn net.cn org.cn co.in gov.in net.in org.in co.kr or.kr com.mx com.tr com.tw co.za org.za com.sg com.hk "
    "com.ar com.pl com.ua co.il com.my co.id com.ph com.vn".split()
)
SUFFIX_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"


def link_pair(raw: str | None, base: str | None = None) -> tuple[str, str] | None:
    """(key, spelling) of a reference as written on a page, None if it can't be followed. Never raises."""
    text = (raw or "").strip()
    if not text or text.casefold().startswith(SKIPPED):
        return None
    try:
        at = urlsplit(urljoin(base, text) if base else text)
        host, port = at.hostname, at.port
    except ValueError:
        return None
    scheme = at.scheme.lower()
    if scheme not in DEFAULT_PORTS or not host:
        return None
    place = f"[{host}]" if ":" in host else host
    if port is not None and port != DEFAULT_PORTS[scheme]:
        place += f":{port}"
    ordered = urlencode(sorted(parse_qsl(at.query, keep_blank_values=True))) if at.query else ""
    key = urlunsplit((scheme, place, at.path.rstrip("/") or "/", ordered, ""))
    return key, urlunsplit((scheme, place, at.path or "/", at.query, ""))


#: A path from the root that is taken as it stands: no query, no dots or empty parts to resolve, nothing to trim.
_PLAIN_PATH = re.compile(r"/(?:[\w%~@!$&'()*+,=-][\w.%~@!$&'()*+,=-]*/?)*")


class Resolver:
    """``link_pair`` for the references of one page; those that need no resolving are taken on a short way."""

    def __init__(self, base: str | None):
        self.base = base
        root = link_pair("/", base)
        self.origin = root and root[1][:-1]

    def __call__(self, raw: str) -> tuple[str, str] | None:
        if self.origin and _PLAIN_PATH.fullmatch(raw):
            return self.origin + (raw.rstrip("/") or "/"), self.origin + raw
        return link_pair(raw, self.base)


def normalize(raw: str | None, base: str | None = None) -> str | None:
    pair = link_pair(raw, base)
    return pair and pair[0]


def resolve(raw: str | None, base: str | None = None) -> str | None:
    pair = link_pair(raw, base)
    return pair and pair[1]


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


class Suffixes(frozenset):
    """Suffix rules, with the domains of the hosts that a worker has met under them."""

    def __new__(cls, rules=()):
        self = super().__new__(cls, rules)
        self.met = {}
        return self

    def __reduce__(self):
        return Suffixes, (sorted(self),)


@lru_cache
def suffix_rules(path: str = SUFFIX_LIST) -> Suffixes:
    """Rules of the ICANN part of the public suffix list, a few thousand; read once on the driver."""
    if not os.path.exists(path):
        return Suffixes(COMMON_SUFFIXES)
    with open(path, encoding="utf-8") as f:
        part = re.search(r"===BEGIN ICANN DOMAINS===(.*?)===END ICANN DOMAINS===", f.read(), re.S)
    lines = (line.strip() for line in part.group(1).splitlines()) if part else ()
    return Suffixes(x for x in lines if x and not x.startswith("//"))


def domain_of(host: str, rules: frozenset[str]) -> str:
    """The registrable domain of a host; the host itself where there is none (bare names, addresses)."""
    met = rules.met if isinstance(rules, Suffixes) else {}
    if host not in met:
        if len(met) >= 1 << 16:
            met.clear()
        met[host] = _domain(host.lower(), rules)
    return met[host]


def _domain(host: str, rules: frozenset[str]) -> str:
    labels = host.split(".")
    if len(labels) < 2 or ":" in host or labels[-1].isdigit():
        return host
    suffix = 1
    for n in range(1, len(labels) + 1):
        tail = ".".join(labels[-n:])
        if "!" + tail in rules:
            suffix = n - 1
            break
        if tail in rules or "*." + ".".join(labels[-n + 1 :]) in rules and n > 1:
            suffix = n
    return ".".join(labels[-suffix - 1 :]) if len(labels) > suffix else host


def registrable_domain(url: str | None, rules: frozenset[str] | None = None) -> str:
    return domain_of(host_of(url), suffix_rules() if rules is None else rules)


def same_site(a: str | None, b: str | None, rules: frozenset[str] | None = None) -> bool:
    left = registrable_domain(a, rules)
    return left != "" and left == registrable_domain(b, rules)


# As columns.


def link_struct(raw: Column, base: Column) -> Column:
    """struct<key, url> of a reference, null if it can't be followed."""
    of = F.udf(lambda r, b: link_pair(r, b), "struct<key:string,url:string>", useArrow=True)
    return of(raw, base)


def site(url: Column) -> Column:
    """The registrable domain, '' if there is no host."""
    rules = suffix_rules()
    return F.udf(lambda u: registrable_domain(u, rules), "string", useArrow=True)(url)


def same(a: Column, b: Column) -> Column:
    return (a == b) & (a != "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_root(url: Column) -> Column:
    return path_of(url).isin("", "/")


def looks_binary(url: Column) -> Column:
    return F.regexp_extract(F.lower(path_of(url)), r"(\.[^.]*)$", 1).isin(*BINARY_EXTENSIONS)


def as_typed(text: Column) -> Column:
    """A bare host as typed by a person gets a scheme."""
    return F.when(text.rlike(r"^[A-Za-z0-9_.-]+(:[0-9]+)?(/.*)?$"), F.concat(F.lit("https://"), text)).otherwise(text)


def root_sitemap(start: Column) -> Column:
    """The sitemap that a site has at its root, if its robots file names none."""
    return F.concat(F.regexp_extract(start, r"^(https?://[^/?#]+)", 1), F.lit("/sitemap.xml"))


def sitemap_guesses(start: Column) -> Column:
    """Sitemap addresses below the start's path, deepest first, three at most."""
    origin = F.regexp_extract(start, r"^(https?://[^/?#]+)", 1)
    parts = F.filter(F.split(path_of(start), "/"), lambda x: x != "")
    depths = F.slice(F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), 1, 3)
    return F.transform(depths, lambda n: F.concat(origin, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/sitemap.xml")))
