"""Which addresses a crawl may be sent to.

Addresses are numbers here: every network that isn't public is a range of them in one table, which columns and the
crawl's own check share. Reasons are codes: no_host, local_name, bare_name, other_site, malformed, or a network's kind.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.urls import domain_of, host_of, suffix_rules

#: Names of local networks, and the networks of the special-purpose address registries.
LOCAL_SUFFIXES = (".local", ".localhost", ".internal", ".home.arpa")
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
NETWORKS = {
    "loopback": ("127.0.0.0/8", "::1/128"),
    "link-local": ("169.254.0.0/16", "fe80::/10"),
    "private": (
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
        "203.0.113.0/24", "240.0.0.0/4", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7",
    ),
    "reserved": ("224.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "ff00::/8"),
}
_DOTTED = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


@lru_cache
def ranges(version: int) -> tuple[tuple[int, int, str | None], ...]:
    """(first, last, kind) of a version's networks, in the order in which they decide; kind None is public after all."""
    listed = [(None, PUBLIC_WITHIN), *NETWORKS.items()]
    nets = [(kind, ipaddress.ip_network(n)) for kind, names in listed for n in names]
    return tuple((int(n[0]), int(n[-1]), kind) for kind, n in nets if n.version == version)


def network_kind(value: str) -> str | None:
    """What keeps an address from being public; None if nothing does."""
    try:
        address = ipaddress.ip_address(value)
    except ValueError:
        return "malformed"
    number, version = int(address), address.version
    if version == 6 and number >> 32 == 0xFFFF:  # a version 4 address in version 6 spelling
        number, version = number & 0xFFFFFFFF, 4
    return next((kind for first, last, kind in ranges(version) if first <= number <= last), None)


def network_kind_column(ip: Column) -> Column:
    """The same of a column: arithmetic for dotted addresses, the table in Python for all others."""
    parts = F.split(ip, r"\.")
    number = sum(((F.get(parts, F.lit(i)).try_cast("long") * 256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    kinds = F.lit(None).cast("string")
    for first, last, kind in reversed(ranges(4)):
        kinds = F.when(number.between(first, last), F.lit(kind).cast("string")).otherwise(kinds)
    other = F.udf(lambda x: None if x is None else network_kind(x), "string", useArrow=True)
    dotted = ip.rlike(_DOTTED)
    return F.when(dotted, kinds).when(ip.isNotNull(), other(F.when(~dotted, ip)))


def target_kind(host: str, domain: str, allowed: Sequence[str]) -> str | None:
    """Why a host may not be crawled, without looking up its name; None if it may."""
    if not host:
        return "no_host"
    is_address = network_kind(host) != "malformed"
    sites = {a.strip().lower() for a in allowed}
    checks = (
        ("other_site", is_address and bool(sites)),
        (network_kind(host), is_address),
        ("local_name", host.endswith(LOCAL_SUFFIXES)),
        ("bare_name", "." not in host and not is_address),
        ("other_site", bool(sites) and domain not in sites),
    )
    return next((why for why, holds in checks if holds), None)


def refusal(url: str | None, allowed: Sequence[str] = (), rules: frozenset[str] | None = None) -> str | None:
    host = host_of(url).strip().lower()
    return target_kind(host, domain_of(host, suffix_rules() if rules is None else rules), allowed)


def refusal_column(url: Column, allowed: Sequence[str] = ()) -> Column:
    rules, sites = suffix_rules(), tuple(allowed)
    return F.udf(lambda u: refusal(u, sites, rules), "string", useArrow=True)(url)


def targets_ok(urls: DataFrame, addresses: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """urls (url, host) with ``ok``: not refused, and every address of its host (host, ip) is public; no address refuses."""
    good = addresses.groupBy("host").agg(F.every(network_kind_column(F.col("ip")).isNull()).alias("_public"))
    u = urls.join(good, "host", "left")
    return u.select(*urls.columns, (refusal_column(F.col("url"), allowed).isNull() & F.coalesce("_public", F.lit(False))).alias("ok"))
