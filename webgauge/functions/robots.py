"""robots.txt: rules as rows, longest match as an aggregate."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "struct<state:string,delay:double,sitemaps:array<string>,rules:array<struct<allow:boolean,pattern:string,length:int>>>"


def translated(path: str) -> str:
    """A rule's path as a regular expression at the start of a URL's path."""
    end = path.endswith("$")
    parts = [re.escape(unquote(x)) for x in (path[:-1] if end else path).split("*")]
    return "^" + ".*".join(parts) + ("$" if end else "")


def parse(body: str | None, agent: str) -> dict:
    """Groups of the robots file that apply to the agent; the wildcard's if none names it."""
    groups: list[tuple[list[str], list, list]] = []
    sitemaps, reading_agents = [], False
    for line in (body or "").splitlines():
        name, found, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not found:
            continue
        if name == "sitemap" and value:
            sitemaps.append(value)
        elif name == "user-agent":
            if not reading_agents:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            reading_agents = True
        elif groups:
            reading_agents = False
            if name in ("allow", "disallow") and value:
                groups[-1][1].append((name == "allow", value))
            elif name == "crawl-delay" and value.replace(".", "", 1).isdigit():
                groups[-1][2].append(float(value))
    token = agent.lower().partition("/")[0].strip()
    mine = [g for g in groups if any(a != "*" and a and a in token for a in g[0])] or [g for g in groups if "*" in g[0]]
    rules = [{"allow": a, "pattern": translated(v), "length": len(v)} for g in mine for a, v in g[1]]
    return {"state": "parsed", "delay": next((d for g in mine for d in g[2]), None), "sitemaps": sitemaps, "rules": rules}


def policies(robots: DataFrame, agent: str) -> DataFrame:
    """host, policy of rows (host, http_status, body): unreachable or a server error forbids all, a missing file nothing."""
    read = F.udf(lambda b: parse(b, agent), RULES, useArrow=True)
    state = F.when(F.col("http_status").isNull() | (F.col("http_status") == 0) | (F.col("http_status") >= 500), "none").when(F.col("http_status") >= 400, "all").otherwise("parsed")
    p = robots.withColumn("policy", F.when(state == "parsed", read("body")))
    return p.select("host", state.alias("state"), "policy.delay", "policy.sitemaps", "policy.rules")


def matched_part(url: str | None) -> str:
    """What of an address the rules are compared with: path and query, decoded."""
    try:
        at = urlsplit(url or "")
    except ValueError:
        return "/"
    return unquote((at.path or "/") + (f"?{at.query}" if at.query else ""))


def path_to_match(url: Column) -> Column:
    return F.udf(matched_part, "string", useArrow=True)(url)


def permits(policy: dict, url: str) -> bool:
    """The verdict of one host's policy (state none, all or parsed) on one address, for code inside a task."""
    if policy["state"] != "parsed":
        return policy["state"] == "all"
    part = matched_part(url)
    hits = [(r["length"], r["allow"]) for r in policy["rules"] if re.search(r["pattern"], part)]
    return max(hits)[1] if hits else True


def policy_of(status: int, body: str | None, agent: str) -> dict:
    """The policy of one fetched robots file; status 0 means that the host didn't answer."""
    if status == 0 or status >= 500:
        return {"state": "none", "delay": None, "sitemaps": [], "rules": []}
    return parse(body, agent) if status < 400 else {"state": "all", "delay": None, "sitemaps": [], "rules": []}


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls (url, host) with ``allowed``: the longest matching rule decides, allow wins a tie, no rule allows."""
    p = policies(robots, agent)
    u = urls.join(p, "host", "left").withColumn("_path", path_to_match(F.col("url")))
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<allow:boolean,pattern:string,length:int>>")), lambda r: F.regexp_like(F.col("_path"), r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    verdict = F.when(F.col("state") == "none", False).when(F.coalesce("state", F.lit("all")) == "all", True).otherwise(F.coalesce(best["allow"], F.lit(True)))
    return u.select(*urls.columns, verdict.alias("allowed"))


def effective_delay(least: float, delay: Column) -> Column:
    return F.greatest(F.lit(least), F.coalesce(delay, F.lit(0.0)))
