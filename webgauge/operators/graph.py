"""The crawl as graph operations: levels of a breadth-first search, redirects, seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.operators.scan import placed


def breadth_first(seeds: DataFrame, links: DataFrame, max_depth: int, write: Callable[[DataFrame, str], DataFrame], max_pages: int | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """url, depth of what a crawl visits: seeds (url, pos) at depth 0, then level by level what they link to.

    A level is the distinct targets of the one before that haven't been seen, in order of their first mention. With
    ``max_pages`` the visit stops once so many are scheduled. ``aliases`` (url, final_url): where a page redirects to counts as seen.
    """
    links = links.select(F.col("from_url").alias("url"), "to_url").where(F.col("to_url").isNotNull()).distinct()
    level = write(seeds.groupBy("url").agg(F.min("pos").cast("long").alias("pos")).withColumn("depth", F.lit(0)), "level")
    visited = seen = None
    room = max_pages
    depth = 0
    while True:
        if room is not None:
            level = write(level.orderBy("pos", "url").limit(room), "level")
        n = level.count()
        if not n:
            break
        visited = level if visited is None else visited.unionByName(level)
        new = level.select("url")
        if aliases is not None:
            new = new.unionByName(level.select("url").join(aliases, "url").select(F.col("final_url").alias("url")))
        seen = new if seen is None else seen.unionByName(new)
        room = None if room is None else room - n
        depth += 1
        if depth > max_depth or room == 0:
            break
        found = level.join(links, "url").groupBy(F.col("to_url").alias("url")).agg(F.min(F.struct("pos", "to_url")).alias("first"))
        fresh = found.join(seen.distinct(), "url", "left_anti")
        # the order of a level only matters where it may be cut
        next_ = placed(fresh.select("url", "first"), ["first", "url"], write, "pos") if max_pages is not None else fresh.withColumn("pos", F.col("first.pos"))
        level = write(next_.select("url", "pos", F.lit(depth).alias("depth")), "level")
    return visited.select("url", "depth") if visited is not None else seeds.select("url", F.lit(0).alias("depth")).limit(0)


def in_degrees(links: DataFrame) -> DataFrame:
    return links.select("from_url", "to_url").distinct().groupBy(F.col("to_url").alias("url")).agg(F.count("*").alias("links_in"))


MAX_REQUESTS = 10


def follow_redirects(starts: DataFrame, responses: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """url, final_url, status, error, chain of starts (url), through responses (url, status, location, location_site, site, allowed).

    Each hop is tested in this order: a bad target, another site, a loop, a target not allowed; ten requests at most.
    """
    r = responses.select(F.col("url").alias("at"), "status", "location", "location_site", "site", "allowed")
    chain = F.array().cast("array<struct<url:string,status:int>>")
    open_ = starts.select("url", F.col("url").alias("at"), chain.alias("chain"))
    done = None
    for request in range(1, MAX_REQUESTS + 1):
        step = open_.join(r, "at", "left").withColumn("status", F.coalesce("status", F.lit(0)))
        moves = F.col("status").isin(301, 302, 303, 307, 308)
        error = (
            F.when(~moves, None)
            .when(F.col("location").isNull(), "bad_redirect")
            .when(F.col("location_site") != F.col("site"), "off_site_redirect")
            .when(F.array_contains(F.transform("chain", lambda h: h["url"]), F.col("location")) | (F.col("location") == F.col("at")), "redirect_loop")
            .when(~F.coalesce("allowed", F.lit(True)), "disallowed_redirect")
        )
        if request == MAX_REQUESTS:
            error = F.when(moves, F.coalesce(error, F.lit("too_many_redirects")))
        step = write(step.withColumns({"error": error, "moves": moves}), "hops")
        ended = step.where("not moves or error is not null").select("url", F.col("at").alias("final_url"), "status", "error", "chain")
        done = ended if done is None else done.unionByName(ended)
        hop = F.struct(F.col("at").alias("url"), F.col("status").cast("int").alias("status"))
        open_ = step.where("moves and error is null").select("url", F.col("location").alias("at"), F.concat("chain", F.array(hop)).alias("chain"))
        if open_.isEmpty():
            break
    return done


def seeds(start: DataFrame, sitemap: DataFrame) -> DataFrame:
    """url, pos: the start first, then the sitemaps' pages in order, each identity once."""
    every = start.select("url", F.lit(-1).cast("long").alias("pos")).unionByName(sitemap.select("url", F.col("pos").cast("long").alias("pos")))
    first = every.groupBy("url").agg(F.min("pos").alias("pos"))
    return first.withColumn("pos", F.col("pos") + 1)
