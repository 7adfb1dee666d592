"""Registrable domains by a join with public suffix rules, instead of a function called for each address.

Rules are rows of one column, as the public list has them: ``com``, ``co.uk``, ``*.ck`` (whatever stands before ck is part of the
suffix) and ``!www.ck`` (an exception to that). Every host is taken apart into its endings, these meet the rules, and of those that apply the exception
wins, else the longest. One label is a suffix anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to this many bytes, counted.
BROADCAST_BYTES = 16 << 20
_IS_ADDRESS = r"^[0-9]+$|:"


def rules_of(lines: DataFrame) -> DataFrame:
    """rule: the rules among the lines (value) of a list; comments and blank lines go, and what stands behind a blank."""
    rule = F.regexp_extract(F.trim("value"), r"^(\S+)", 1)
    return lines.select(F.lower(rule).alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()


def endings(rules: DataFrame) -> DataFrame:
    """ending, more, exception: what a host's ending has to equal, and how many labels beyond it (-1, 0, 1) belong to the suffix."""
    exception, wild = F.col("rule").startswith("!"), F.col("rule").startswith("*.")
    ending = F.when(exception, F.substr("rule", F.lit(2))).when(wild, F.substr("rule", F.lit(3))).otherwise(F.col("rule"))
    return rules.select(ending.alias("ending"), F.when(exception, -1).when(wild, 1).otherwise(0).alias("more"), exception.alias("exception"))


def host_column(url: Column) -> Column:
    """The host of an absolute address in lower case, '' if it has none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(place, r"[\[\]]", ""))


def domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, site of the different hosts (host): the registrable domain; the host itself where there is none. A null host has none."""
    labels = F.split("host", r"\.")
    plain = (F.size(labels) < 2) | F.element_at(labels, -1).rlike(_IS_ADDRESS) | F.col("host").contains(":")
    h = hosts.select("host").where("host is not null").distinct().select("host", labels.alias("labels"), plain.alias("plain"))
    tails = h.where(~F.col("plain")).select("host", F.size("labels").alias("size"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"), "labels")
    tails = tails.select("host", "size", "n", F.array_join(F.slice("labels", -F.col("n"), F.col("n")), ".").alias("ending"))
    met = endings(rules)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 16), F.lit(0))).first()[0]
    hit = tails.join(F.broadcast(met) if size <= BROADCAST_BYTES else met, "ending").where("n + more <= size")
    found = hit.groupBy("host").agg(F.max(F.when(F.col("exception"), F.col("n") + F.col("more"))).alias("exempt"), F.max(F.col("n") + F.col("more")).alias("longest"))
    suffix = F.coalesce("exempt", "longest", F.lit(1))
    site = F.when(F.col("plain") | (F.size("labels") <= suffix), F.col("host")).otherwise(F.array_join(F.slice("labels", -(suffix + 1), suffix + 1), "."))
    return h.join(found, "host", "left").select("host", site.alias("site"))


def with_sites(df: DataFrame, url: str, rules: DataFrame, name: str = "site") -> DataFrame:
    """The rows with the registrable domain of a column of addresses, '' where there is no host. Each host is looked up once."""
    keyed = df.withColumn("_host", F.coalesce(host_column(F.col(url)), F.lit("")))
    of = domains(keyed.select(F.col("_host").alias("host")), rules).withColumnsRenamed({"host": "_host", "site": name})
    return keyed.join(of, "_host", "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("_host")
