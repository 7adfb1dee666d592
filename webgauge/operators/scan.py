"""Places and running sums over a whole order, without a window that one task would have to work off.

Rows are dealt out by ranges of the order and sorted in their partitions; each partition's totals are added up (a row a
partition) and joined back as what comes before it. A key that many rows share is split too, so long as the order has a
further column that tells its rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]
ROW_BITS = (1 << 33) - 1


def ranged(df: DataFrame, order: Sequence[Column | str], write: Write, name: str = "ranged") -> DataFrame:
    """The rows written by ranges of the order, with ``_part`` and ``_row``: their partition, and their place in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return write(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}), name)


def before(parts: DataFrame, *sums: str) -> DataFrame:
    """Of one row a partition: the sums over all earlier partitions."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums)))


def placed(df: DataFrame, order: Sequence[Column | str], write: Write, name: str = "place") -> DataFrame:
    """Every row with its place from 0 in the order of all rows."""
    rows = ranged(df, order, write)
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    return rows.join(before(parts, "n"), "_part").withColumn(name, F.col("_before_n") + F.col("_row")).drop("_part", "_row", "_before_n")


def placed_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], write: Write, name: str = "place") -> DataFrame:
    """Every row with its place from 1 in the order of its group; a group may lie in many partitions. Null groups are groups."""
    rows = placed(df, [*group, *order], write, "_all")
    firsts = rows.groupBy(*(F.col(g).alias(f"_of_{g}") for g in group)).agg(F.min("_all").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return rows.join(firsts, same).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first", *(f"_of_{g}" for g in group))


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], values: dict[str, Column], write: Write) -> DataFrame:
    """Every row with running sums of whole-number ``values`` (new name to column) over its group's rows up to and with itself.

    Sums run over all rows (without a ``group`` that is all); what had been summed before a group's first row is taken off again, so groups need no windows of their own.
    """
    rows = ranged(df.withColumns({f"_v_{k}": F.coalesce(v.cast("long"), F.lit(0)) for k, v in values.items()}), [*group, *order], write)
    parts = rows.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(k) for k in values))
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    # by range partition: as large as a task's share of the sort, however large a group is
    rows = rows.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(upto) for k in values}).join(before(parts, *values), "_part")
    rows = rows.withColumns({f"_s_{k}": F.col(f"_s_{k}") + F.col(f"_before_{k}") for k in values})
    if not group:
        return rows.withColumnsRenamed({f"_s_{k}": k for k in values}).drop("_part", "_row", *(f"{p}{k}" for k in values for p in ("_v_", "_before_")))
    bases = rows.groupBy(*(F.col(g).alias(f"_of_{g}") for g in group)).agg(
        F.min_by(F.struct(*(((F.col(f"_s_{k}") - F.col(f"_v_{k}")).alias(k)) for k in values)), F.struct("_part", "_row")).alias("_base"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    rows = rows.join(bases, same)
    rows = rows.withColumns({k: F.col(f"_s_{k}") - F.col(f"_base.{k}") for k in values})
    return rows.drop("_part", "_row", "_base", *(f"{p}{k}" for k in values for p in ("_v_", "_s_", "_before_")), *(f"_of_{g}" for g in group))
