"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only. Every source gets a target size from its weight; a document's expected number of
copies is its source's target over its size. The whole part is certain. For the fraction p, each document
draws u from a hash of its id and ranks by the Pareto score (u / (1 - u)) / (p / (1 - p)); the lowest scores
get one more copy until the words still missing are reached. Ranks are found without sorting a source in one
task: scores fall into bins, the words of the bins are summed per source, and only the bin in which the sum
crosses the target is ordered row by row, by ranges over all tasks: it is large if many rows share an id.

Defined results: null and empty texts have size 0 and are taken 0 words. The null source is a source of its
own, ordered last. Sources with no words at all have target 0. Rows that repeat an id and text are documents
of their own with equal scores, taken or left together up to the crossing point, where of rows that share an id the shorter
come first and the number of like ones is what counts. Columns besides doc_id, source and text are ignored; a null doc_id draws as the text 'null'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgauge.llm.shared import BROADCAST_ROWS, written
from webgauge.operators.scan import running

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 1024
#: Fixed value: words are what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``most`` times its size.

    ``sizes`` has one row per source, so the windows over all sources order an aggregate, not documents. The
    excess reshared until none is above has a closed form: sources in order of most * size / weight stop at
    their limit as long as the rest's share is above it; all others get that share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = sizes.withColumn("_k", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_k") + 1).cast("long"))
    w = w.withColumn("_limit", F.col("source_size") * most)
    before = Window.orderBy((F.col("_limit") / F.col("_w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "_left": F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0)),
            "_open": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        }
    )
    # the first source that its share doesn't fill sets the share of itself and all after it
    share = F.col("_left").cast("double") / F.col("_open")
    w = w.withColumn("_fits", (share * F.col("_w") <= F.col("_limit")))
    w = w.withColumn("_share", F.min(F.when(F.col("_fits"), F.struct((F.col("_limit") / F.col("_w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), share.alias("share")))).over(every))
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_share.share") * F.col("_w"), F.col("_limit").cast("double")))
    return w.select("source", "source_size", target.alias("target"))


def uniform(seed: int, doc_id) -> F.Column:
    """A number in (0, 1) from the first 12 hexadecimal digits of a hash."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sized = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    few = goal.count() <= BROADCAST_ROWS // 10
    near = (lambda f: F.broadcast(f)) if few else (lambda f: f)
    renamed = goal.withColumnRenamed("source", "_source")
    d = sized.join(near(renamed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumns({"_sure": F.floor(ratio).cast("long"), "_p": ratio - F.floor(ratio)})
    d = d.withColumn("_u", uniform(seed, F.col("doc_id")))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    d = d.withColumn("_score", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds))
    d = d.withColumn("_bin", F.floor(F.col("_score") / (1 + F.col("_score")) * BINS).cast("int"))
    binned = d.where(F.col("_score").isNotNull()).groupBy("source", "_bin").agg(F.sum("size").alias("_in_bin"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("_before", F.coalesce(F.sum("_in_bin").over(upto), F.lit(0)))
    b = binned.select(F.col("source").alias("_source"), F.col("_bin").alias("_of_bin"), "_before", "_in_bin")
    if few:  # at most BINS rows for each source: counted above
        b = F.broadcast(b) if goal.count() * BINS <= BROADCAST_ROWS else b
    d = d.join(b, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_of_bin")), "left").drop("_source", "_of_bin")
    need = F.col("target") - F.col("_sure") * F.col("source_size")
    d = d.withColumn("_need", need)
    crossing = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_in_bin") > F.col("_need"))
    columns = ["doc_id", "source", "size", "source_size", "target", "_sure"]
    clear = d.where(~F.coalesce(crossing, F.lit(False))).select(
        *columns, F.when(F.col("_score").isNotNull() & (F.col("_before") + F.col("_in_bin") <= F.col("_need")), 1).otherwise(0).alias("_more")
    )
    # rows that are alike are told apart by their place in the written table, so that a range of the order can end between them
    edge = d.where(crossing).withColumn("_row_no", F.monotonically_increasing_id())
    edge = running(edge, ["source"], ["_score", "doc_id", "size", "_row_no"], {"_upto": F.col("size")}, written)
    reached = F.col("_before") + F.col("_upto") - F.col("size")
    # the document at the crossing is taken if that ends nearer to the target
    ordered = edge.withColumn("_reached", reached).select(
        *columns, F.when(F.col("_reached") + F.col("size") / 2.0 <= F.col("_need"), 1).otherwise(0).alias("_more")
    )
    out = clear.unionByName(ordered)
    copies = F.col("_sure") + F.col("_more")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs, weights, most, seed).select("doc_id", "size", "source_size", "target", "taken")
