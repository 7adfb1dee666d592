"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every window of every document.

DataFrame functions only. A document's words are cut into parts that overlap by n - 1 words; words are hashed, each
window of n words is hashed from those, and the window hashes meet the benchmark's in a broadcast hash join; the joined words are then compared, so that a hash
collision never counts. The set is broadcast in blocks bounded by n-grams and by bytes: a benchmark beyond one
block costs another scan, never a larger broadcast. Ids of items aren't broadcast: a hit carries the number of its n-gram, and
only the n-grams of documents with hits meet the items.

Defined results: a null or empty text, or one of separators only, has no words and no hits. A benchmark item
with fewer words than n is one window of its own length; one without words has none. A null item_id still
marks words as hit but isn't listed. Repeated rows are each answered; columns besides id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.llm.shared import without, written

#: Fixed value: what separates words once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: n-grams that are broadcast at once, and bytes of their rows; a single n-gram of very long words may be more.
BLOCK, BLOCK_BYTES = 200_000, 1 << 26
#: Windows of a document that are hashed together; a window's row carries the words of its part, not of the whole text.
STRETCH = 128


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: Column, n: int) -> Column:
    """Array of the 64-bit hashes of all windows of n words.

    Hashes of one, two, four... words that follow each other are joined two by two, so a window costs some log2(n) steps.
    """

    def joined(left: Column, right: Column, step: int) -> Column:
        return F.transform(left, lambda h, i: F.xxhash64(h, F.get(right, i + step)))

    def grown(size: int, doubled: Column, rest: Column | None, done: int) -> Column:
        """``rest`` covers the first ``done`` words of a window; ``doubled`` has the hashes of ``size`` words."""
        if n & size:
            rest = doubled if rest is None else joined(rest, doubled, done)
            done += size
        if done == n:
            return rest
        return let(joined(doubled, doubled, size), lambda twice: grown(2 * size, twice, rest, done))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(let(ones, lambda h: grown(1, h, None, 0)), F.lit(1), F.greatest(F.lit(0), F.size(words) - (n - 1)))


def placed(hashes: Column, n: int) -> Column:
    """Window hashes with their length and place."""
    return F.transform(hashes, lambda h, i: F.struct(F.lit(n).alias("len"), i.alias("pos"), h.alias("h")))


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per distinct window: gram_id, len, gram (its words), hash, bytes; and gram_id, item of each item that has it."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("_w"))
    k = F.least(F.lit(n), F.size("_w"))
    every = b.where(F.size("_w") > 0).select(
        "item",
        k.alias("len"),
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.slice(F.col("_w"), i, F.least(F.lit(n), F.size("_w"))))
        ).alias("gram"),
    )
    every = written(every.distinct(), "gram-items")
    hashed = F.coalesce(*(F.when(F.col("len") == k, window_hashes(F.col("gram"), k)[0]) for k in range(1, n + 1)))
    grams = every.select("len", "gram").distinct().withColumns({"hash": hashed, "bytes": 64 + 24 * F.col("len") + F.octet_length(F.array_join("gram", ""))})
    grams = written(grams.withColumn("gram_id", F.monotonically_increasing_id()), "grams")
    return grams, every.join(grams.select("gram_id", "len", "gram"), ["len", "gram"]).select("gram_id", "item")


def block_count(grams: DataFrame) -> int:
    """Into how many parts by hash the n-grams go so that each may be broadcast."""
    rows, size, largest = (x or 0 for x in grams.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first())
    blocks = max(1, -(-rows // BLOCK), -(-size // BLOCK_BYTES))
    while blocks > 1 and grams.groupBy(F.pmod("hash", F.lit(blocks))).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > BLOCK_BYTES + largest:
        blocks *= 2
    return blocks


def hits(docs: DataFrame, grams: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id and text: doc_id, _text_hash, n_words, n_hit, grams (their numbers), _rows (rows that are alike)."""
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n numbers
    blocks = block_count(grams)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_text_hash"), words_of(F.col(text)).alias("_all"))
    last = F.greatest(F.lit(0), F.ceil(F.size("_all") / STRETCH).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("_all", i * STRETCH + 1, STRETCH + n - 1))
    base = base.select("doc_id", "_text_hash", F.size("_all").alias("n_words"), F.posexplode(cut).alias("_part", "_w"))
    of_part = lambda k: F.slice(window_hashes(F.col("_w"), k), 1, STRETCH)  # noqa: E731 - later ones are the next part's
    document, first = ["doc_id", "_text_hash", "n_words", "_part", "_w"], (F.col("_part") == 0) & (F.coalesce("_k", F.lit(0)) == 0)
    parts = []
    for block in range(blocks):
        gram = F.broadcast(grams.where(F.pmod("hash", F.lit(blocks)) == block).select("hash", "len", "gram", "gram_id"))
        if len(lengths) < 2:  # as a rule all items have n words or more
            k = lengths[0] if lengths else n
            at = base.select(*document, F.posexplode_outer(of_part(k)).alias("_k", "_h"))
            at = at.withColumns({"_len": F.lit(k), "_pos": F.col("_k")})
        else:
            every = F.concat(*(placed(of_part(k), k) for k in lengths))
            at = base.select(*document, F.posexplode_outer(every).alias("_k", "_s")).select(
                *document, "_k", F.col("_s.h").alias("_h"), F.col("_s.len").alias("_len"), F.col("_s.pos").alias("_pos")
            )
        same = (F.col("_h") == F.col("hash")) & (F.col("_len") == F.col("len")) & (F.slice("_w", F.col("_pos") + 1, F.col("_len")) == F.col("gram"))
        hit = at.join(gram, same, "left").where(F.col("hash").isNotNull() | first)
        begin = F.col("_part") * STRETCH + F.col("_pos")
        parts.append(
            hit.select(
                "doc_id",
                "_text_hash",
                "n_words",
                F.when(F.col("hash").isNotNull(), F.struct(begin.alias("pos"), (begin + F.col("_len")).alias("end"))).alias("_at"),
                "gram_id",
                # a document row shows itself once, in the first block
                F.when(first, F.lit(int(block == 0))).otherwise(0).alias("_row"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    grouped = rows.groupBy("doc_id", "_text_hash", "n_words").agg(
        F.sort_array(F.collect_set("_at")).alias("_at"),
        F.collect_set("gram_id").alias("grams"),
        F.sum("_row").alias("_rows"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(
        "_at",
        zero,
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["pos"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    return grouped.select("doc_id", "_text_hash", F.col("n_words").cast("long").alias("n_words"), total.alias("n_hit"), "grams", "_rows")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array of strings), _text_hash."""
    grams, items = benchmark_windows(benchmark, n)
    found = written(hits(docs, grams, n, doc_id, text), "hits")
    key = ["doc_id", "_text_hash", "n_words", "n_hit", "_rows"]
    clean = found.where("n_hit = 0").select(*key, F.array().cast("array<string>").alias("items"))
    dirty = found.where("n_hit > 0").select(*key, F.explode("grams").alias("gram_id")).join(items, "gram_id")
    dirty = dirty.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    alike = F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))).alias("_one")
    return clean.unionByName(dirty).select("doc_id", "n_words", "n_hit", "items", "_text_hash", alike).drop("_one")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents, all columns, without those in which a benchmark window occurs."""
    grams, _ = benchmark_windows(benchmark, n)
    bad = hits(docs, grams, n).where("n_hit > 0").select("doc_id", "_text_hash").distinct()
    return without(docs, written(bad, "contaminated"), F.xxhash64("text"))


def digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """What a report needs of each document, the items as a digest."""
    return scan(docs, benchmark, n).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
