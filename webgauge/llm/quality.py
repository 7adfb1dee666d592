"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only. The measures of a document come from arrays within its row, so the texts are read once
and never shuffled. Documents are then counted by their pattern of votes (at most 3**rules patterns, whatever the
input), and on those counts EM estimates each rule's accuracy on good and on bad documents. The posterior of
'good' is a sum of one weight per vote; a document stays if it is at least one half and no base limit is broken.

Defined results: null and empty texts have no words and fail the base limit. Repeated rows are answered one by one.
An empty table gives an empty table. With equal evidence a document is kept. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.llm.shared import without, written

#: Fixed value: words are what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
ROUNDS = 60


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words in windows of n words that occur twice or more in the array."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))

    def repeated(found: Column) -> Column:
        def covered(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            )
            return F.aggregate(
                F.sort_array(F.transform(twice, lambda x: x["at"])),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, at: F.struct((at + n).alias("end"), (a["n"] + n - F.greatest(F.lit(0), a["end"] - at)).alias("n")),
                lambda a: a["n"],
            )

        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(ordered, covered))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.when(F.size(hashes) > n, let(windows(hashes), repeated)).otherwise(F.lit(0)),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named, with the measures (long) and n_lines, n_letters for the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    return docs.select(
        *keep,
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    ).select(
        *keep,
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
        "n_letters",
    )


def ballots() -> dict[str, Column]:
    """Votes of the rules: 1 good, -1 bad, 0 none."""

    def vote(bad: Column, good: Column, known: Column = F.lit(True)) -> Column:
        return F.when(~known, 0).when(bad, -1).when(good, 1).otherwise(0)

    c = F.col
    some = c("n_words") > 0
    return {
        "length": vote(c("n_words") < MIN_WORDS, c("n_words") >= 50),
        "word_length": vote((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")), c("word_chars").between(4 * c("n_words"), 9 * c("n_words")), some),
        "symbols": vote(10 * c("n_symbols") > c("n_words"), 100 * c("n_symbols") <= c("n_words"), some),
        "letters": vote(100 * c("n_letters") < 88 * c("word_chars"), 100 * c("n_letters") >= 93 * c("word_chars"), some),
        "lines": vote(10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0, c("n_lines") > 1),
        "repeats": vote(10 * c("n_repeat_words") > c("n_words"), 100 * c("n_repeat_words") <= c("n_words"), c("n_words") > WINDOW),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> dict:
    """Prior of 'good' and each rule's accuracies on good and on bad documents, from counted vote patterns.

    Starts from 'good' being common and rules being right mostly. Two pseudo-votes a class hold rules that
    hardly ever vote near their start.
    """
    prior, good, bad = 0.8, [0.9] * rules, [0.6] * rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass, right, seen = 0.0, [[0.9 * 2, 0.6 * 2] for _ in range(rules)], [[2.0, 2.0] for _ in range(rules)]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(votes, prior, good, bad)))))
            mass += n * p
            for j, v in enumerate(votes):
                if v:
                    seen[j][0] += n * p
                    seen[j][1] += n * (1 - p)
                    right[j][v < 0] += n * (p if v > 0 else 1 - p)
        prior = min(0.999, max(0.001, (mass + 1) / (total + 2)))
        good = [min(0.999, max(0.5, r[0] / s[0])) for r, s in zip(right, seen)]
        bad = [min(0.999, max(1 - g + 0.001, r[1] / s[1])) for r, s, g in zip(right, seen, good)]  # better than chance together
    return {"prior": prior, "good": good, "bad": bad}


def log_odds(votes, prior, good, bad) -> float:
    out = math.log(prior / (1 - prior))
    for v, g, b in zip(votes, good, bad):
        if v:
            out += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b)
    return out


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """Measures, votes' posterior, base_failed and kept for every document; the texts are read once."""
    table = written(measured(docs, *keep), "measures")
    votes = ballots()
    counted = table.groupBy(*[v.cast("int").alias(k) for k, v in votes.items()]).count().collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(r)[:-1], r["count"]) for r in counted)
    e = estimate(patterns, len(votes))
    odds = F.lit(math.log(e["prior"] / (1 - e["prior"])))
    for (_, v), g, b in zip(votes.items(), e["good"], e["bad"]):
        odds = odds + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return table.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumns(
        {"base_failed": failed, "kept": ~failed & (F.col("p_good") >= 0.5)}
    )


def report(docs: DataFrame) -> DataFrame:
    return judged(docs, "doc_id").select("doc_id", *MEASURES, "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that pass; rejection is looked up by id and text together."""
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    bad = written(judged(keyed, "_id", "_hash").where(~F.col("kept")).select("_id", "_hash").distinct(), "rejected")
    return without(docs, bad, F.xxhash64(F.coalesce("text", F.lit(""))))
