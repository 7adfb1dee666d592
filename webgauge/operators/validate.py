"""Mechanical checks of a suggested title and description against what the page says, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.text import squash

TITLE_RANGE, META_RANGE, DIAGNOSIS_MAX = (30, 60), (70, 160), 300
#: Tokens of numbers, prices and percentages; claims that a page must make itself; endings of cut-off text.
NUMBER = r"(?U)[$€£]\s?\d[\d,]*(?:\.\d+)?%?|\d[\d,]*(?:\.\d+)?%?"
CLAIMS = (
    "#1", "no. 1", "number one", "best", "free shipping", "free delivery", "guaranteed", "guarantee", "award-winning", "award winning", "official",
    "cheapest", "lowest price", "24/7", "money-back", "certified", "world's", "top-rated", "top rated", "fastest", "largest", "leading",
)
DANGLING_ENDINGS = ("-", ",", ":", ";", "(", "[", "{", "...", "…", "&", "/")
DANGLING_WORDS = ("the", "a", "an", "and", "or", "of", "with", "for", "to", "in", "on", "at", "by", "from", "your", "our", "their", "its")
VIOLATION = "struct<field:string,code:string,detail:string>"


def violation(field: str, code: str, detail: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), detail.alias("detail"))


def listed(*checks: tuple[Column, Column]) -> Column:
    """The violations whose condition holds."""
    found = F.array(*[F.when(F.coalesce(fails, F.lit(False)), v) for fails, v in checks])
    return F.filter(found, lambda v: v.isNotNull())


def length(field: str, text: Column) -> Column:
    low, high = TITLE_RANGE if field == "title" else META_RANGE
    prefix, n = ("title" if field == "title" else "meta"), F.length(text)
    count = n.cast("string")
    return listed(
        (n < low, violation(field, f"{prefix}_too_short", F.concat(count, F.lit(f" long, at least {low} wanted")))),
        (n > high, violation(field, f"{prefix}_too_long", F.concat(count, F.lit(f" long, at most {high} allowed")))),
    )


def diagnosis(text: Column) -> Column:
    return listed(
        (F.coalesce(text, F.lit("")) == "", violation("diagnosis", "diagnosis_empty", F.lit("the diagnosis is blank"))),
        (F.length(text) > DIAGNOSIS_MAX, violation("diagnosis", "diagnosis_too_long", F.concat(F.length(text).cast("string"), F.lit(f" long, at most {DIAGNOSIS_MAX} allowed")))),
    )


def unchanged(title: Column, meta: Column, old_title: Column, old_meta: Column) -> Column:
    return listed(
        (title == old_title, violation("title", "title_unchanged", F.lit("same as before"))),
        (meta == old_meta, violation("meta_description", "meta_unchanged", F.lit("same as before"))),
    )


def invented_numbers(text: Column, source: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: ~F.contains(squash(source), squash(t)))


def invented_claims(text: Column, source: Column) -> Column:
    def found(said: Column, known: Column) -> Column:
        tests = []
        for claim in CLAIMS:
            pattern = rf"(?U)(?<![\w-]){re.escape(claim)}(?![\w-])"
            # a plain search goes first: the pattern, tried at every character, is for texts that hold the claim at all
            says, knows = (x.contains(claim) & x.rlike(pattern) for x in (said, known))
            tests.append(F.when(says & ~knows, F.lit(claim)))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    # an array of one element binds the lower-cased texts, which would be made anew for each claim otherwise
    both = F.array(F.struct(F.lower(text).alias("said"), F.lower(source).alias("known")))
    return F.get(F.transform(both, lambda x: found(x["said"], x["known"])), F.lit(0))


def invented(field: str, text: Column, source: Column) -> Column:
    found = F.concat(invented_numbers(text, source), invented_claims(text, source))
    names = F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    return listed((F.size(found) > 0, violation(field, "invented_fact", F.concat(names, F.lit(" isn't in the source")))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def truncation(text: Column, source: Column) -> Column:
    """Why a text looks cut off, null if it doesn't; the first reason counts."""
    s = F.regexp_replace(text, r"(?U)\s+$", "")
    ends = F.lit(False)
    for e in DANGLING_ENDINGS:
        ends = ends | s.endswith(e)
    quotes = F.regexp_count(s, F.lit('"')) % 2 != 0
    brackets = F.regexp_count(s, F.lit(r"\(")) != F.regexp_count(s, F.lit(r"\)"))
    last = F.element_at(F.when(F.size(words(s)) > 0, words(s)), -1)
    # arrays of one element bind the last word and the source's words, which would be found anew for each word otherwise
    half = lambda known, x: ~F.array_contains(known, x) & F.exists(known, lambda w: w.startswith(x) & (w != x))
    cut = F.exists(F.array(last), lambda x: F.exists(F.array(words(source)), lambda known: half(known, x)))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    return (
        F.when(s == "", None)
        .when(ends, F.concat(F.lit("stops at "), quoted(F.right(s, F.lit(1)))))
        .when(quotes | brackets, "a quote or bracket stays open")
        .when(last.isNull(), None)
        .when(last.isin(*DANGLING_WORDS), F.concat(F.lit("stops after "), quoted(last)))
        .when(cut, F.concat(quoted(last), F.lit(" is half a word")))
    )


def truncated(field: str, text: Column, source: Column) -> Column:
    reason = truncation(text, source)
    return listed((reason.isNotNull(), violation(field, "truncated", reason)))


def violations(title: Column, meta: Column, why: Column, old_title: Column, old_meta: Column, source: Column) -> Column:
    """All violations of a suggestion, in the order of the checks."""
    return F.concat(
        length("title", title),
        length("meta_description", meta),
        diagnosis(why),
        unchanged(title, meta, old_title, old_meta),
        invented("title", title, source),
        truncated("title", title, source),
        invented("meta_description", meta, source),
        truncated("meta_description", meta, source),
    )


def bullets(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda v: F.concat(F.lit("- "), v["field"], F.lit(": "), v["code"], F.lit(" ("), v["detail"], F.lit(")"))), "\n")
