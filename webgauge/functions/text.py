"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reads as an instruction to a model, in the order of removal.
INSTRUCTIONS = (
    r"(?imd)^[ \t]*(?:system|assistant|user|human|ai)\s*:[^\n]*\n?",
    r"(?i)<\|[^|>]*\|>[^\n]*\n?",
    r"(?i)\[/?INST\][^\n]*",
    r"(?i)ignore\s+(?:all\s+|any\s+)?(?:the\s+|of\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|directions?|rules?|messages?)[^.\n]*[.\n]?",
    r"(?i)disregard\s+(?:all\s+|any\s+)?(?:the\s+|of\s+)?(?:previous|prior|above|earlier)[^.\n]*[.\n]?",
    r"(?i)new\s+instructions?\s*:[^.\n]*[.\n]?",
    r"(?i)you\s+are\s+now\s+(?:a|an|the)\s+[^.\n]*[.\n]?",
)
#: White space of Unicode and the four separators that count as such.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def clean(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def directives(x: Column) -> Column:
    """The set of a robots meta's directives."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def content_type(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(x, F.lit(";"), F.lit(1)))), F.lit(""))


def charset(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?i)charset=[\"']?([^;\"'\s]+)", 1), F.lit("")), F.lit("utf-8"))


def retry_after(x: Column) -> Column:
    return F.when(x.try_cast("double") >= 0, x.try_cast("double"))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def strip_instructions(text: Column) -> tuple[Column, Column]:
    """(text without instruction-like parts, how many were removed); untouched if there are none."""
    steps = [text]
    for pattern in INSTRUCTIONS:
        steps.append(F.regexp_replace(steps[-1], pattern, " "))
    removed = reduce(lambda a, b: a + b, (F.regexp_count(before, F.lit(p)) for before, p in zip(steps, INSTRUCTIONS)))
    return F.when(removed == 0, text).otherwise(strip(F.regexp_replace(steps[-1], r"[ \t]{2,}", " "))), removed


def fenced(text: Column, label: str) -> Column:
    return F.concat(F.lit(f"<{label}>\n"), F.replace(text, F.lit(f"</{label}>"), F.lit(f"&lt;/{label}&gt;")), F.lit(f"\n</{label}>"))


def for_prompt(text: Column, label: str, most: int) -> Column:
    return fenced(F.left(strip_instructions(text)[0], F.lit(most)), label)


def squash(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))


def as_text(x: Column) -> Column:
    """A cell that a spreadsheet would take for a formula is marked as text."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def cache_key(url: Column, title: Column, meta: Column, body: Column, model: str, version: str) -> Column:
    parts = [url, F.coalesce(title, F.lit("")), F.coalesce(meta, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(2000)), F.lit(model), F.lit(version)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def source_text(title: Column, meta: Column, body: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in (title, meta, body)))
