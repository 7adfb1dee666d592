"""The audit rules: an ordered registry of conditions and messages as columns over a page's facts and context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions.text import directives
from webgauge.functions.urls import is_root

WEIGHTS = {"critical": 15, "warning": 5, "notice": 2}
TITLE, META, WORDS, MAX_BYTES, MAX_MS, EXAMPLES = (30, 60), (70, 160), 300, 2 * 1024 * 1024, 2000, 3


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    explanation: str
    check: Callable[[], tuple[Column, Column]]  # when it fires, and its message


RULES: list[Rule] = []


def rule(rule_id: str, severity: str, explanation: str):
    """Registers a function that returns (condition, message) as columns; order of registration is order of issues."""

    def add(check):
        if any(r.rule_id == rule_id for r in RULES):
            raise ValueError(f"rule {rule_id} is registered twice")
        if severity not in WEIGHTS:
            raise ValueError(f"unknown severity {severity}")
        RULES.append(Rule(rule_id, severity, explanation, check))
        return check

    return add


def say(template: str, *values: Column) -> Column:
    """A message with a column for each {}."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:]):
        out += [value.cast("string"), F.lit(text)]
    return F.concat(*out)


c = F.col


@rule("title_missing", "critical", "Nothing names this page in a list of results.")
def _():
    return c("title").isNull(), say("Page has no <title>")


@rule("title_too_short", "warning", "A very short title says too little to be chosen among results.")
def _():
    return F.length("title") < TITLE[0], say('Title is {} characters (minimum 30): "{}"', F.length("title"), c("title"))


@rule("title_too_long", "warning", "Long titles are cut off where results are listed.")
def _():
    return F.length("title") > TITLE[1], say('Title is {} characters (maximum 60): "{}"', F.length("title"), c("title"))


@rule("title_duplicate", "warning", "Pages with one title compete with each other and can't be told apart.")
def _():
    return c("title_count") >= 2, say('Title is used on {} pages: "{}"', c("title_count"), c("title"))


@rule("meta_description_missing", "warning", "Without a description the excerpt shown is taken from anywhere on the page.")
def _():
    return c("meta_description").isNull(), say("Page has no meta description")


@rule("meta_description_too_short", "notice", "A short description leaves most of the excerpt's room unused.")
def _():
    return F.length("meta_description") < META[0], say('Meta description is {} characters (minimum 70): "{}"', F.length("meta_description"), c("meta_description"))


@rule("meta_description_too_long", "notice", "The end of a long description isn't shown.")
def _():
    return F.length("meta_description") > META[1], say(
        'Meta description is {} characters (maximum 160): "{}..."', F.length("meta_description"), F.left("meta_description", F.lit(80))
    )


@rule("meta_description_duplicate", "warning", "One description on several pages describes none of them.")
def _():
    return c("meta_count") >= 2, say("Meta description is used on {} pages", c("meta_count"))


@rule("h1_missing", "warning", "The main heading tells readers and machines what a page is about.")
def _():
    return F.size("h1s") == 0, say("Page has no <h1>")


@rule("h1_multiple", "notice", "Several main headings blur which one names the page.")
def _():
    return F.size("h1s") > 1, say("{} <h1> elements (expected exactly one)", F.size("h1s"))


@rule("thin_content", "warning", "Pages with little text rarely answer a question.")
def _():
    return c("word_count") < WORDS, say("Only {} words of visible text (minimum 300)", c("word_count"))


@rule("canonical_missing", "notice", "A canonical link settles which of several addresses counts.")
def _():
    return c("canonical").isNull(), say("Page has no canonical link")


@rule("canonical_conflict", "warning", "A canonical link to another page of the site gives this page's standing away.")
def _():
    own = (c("canonical_site") == c("page_site")) & (c("page_site") != "")
    return own & (c("canonical_key") != c("final_key")), say("Canonical points to {}, not this page", c("canonical"))


@rule("canonical_off_domain", "critical", "A canonical link to another site asks for this page not to be listed.")
def _():
    own = (c("canonical_site") == c("page_site")) & (c("page_site") != "")
    return c("canonical").isNotNull() & ~own, say("Canonical points off-site to {}", c("canonical"))


@rule("noindex", "critical", "The page asks not to be listed.")
def _():
    return F.arrays_overlap(directives(c("robots_meta")), F.array(F.lit("noindex"), F.lit("none"))), say('Robots meta says "{}"', c("robots_meta"))


@rule("nofollow", "warning", "Links on the page pass nothing on.")
def _():
    return F.arrays_overlap(directives(c("robots_meta")), F.array(F.lit("nofollow"), F.lit("none"))), say('Robots meta says "{}"', c("robots_meta"))


@rule("x_robots_tag", "critical", "A response header restricts listing, unseen in the page itself.")
def _():
    value = c("headers")["x-robots-tag"]
    return value.rlike("(?i)noindex|nofollow|none"), say('X-Robots-Tag header: "{}"', value)


@rule("images_missing_alt", "notice", "Images without an alternative text are nothing to screen readers.")
def _():
    n = c("images_missing_alt")
    return n > 0, say("{} of {} images {} no alt attribute", n, c("images_total"), F.when(n == 1, "has").otherwise("have"))


@rule("broken_links", "critical", "Links to pages that fail lead readers nowhere.")
def _():
    n = F.size("broken")
    return n > 0, say(
        "{} broken internal {}: {}{}",
        n,
        F.when(n == 1, "link").otherwise("links"),
        F.array_join(F.slice("broken", 1, EXAMPLES), ", "),
        F.when(n > EXAMPLES, " ...").otherwise(""),
    )


@rule("orphan_page", "warning", "A page that no other links to is hard to find.")
def _():
    return ~is_root(c("url")) & c("in_sitemap") & (c("inbound") == 0), say("Listed in the sitemap but no internal page links to it")


@rule("redirect_chain", "warning", "Every further redirect costs a round trip.")
def _():
    hops = F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["url"], F.lit(" ("), h["status"].cast("string"), F.lit(")"))), " -> ")
    return F.size("redirect_chain") > 1, say("Reached through {} redirects: {} -> {}", F.size("redirect_chain"), hops, c("final_url"))


@rule("page_too_heavy", "warning", "Heavy pages load slowly on weak connections.")
def _():
    # bytes / 2**20 has few binary digits, so half-even rounding of the double is exact
    return c("bytes") > MAX_BYTES, say("Page weighs {} MB (limit 2 MB)", F.format_string("%.1f", F.bround(c("bytes") / 1048576.0, 1)))


@rule("slow_response", "warning", "Slow answers cost visitors and crawl budget.")
def _():
    return c("elapsed_ms") > MAX_MS, say("Fetched in {} ms (limit 2000 ms)", c("elapsed_ms"))


@rule("lang_missing", "notice", "The language attribute tells translators and screen readers how to read the page.")
def _():
    return c("lang").isNull(), say("<html> has no lang attribute")


@rule("og_missing", "notice", "Shared links show a preview from these tags.")
def _():
    missing = F.concat_ws(", ", F.when(c("og_title").isNull(), "og:title"), F.when(c("og_description").isNull(), "og:description"))
    return missing != "", say("Missing Open Graph tags: {}", missing)


def issue_array(rules: list[Rule] | None = None) -> Column:
    """array<struct<rule_ord, rule_id, severity, message>> of what fires on a row, in order of the registry."""
    found = []
    for at, r in enumerate(RULES if rules is None else rules, 1):
        fires, message = r.check()
        issue = F.struct(F.lit(at).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), message.alias("message"))
        found.append(F.when(F.coalesce(fires, F.lit(False)), issue))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def rules_table(spark: SparkSession) -> DataFrame:
    """The registry as a table: rule_ord, rule_id, severity, weight, explanation."""
    rows = [(i, r.rule_id, r.severity, WEIGHTS[r.severity], r.explanation) for i, r in enumerate(RULES, 1)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, severity string, weight int, explanation string")


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for k, w in WEIGHTS.items():
        out = F.when(severity == k, w).otherwise(out)
    return out
