"""The same results in DuckDB SQL: facts by regular expressions over the derived pages' regular markup."""

from __future__ import annotations

from webgauge.operators.rules import RULES
from webgauge.plans.snapshot import DERIVED, RUNS

RAW = "raw_pages AS (SELECT page_id, url, html FROM pages),"
FACTS = RAW + DERIVED + r""",
c0 AS (SELECT *, regexp_replace(html, '<[A-Za-z/!][^<>]*$', '') AS t,
              regexp_extract(final_url, '^(https?://[^/?#]+)', 1) AS origin FROM p WHERE html IS NOT NULL),
c1 AS (
  SELECT *,
    nullif(trim(regexp_replace(replace(replace(regexp_extract(t, '<title>([^<]*)', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
    nullif(regexp_extract(t, '<meta name="description" content="([^"]*)">', 1), '') AS meta,
    nullif(regexp_extract(t, '<link rel="canonical" href="([^"]*)">', 1), '') AS canon_raw,
    nullif(regexp_extract(t, '<meta name="robots" content="([^"]*)">', 1), '') AS robots,
    CASE WHEN contains(t, '"og:title"') THEN 't' END AS og_title, CASE WHEN contains(t, '"og:description"') THEN 'd' END AS og_description,
    nullif(regexp_extract(t, '<html lang="([a-z]*)">', 1), '') AS lang,
    len(list_filter(regexp_extract_all(t, '<h1>([^<]*)', 1), lambda z: trim(z) <> '')) AS n_h1,
    len(regexp_extract_all(t, '<img ')) AS images_total, len(regexp_extract_all(t, '<img src="/a.png">')) AS images_missing_alt,
    len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
      '<head>.*</head>', '', 's'), '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^<>]*>', ' ', 'g'), '&copy;|&middot;', 'x', 'g'), '\S+')) AS word_count,
    regexp_extract(regexp_extract(url, '^https?://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1) AS site
  FROM c0),
c2 AS (SELECT *, CASE WHEN canon_raw LIKE '/%' THEN origin || canon_raw ELSE canon_raw END AS canonical FROM c1),
f AS (SELECT *, regexp_extract(regexp_extract(canonical, '^https?://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1) AS canon_site,
             regexp_replace(regexp_replace(final_url, '#.*$', ''), '/$', '') AS final_key FROM c2),
l0 AS (SELECT run_id, seq, url, site, origin, unnest(regexp_extract_all(t, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(t, '<a href="([^"]*)"', 1), 1) AS pos FROM f),
l AS (SELECT run_id, seq, url, min(pos) AS pos, key FROM (SELECT *, regexp_replace(origin || replace(replace(href, '&quot;', '"'), '&amp;', '&'), '/$', '') AS key FROM l0 WHERE href <> '') GROUP BY ALL),
inb AS (SELECT run_id, to_url AS url, count(*) AS inbound FROM e GROUP BY ALL),
tc AS (SELECT run_id, replace(lower(title), 'ß', 'ss') AS k, count(*) AS n FROM f WHERE title IS NOT NULL GROUP BY ALL),
mc AS (SELECT run_id, lower(meta) AS k, count(*) AS n FROM f WHERE meta IS NOT NULL GROUP BY ALL),
br AS (SELECT l.run_id, l.url, list(l.key ORDER BY l.pos) AS broken FROM l JOIN p ON p.run_id = l.run_id AND p.url = l.key WHERE p.status >= 400 GROUP BY ALL),
a AS (SELECT f.*, tc.n AS title_count, mc.n AS meta_count, coalesce(inbound, 0) AS inbound, s.url IS NOT NULL AS in_sitemap, coalesce(broken, []) AS broken
      FROM f LEFT JOIN tc ON tc.run_id = f.run_id AND tc.k = replace(lower(f.title), 'ß', 'ss') LEFT JOIN mc ON mc.run_id = f.run_id AND mc.k = lower(f.meta)
      LEFT JOIN inb ON inb.run_id = f.run_id AND inb.url = f.url LEFT JOIN s ON s.run_id = f.run_id AND s.url = f.url
      LEFT JOIN br ON br.run_id = f.run_id AND br.url = f.url)"""

_DIRECTIVES = "list_transform(string_split(coalesce(robots, ''), ','), lambda z: lower(trim(z)))"
#: Condition and message of each rule over ``a``, in the order of the registry.
CHECKS = (
    ("title IS NULL", "'Page has no <title>'"),
    ("length(title) < 30", "'Title is ' || length(title) || ' characters (minimum 30): \"' || title || '\"'"),
    ("length(title) > 60", "'Title is ' || length(title) || ' characters (maximum 60): \"' || title || '\"'"),
    ("title_count >= 2", "'Title is used on ' || title_count || ' pages: \"' || title || '\"'"),
    ("meta IS NULL", "'Page has no meta description'"),
    ("length(meta) < 70", "'Meta description is ' || length(meta) || ' characters (minimum 70): \"' || meta || '\"'"),
    ("length(meta) > 160", "'Meta description is ' || length(meta) || ' characters (maximum 160): \"' || meta[:80] || '...\"'"),
    ("meta_count >= 2", "'Meta description is used on ' || meta_count || ' pages'"),
    ("n_h1 = 0", "'Page has no <h1>'"),
    ("n_h1 > 1", "n_h1 || ' <h1> elements (expected exactly one)'"),
    ("word_count < 300", "'Only ' || word_count || ' words of visible text (minimum 300)'"),
    ("canonical IS NULL", "'Page has no canonical link'"),
    ("canon_site = site AND canonical <> final_key", "'Canonical points to ' || canonical || ', not this page'"),
    ("canonical IS NOT NULL AND canon_site <> site", "'Canonical points off-site to ' || canonical"),
    (f"list_has_any({_DIRECTIVES}, ['noindex', 'none'])", "'Robots meta says \"' || robots || '\"'"),
    (f"list_has_any({_DIRECTIVES}, ['nofollow', 'none'])", "'Robots meta says \"' || robots || '\"'"),
    ("regexp_matches(lower(x_robots_tag), 'noindex|nofollow|none')", "'X-Robots-Tag header: \"' || x_robots_tag || '\"'"),
    ("images_missing_alt > 0", "images_missing_alt || ' of ' || images_total || ' images ' || CASE WHEN images_missing_alt = 1 THEN 'has' ELSE 'have' END || ' no alt attribute'"),
    ("len(broken) > 0", "len(broken) || ' broken internal ' || CASE WHEN len(broken) = 1 THEN 'link' ELSE 'links' END || ': ' || array_to_string(broken[:3], ', ') || CASE WHEN len(broken) > 3 THEN ' ...' ELSE '' END"),
    ("in_sitemap AND inbound = 0 AND regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) NOT IN ('', '/')", "'Listed in the sitemap but no internal page links to it'"),
    ("hops > 1", "'Reached through ' || hops || ' redirects: ' || array_to_string([url || '?hop=' || i || ' (302)' FOR i IN range(1, hops + 1)], ' -> ') || ' -> ' || final_url"),
    ("bytes > 2097152", "'Page weighs ' || format('{:.1f}', bytes / 1048576.0) || ' MB (limit 2 MB)'"),
    ("elapsed_ms > 2000", "'Fetched in ' || elapsed_ms || ' ms (limit 2000 ms)'"),
    ("lang IS NULL", "'<html> has no lang attribute'"),
    ("og_title IS NULL OR og_description IS NULL", "'Missing Open Graph tags: ' || concat_ws(', ', CASE WHEN og_title IS NULL THEN 'og:title' END, CASE WHEN og_description IS NULL THEN 'og:description' END)"),
)
_WEIGHT = "CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 2 END"
ISSUES = (
    FACTS
    + ",\ni AS ("
    + "\nUNION ALL ".join(
        f"SELECT run_id, seq AS page_seq, {n} AS rule_ord, url, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {message} AS message FROM a WHERE {fires}"
        for n, (r, (fires, message)) in enumerate(zip(RULES, CHECKS), 1)
    )
    + f"""),
sc AS (SELECT f.run_id, f.seq, f.url, greatest(0, 100 - coalesce(sum({_WEIGHT}), 0))::INT AS score, count(i.rule_id)::INT AS n_issues,
              count(*) FILTER (severity = 'critical')::INT AS critical, count(*) FILTER (severity = 'warning')::INT AS warning, count(*) FILTER (severity = 'notice')::INT AS notice,
              list(rule_id ORDER BY rule_ord) FILTER (rule_id IS NOT NULL) AS rules
       FROM f LEFT JOIN i ON i.run_id = f.run_id AND i.url = f.url GROUP BY ALL)"""
)


def over(base: str, query: str) -> str:
    return f"WITH {base}\n{query}"


_SORTS = {
    "score_asc": "score, n_issues DESC, url, seq",
    "score_desc": "score DESC, n_issues, url DESC, seq",
    "url_asc": "url, seq",
    "url_desc": "url DESC, seq",
    "issues_asc": "n_issues, seq",
    "issues_desc": "n_issues DESC, seq",
    "status_asc": "status, seq",
    "status_desc": "status DESC, seq",
}
_VIEW = "v AS (SELECT sc.*, p.status, p.final_url FROM sc JOIN p ON p.run_id = sc.run_id AND p.url = sc.url)"
_DIFF = """,
ru AS (SELECT run_id, url, list_distinct(rules) AS rules, score FROM sc),
x1 AS (SELECT url, score, coalesce(rules, []) AS rules FROM ru WHERE run_id = 1), x2 AS (SELECT url, score, coalesce(rules, []) AS rules FROM ru WHERE run_id = 2),
y1 AS (SELECT url, unnest(rules) AS rule_id FROM x1 WHERE url IN (SELECT url FROM x2)), y2 AS (SELECT url, unnest(rules) AS rule_id FROM x2 WHERE url IN (SELECT url FROM x1))"""
_BUCKET = "CASE WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END"
_WEAK = "(starts_with(rule_id, 'title_') OR starts_with(rule_id, 'meta_description_'))"
_SUGGEST = f""",
we AS (SELECT DISTINCT i.run_id, i.url, f.seq FROM i JOIN f ON f.run_id = i.run_id AND f.url = i.url WHERE {_WEAK}),
sg AS (SELECT *, ['ok', 'repaired', 'rejected', 'skipped', 'unavailable'][(seq % 5 + 1)::INT] AS status, seq % 4 = 0 AS cached FROM we),
ca AS (SELECT *, (400 + seq % 300)::BIGINT AS prompt_tokens, (50 + seq % 20)::BIGINT AS completion_tokens FROM (SELECT * FROM sg UNION ALL SELECT * FROM sg WHERE seq % 5 IN (1, 2)))"""

ORACLES = {
    "s03_pages_in_order": over(FACTS, "SELECT run_id, seq, url, status FROM p"),
    "s05_issues_in_order": over(ISSUES, "SELECT run_id, page_seq, rule_ord, url, rule_id FROM i"),
    "s09_suggestions_in_order": over(ISSUES, f"{_SUGGEST} SELECT run_id, url, '=old title ' || seq AS original_title, 'Title ' || seq AS title, '-meta ' || seq AS meta_description, status, cached FROM sg"),
    "s04_redirect_chains": over(FACTS, "SELECT run_id, url, hops::INT AS n_hops, CASE WHEN hops > 0 THEN url || '?hop=1' END AS first_hop, lower(x_robots_tag) AS x_robots_tag FROM p"),
    "s08_sitemap_set": over(FACTS, "SELECT DISTINCT run_id, url FROM s"),
    "p01_titles": over(FACTS, "SELECT run_id, url, title, replace(lower(title), 'ß', 'ss') AS title_key FROM f"),
    "p03_meta_fields": over(FACTS, "SELECT run_id, url, meta AS meta_description, robots AS robots_meta, og_title, og_description, lang FROM f"),
    "p06_canonicals": over(FACTS, "SELECT run_id, url, canonical, canon_site AS canonical_site FROM (SELECT run_id, url, canonical, coalesce(canon_site, '') AS canon_site FROM f)"),
    "p08_h1_counts": over(FACTS, "SELECT run_id, url, n_h1::INT AS n_h1 FROM f"),
    "p10_word_counts": over(FACTS, "SELECT run_id, url, word_count::INT AS word_count FROM f"),
    "p11_image_counts": over(FACTS, "SELECT run_id, url, images_total::INT AS images_total, images_missing_alt::INT AS images_missing_alt FROM f"),
    "p12_page_links": over(FACTS, "SELECT run_id, url, key, (row_number() OVER (PARTITION BY run_id, url ORDER BY pos) - 1)::INT AS pos FROM l"),
    "a01_page_count": over(FACTS, "SELECT run_id, count(*) AS pages, count(html) AS auditable FROM p GROUP BY run_id"),
    "a02_title_frequency": over(FACTS, "SELECT run_id, k AS title_key, n AS title_count FROM tc"),
    "a03_meta_frequency": over(FACTS, "SELECT run_id, k AS meta_key, n AS meta_count FROM mc"),
    "a04_inbound_counts": over(FACTS, "SELECT run_id, url, inbound FROM inb"),
    "j01_broken_links": over(FACTS, "SELECT run_id, url, array_to_string(broken, ' ') AS broken FROM br"),
    "j06_sitemap_flags": over(FACTS, "SELECT run_id, url, in_sitemap, inbound FROM a"),
    "all_issues": over(ISSUES, "SELECT run_id, page_seq, rule_ord, url, rule_id, severity, message FROM i"),
    **{f"r{n:02d}_{r.rule_id}": over(ISSUES, f"SELECT run_id, url, severity, message FROM i WHERE rule_id = '{r.rule_id}'") for n, r in enumerate(RULES, 1)},
    "a05_page_scores": over(ISSUES, "SELECT run_id, url, score FROM sc"),
    "a06_score_histogram": over(ISSUES, f"SELECT r.run_id, b.bucket, count(sc.url) AS pages FROM (SELECT DISTINCT run_id FROM sc) r CROSS JOIN (VALUES ('0-19'), ('20-39'), ('40-59'), ('60-79'), ('80-100')) b(bucket) LEFT JOIN sc ON sc.run_id = r.run_id AND {_BUCKET} = b.bucket GROUP BY ALL"),
    "a07_issues_by_rule": over(ISSUES, "SELECT run_id, rule_id, count(*) AS issues FROM i GROUP BY ALL"),
    "a08_issues_by_severity": over(ISSUES, "SELECT run_id, severity, count(*) AS issues FROM i GROUP BY ALL"),
    "a09_average_score": over(ISSUES, "SELECT run_id, count(*) AS pages_audited, sum(score)::BIGINT AS score_sum, sum(score)::DOUBLE / count(*) AS average FROM sc GROUP BY run_id"),
    "a11_issues_per_page": over(ISSUES, "SELECT run_id, url, count(*) AS issues FROM i GROUP BY ALL"),
    "a12_severity_counts": over(ISSUES, "SELECT run_id, url, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'notice') AS notice FROM i GROUP BY ALL"),
    "a14_rule_sets": over(ISSUES, "SELECT run_id, url, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM i GROUP BY ALL"),
    "a20_severity_line": over(ISSUES, "SELECT run_id, count(*) AS issues, concat_ws(', ', nullif(count(*) FILTER (severity = 'critical'), 0) || ' critical', nullif(count(*) FILTER (severity = 'warning'), 0) || ' warning', nullif(count(*) FILTER (severity = 'notice'), 0) || ' notice') AS line FROM i GROUP BY run_id"),
    "o02_worst_pages": over(ISSUES, "SELECT * FROM (SELECT run_id, url, score, n_issues, (row_number() OVER (PARTITION BY run_id ORDER BY score, n_issues DESC, url))::INT AS place FROM sc WHERE n_issues > 0) WHERE place <= 10"),
    "p17_page_views": over(ISSUES, f", {_VIEW} SELECT run_id, url, status::INT AS status, score, critical, warning, notice, n_issues, array_to_string(rules, ';') AS rules FROM v".replace(", v AS", "", 0)),
    **{f"o04_sorted_{k}": over(ISSUES, f", {_VIEW} SELECT run_id, url, (row_number() OVER (PARTITION BY run_id ORDER BY {o}))::INT AS place FROM v") for k, o in _SORTS.items()},
    "f06_critical_pages": over(ISSUES, "SELECT run_id, url, score FROM sc WHERE critical > 0"),
    "f07_pages_with_rule": over(ISSUES, "SELECT run_id, url, score FROM sc WHERE list_contains(rules, 'thin_content')"),
    "o06_second_page": over(ISSUES, f", {_VIEW} SELECT url, score FROM v WHERE run_id = 1 ORDER BY {_SORTS['score_asc']} LIMIT 20 OFFSET 20"),
    "s19_export_rows": over(ISSUES, f"{_SUGGEST}, {_VIEW} SELECT v.url, v.final_url, v.status::INT AS status, 0 AS depth, score, critical, warning, notice, coalesce(array_to_string(rules, ';'), '') AS issues, coalesce(sg.status, '') AS ai_status, CASE WHEN sg.seq IS NULL THEN '' ELSE '''=old title ' || sg.seq END AS original_title, CASE WHEN sg.seq IS NULL THEN '' ELSE 'Title ' || sg.seq END AS ai_title, '' AS original_meta, CASE WHEN sg.seq IS NULL THEN '' ELSE '''-meta ' || sg.seq END AS ai_meta, '' AS ai_reason FROM v LEFT JOIN sg ON sg.run_id = v.run_id AND sg.url = v.url"),
    "o01_runs": over(RAW + RUNS, "SELECT run_id::BIGINT AS run_id, start_url, status, pages::BIGINT AS pages FROM runs"),
    "j09_live_page_counts": over(f"{FACTS.rstrip()}, {RUNS}", "SELECT run_id::BIGINT AS run_id, status, CASE WHEN status = 'running' THEN (SELECT count(*) FROM p WHERE p.run_id + 5 = runs.run_id) ELSE pages END::BIGINT AS pages FROM runs"),
    "f10_previous_runs": over(RAW + RUNS, "SELECT run_id::BIGINT AS run_id, max(CASE WHEN status <> 'failed' THEN run_id END) OVER (PARTITION BY start_url ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS previous FROM runs"),
    "f11_stale_runs": over(RAW + RUNS, "SELECT run_id::BIGINT AS run_id, status = 'running' AND started_at < TIMESTAMP '2024-02-20 10:00:00' - INTERVAL 1800 SECOND AS stale FROM runs"),
    "a23_failure_streaks": over(FACTS, ", z AS (SELECT run_id, seq, status, CASE WHEN status >= 400 THEN 0 ELSE status END AS st FROM p), g AS (SELECT run_id, seq, st, sum(CASE WHEN st <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS k FROM z) SELECT run_id::BIGINT AS run_id, min(seq)::BIGINT AS first_seq, count(*) AS failures FROM g WHERE st = 0 GROUP BY run_id, k"),
    "d01_snapshot": over(ISSUES, f"{_DIFF} SELECT url, score, array_to_string(list_sort(rules), ',') AS rules FROM x1"),
    "d02_pages_added": over(ISSUES, f"{_DIFF} SELECT url FROM x2 EXCEPT SELECT url FROM x1"),
    "d02_pages_removed": over(ISSUES, f"{_DIFF} SELECT url FROM x1 EXCEPT SELECT url FROM x2"),
    "d03_score_changes": over(ISSUES, f"{_DIFF} SELECT x1.url, x1.score AS before, x2.score AS after, x2.score - x1.score AS delta FROM x1 JOIN x2 USING (url) WHERE x1.score <> x2.score"),
    "d04_issues_fixed": over(ISSUES, f"{_DIFF} SELECT * FROM y1 EXCEPT SELECT * FROM y2"),
    "d04_issues_introduced": over(ISSUES, f"{_DIFF} SELECT * FROM y2 EXCEPT SELECT * FROM y1"),
    "d05_diff_totals": over(ISSUES, f"{_DIFF} SELECT (SELECT count(*) FROM x1) AS pages_before, (SELECT sum(score) FROM x1)::BIGINT AS sum_before, (SELECT count(*) FROM x2) AS pages_after, (SELECT sum(score) FROM x2)::BIGINT AS sum_after, (SELECT count(*) FROM x2 ANTI JOIN x1 USING (url)) AS added, (SELECT count(*) FROM x1 ANTI JOIN x2 USING (url)) AS removed, (SELECT count(*) FROM x1 JOIN x2 USING (url) WHERE x1.score <> x2.score) AS changed, (SELECT count(*) FROM (SELECT * FROM y1 EXCEPT SELECT * FROM y2)) AS fixed, (SELECT count(*) FROM (SELECT * FROM y2 EXCEPT SELECT * FROM y1)) AS introduced, false AS is_empty"),
    "ai01_weak_pages": over(ISSUES, f"SELECT DISTINCT run_id, url FROM i WHERE {_WEAK}"),
    "a15_ai_usage": over(ISSUES, f"{_SUGGEST} SELECT count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM ca"),
    "a16_ai_statuses": over(ISSUES, f"{_SUGGEST} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (cached) AS cached FROM sg"),
    "a19_cost_by_page": over(ISSUES, f"{_SUGGEST} SELECT run_id, url, count(*) AS calls, sum(prompt_tokens * 250 + completion_tokens * 1000)::BIGINT AS micro_cents FROM ca GROUP BY ALL"),
    "a21_budget_window": over(ISSUES, f"{_SUGGEST} SELECT run_id, url, sum(prompt_tokens) OVER (PARTITION BY run_id ORDER BY seq) <= 20000 AS affordable FROM (SELECT run_id, url, seq, any_value(prompt_tokens) AS prompt_tokens FROM ca GROUP BY ALL)"),
    "ai_cache_key": over(FACTS, "SELECT run_id, url, sha256(url || chr(31) || coalesce(title, '') || chr(31) || coalesce(meta, '') || chr(31) || '' || chr(31) || 'm' || chr(31) || '1') AS key FROM f"),
    "v01_length_checks": over(FACTS, "SELECT run_id, url, CASE WHEN length(title) < 30 THEN 'title_too_short' WHEN length(title) > 60 THEN 'title_too_long' ELSE '' END AS code FROM f WHERE title IS NOT NULL"),
    "x05_sites": over(FACTS, "SELECT DISTINCT url, regexp_extract(regexp_extract(url, '^https?://([^/?#:]+)', 1), '([^.]+\\.[^.]+)$', 1) AS site FROM p"),
    "x01_keys": over(FACTS, "SELECT DISTINCT final_url, regexp_replace(regexp_replace(final_url, '#.*$', ''), '/$', '') AS key, regexp_replace(final_url, '#.*$', '') AS url FROM p WHERE status = 200"),
    "x26_formula_guard": "SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS guarded FROM documents",
    "x13_clean_text": "SELECT doc_id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '') AS cleaned FROM documents",
    "t04_seeds": over(FACTS, "SELECT url, min(pos) + 1 AS pos FROM (SELECT url, -1::BIGINT AS pos FROM p WHERE run_id = 1 AND seq = 7 UNION ALL SELECT url, seq::BIGINT FROM p WHERE run_id = 1 AND seq % 3 = 0) GROUP BY url"),
    "c01_breadth_first": "WITH RECURSIVE " + FACTS + ", g AS (SELECT url, 0 AS depth FROM p WHERE run_id = 1 AND seq IN (1, 2, 3) UNION SELECT e.to_url, g.depth + 1 FROM g JOIN e ON e.from_url = g.url AND e.run_id = 1 WHERE g.depth < 4) SELECT url, min(depth)::INT AS depth FROM g GROUP BY url",
}
ORACLES = {k: q.replace(")\n, ", "),\n").replace(")\n,\n", "),\n") for k, q in ORACLES.items()}
