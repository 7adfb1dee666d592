"""The operators' results in DuckDB SQL, where SQL can express them."""


def _add(cost: str, letter: str, x: str) -> str:
    """A cost of twelve digits with its audit behind it, after one more edit before it."""
    return f"(lpad((substr({x}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || substr({x}, 13))"


def _edits(q: int) -> str:
    """The cheapest, least way on from pattern state q before a row."""
    keeps = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[q]
    kept = "".join(f" WHEN d.initial = '{i}' THEN {_add('d.more', 'K', f'c{n}')}" for i, n in keeps)
    rest = _add("2 + d.more", "R", f"c{keeps[-1][1]}")
    return f"least({_add('3', 'D', f'c{q}')}, CASE WHEN NOT d.gone THEN {rest} END, CASE WHEN d.gone THEN NULL{kept} END)"


def _inserts(prefix: str, to: str) -> str:
    """Costs with inserts: after s or at the start a u, after u an a, after a a u."""
    two = f"least({prefix}2, {_add('2', 'I', f'{prefix}3')})"
    of = {0: f"least({prefix}0, {_add('2', 'I', two)})", 1: f"least({prefix}1, {_add('2', 'I', two)})", 2: two, 3: f"least({prefix}3, {_add('2', 'I', f'{prefix}2')})"}
    return ", ".join(f"{x} AS {to}{q}" for q, x in of.items())


REPAIR = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
l AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(s, '')])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) % 20 AS lot FROM t),
r AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
             CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM l WHERE lot <> 0),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text), copy) AS pos,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM r),
d AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
             core = '' OR again AS gone, CASE WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS more,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS odd FROM f),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM d GROUP BY conv_id),
e AS (SELECT '000000000000' AS e0, '500000000000' AS e1, '500000000000' AS e2, '000000000000' AS e3),
w AS (SELECT conv_id, n AS pos, {_inserts("e", "c")} FROM n, e UNION ALL
      SELECT conv_id, pos - 1 AS pos, {_inserts("e", "c")} FROM (
        SELECT d.conv_id, d.pos, {", ".join(f"{_edits(q)} AS e{q}" for q in range(4))} FROM w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.pos = w.pos)),
a AS (SELECT conv_id, substr(c0, 1, 12)::BIGINT AS cost, substr(c0, 13) AS audit FROM w WHERE pos = 0),
x AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM a WHERE audit <> ''),
y AS (SELECT *, substr(audit, i, 1) AS letter, len(replace(audit, 'D', '')) % 2 AS whole FROM x),
z AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS o FROM y),
s AS (SELECT z.conv_id, string_agg(CASE WHEN letter = 'K' THEN d.role WHEN (o + whole) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE d.text END, chr(10) ORDER BY i) AS out
      FROM z LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM z.conv_id AND d.pos = z.pos WHERE letter <> 'D' GROUP BY z.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLES = {
    "op1_suffix_array": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row_no, doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT row_no, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
r AS (SELECT row_no, i FROM w JOIN f USING (k) WHERE doc_id > least),
s AS (SELECT row_no, i, sum(new) OVER (PARTITION BY row_no ORDER BY i) AS span
      FROM (SELECT row_no, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_no ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r)),
g AS (SELECT row_no, span, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY row_no, span),
e AS (SELECT row_no, a, b, coalesce(lag(b) OVER (PARTITION BY row_no ORDER BY a), 0) AS p FROM g),
k AS (SELECT row_no, count(*) AS n_spans, sum(b - a) AS n_removed,
             string_agg(substr(h, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept
      FROM e JOIN d USING (row_no) GROUP BY row_no)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (row_no)""",
    "op3_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS share
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT share FROM l WHERE share * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT share FROM c) * weight, cap::DOUBLE)) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(ratio)::BIGINT AS sure, ratio - floor(ratio) AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS score FROM p),
z AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY score, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
      FROM q WHERE score IS NOT NULL),
f AS (SELECT *, sure + CASE WHEN reached + size / 2.0 <= target - sure * source_size THEN 1 ELSE 0 END AS copies FROM z
      UNION ALL SELECT *, 0 AS reached, sure AS copies FROM q WHERE score IS NULL)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM f""",
    "op4_block_anchors": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT row_no, doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS k
      FROM (SELECT row_no, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
r AS (SELECT DISTINCT row_no, j FROM (SELECT row_no, unnest(range(i, i + 50)) AS j FROM w JOIN f USING (k) WHERE doc_id > least)),
g AS (SELECT row_no, count(*) AS n, list(j) AS js FROM r GROUP BY row_no)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE [x[1] FOR x IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(js, x[2])] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (row_no)""",
    "op5_bbit_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id""",
    "op8_decontaminate": r"""
WITH w AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(ws)) AS n, ws[i : i + least(10, len(ws)) - 1] AS gram
      FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM g),
o AS (SELECT row_no, n, i, ws[i : i + n - 1] AS gram
      FROM (SELECT row_no, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, k WHERE len(ws) >= n)),
h AS (SELECT o.row_no, o.i, o.n, g.item FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
c AS (SELECT row_no, count(DISTINCT j) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS j FROM h) GROUP BY row_no),
m AS (SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row_no)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (row_no) LEFT JOIN m USING (row_no)""",
    "op9_warc_chain": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
             list_aggregate([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]) FOR i IN range(32)], 'string_agg', '') AS payload_digest
      FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS most FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < most THEN most END AS refers_to, true AS valid
FROM m""",
    "op11_treap_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
m AS (SELECT r, doc_id, 75 + (25 * len(ws)::BIGINT * n_docs) // n_terms AS m FROM d, g WHERE len(ws) > 0),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
i AS (SELECT row_number() OVER () AS q, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
      FROM benchmark),
k AS (SELECT q, item_id, t, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM k JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20""",
    "op12_conversation_repair": REPAIR,
    "op13_projection_passes": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x AS x, x AS y FROM n UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT c.x, min(vec_id) AS least FROM c JOIN v ON v.r = c.y GROUP BY c.x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN n ON n.x = r LEFT JOIN m ON m.x = r""",
}
