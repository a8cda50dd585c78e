"""SQL twins of the queries that SQL can express.

Left out: models (URL filter, LM, toxicity), hashes that SQL lacks (mixing), near-duplicates and fuzzy
passages, whose plain SQL compares all pairs. Tests compare those with brute force.
"""

from __future__ import annotations

# fixed values: the patterns of the query contracts
WORD = r"[^\x20\x09-\x0D]+"
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS five FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS spot FROM (SELECT *, count(*) OVER (PARTITION BY rid, five) AS n FROM g) WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  {_count('#*$%&|<>')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ ]'))) AS n_lines,
  {_count('A-Z')} AS n_upper, {_count('!?')} AS n_marks, {_count(r'\p{L}')} AS n_letters
FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d) d LEFT JOIN r ON r.rid = d.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 5 AND 10 * n_dup_lines > 4 * n_lines) OR 2 * n_upper > word_chars
    OR 2 * n_marks > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_letters < word_chars) AS kept
FROM b
"""

OP4 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS spot FROM l WHERE regexp_matches(line, '{WORD}')),
win AS (SELECT doc_id, spot, concat(line, chr(10), lead(line) OVER w, chr(10), lead(line, 2) OVER w) AS three, lead(line, 2) OVER w IS NOT NULL AS whole
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
again AS (SELECT doc_id, spot FROM (SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, spot) AS n FROM win WHERE whole) WHERE n > 1),
gone AS (SELECT DISTINCT s.doc_id, s.ln FROM again a JOIN s ON s.doc_id = a.doc_id AND s.spot BETWEEN a.spot AND a.spot + 2),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS body FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.ln = l.ln GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN coalesce(body, '') ELSE text END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id) r ON r.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)
"""


def _normal(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{NORMAL_WORD}')"


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_normal('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_normal('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
pos AS (SELECT rid, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM win) ON len(w) >= k)),
found AS (SELECT rid, i, pos.k, item FROM pos JOIN win ON win.k = pos.k AND win.g = pos.g),
hit AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS spot FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.rid = d.rid LEFT JOIN items ON items.rid = d.rid
"""

ORACLES: dict[str, str] = {
    "op3_quality_rules": OP3,
    "op4_line_dedup": OP4,
    "op5_warc": OP5,
    "op8_decontamination": OP8,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
