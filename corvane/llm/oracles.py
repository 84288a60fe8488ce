"""DuckDB SQL for operators whose results SQL can express by brute force."""

from __future__ import annotations

from . import pii, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(ids: str, links: str) -> str:
    """CTEs ``linked(a, b)``, both ways, and ``reach(id, least)`` by repeated relaxation from the tables ids(id) and links(a, b)."""
    return f"""
linked AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
walk(id, seen) AS (SELECT id, id FROM {ids} UNION SELECT walk.id, linked.b FROM walk JOIN linked ON linked.a = walk.seen),
reach AS (SELECT id, min(seen) AS least FROM walk GROUP BY id)"""


MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w
),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id > y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM common JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
{_components("w", "links")}
SELECT reach.id AS doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id, least = reach.id AS kept FROM reach LEFT JOIN n ON n.id = reach.id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
ids AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id > y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_components("ids", "links")},
many AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, least AS component_id, least = id AS kept FROM reach LEFT JOIN many ON many.a = reach.id
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
l AS (
    SELECT doc_id, host, len(w) AS words, raw, array_to_string(w, ' ') AS line FROM (
        SELECT doc_id, host, raw, regexp_extract_all({_LOWER.replace("text", "raw")}, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM d)) WHERE len(w) > 0
),
hot AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT doc_id) > {quality.MAX_HOST_DOCS}),
gone AS (SELECT doc_id, sum(words) AS removed_words, count(*) AS removed_lines FROM l JOIN hot USING (host, line) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM l GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 4),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
m AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND n_words - removed_words >= {quality.MIN_WORDS} AND 100 * (n_words - removed_words) >= {quality.MIN_LEFT_PERCENT} * n_words AS kept
FROM m
"""

REPEATS = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM b WHERE octet_length(b) >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS fresh FROM later),
grouped AS (SELECT doc_id, i, sum(CASE WHEN fresh IS NULL OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM grouped GROUP BY doc_id, g),
gaps AS (
    SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM runs
    UNION ALL SELECT b.doc_id, coalesce(max(runs.z), 0) + 1, octet_length(any_value(b.b)) FROM b LEFT JOIN runs USING (doc_id) GROUP BY b.doc_id
),
kept AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(hex(b.b[a:z]), '' ORDER BY a) FILTER (z >= a), ''))) AS kept_sha256 FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

#: The same kinds without look-behind, which DuckDB's expressions lack; a word boundary stands for it.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_CHECKS = {
    "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT WHEN reverse({_DIGITS})[i]::INT > 4 THEN reverse({_DIGITS})[i]::INT * 2 - 9 ELSE reverse({_DIGITS})[i]::INT * 2 END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END::BIGINT)), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1",
}


def pii_sql() -> str:
    parts = []
    for order, k in enumerate(pii.KINDS):
        p = _PATTERNS[k.name]
        # a match's end: the lengths of the pieces and matches up to it
        parts.append(rf"""
    SELECT doc_id, {order} AS o, '{k.name}' AS kind, e - length(m) AS s, e, m,
        least({k.confirmed} + CASE WHEN regexp_matches(substr(text, greatest(e - length(m) - {pii.CONTEXT}, 0) + 1, e - length(m) - greatest(e - length(m) - {pii.CONTEXT}, 0)) || ' ' || substr(text, e + 1, {pii.CONTEXT}), '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{k.context})') THEN 0.3 ELSE 0 END, 1.0)::DOUBLE AS score
    FROM (SELECT doc_id, text, ms[i] AS m, (list_sum(list_transform(ms[1:i], lambda x: length(x))) + list_sum(list_transform(gs[1:i], lambda x: length(x))))::BIGINT AS e
        FROM (SELECT doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM d)))
    WHERE {_CHECKS.get(k.name, "TRUE")}""")
    counts = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
x AS (SELECT * FROM f WHERE kind IN ({", ".join(f"'{k.name}'" for k in pii.KINDS if k.base)}) OR round(score, 2) >= {pii.THRESHOLD}),
g AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS)},
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, string_agg(printf('%.2f', score), ',' ORDER BY o, s) AS scores
    FROM x GROUP BY doc_id
)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)
"""
