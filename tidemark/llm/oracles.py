"""DuckDB SQL of the queries that SQL can express, independent of the operators."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR_DUP = f"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 3), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d JOIN m ON d.doc_id = m.id LEFT JOIN n ON d.doc_id = n.doc_id"""


def _spans(kind: str, order: int, pattern: str, test: str) -> str:
    """(doc_id, k, kind, s, e) of the matches that pass ``test`` on x, by the parts between them."""
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, s, s + length(x) AS e FROM (
  SELECT doc_id, x, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda y: length(y))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda y: length(y))), 0) AS bigint) AS s
  FROM (SELECT doc_id, found, gaps, i, found[i] AS x FROM (
    SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL)))) WHERE {test}"""


_KEY = "[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"""({_KEY})["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
#: kind, pattern, and what a match x must meet; written for this SQL, in the order of the contract and then of the method.
_KINDS = (
    ("assign", _ASSIGN, f"length(regexp_extract(x, '{_ASSIGN}', 2)) >= 8"),
    ("access", "AKIA[0-9A-Z]+", "length(x) >= 16"),
    ("hex", "[a-f0-9]+", "length(x) >= 32"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("github", "gh[oprsu]_[0-9A-Za-z]{36,}", "true"),
    ("slack", "xox[abprs]-[0-9A-Za-z-]{10,}", "true"),
    ("jwt", "eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}", "true"),
    ("basic", r"[a-z]+://[^ \t-\r:/@]+:[^ \t-\r:/@]{3,}@[0-9A-Za-z.-]+", "true"),
)


def secret_scan() -> str:
    each = " UNION ALL ".join(_spans(kind, k, pattern, test) for k, (kind, pattern, test) in enumerate(_KINDS))
    base = [kind for kind, _, _ in _KINDS[:3]]
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kind}" for i, kind in enumerate(base))
    shown = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""WITH f AS ({each}), g AS (SELECT doc_id, {counts}, {shown} FILTER (WHERE k < 3) AS base, {shown} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


REPEATED = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS h FROM i),
r AS (SELECT h, min(doc_id) AS low, max(doc_id) AS high FROM g GROUP BY h HAVING count(*) > 1),
f AS (SELECT g.h, min(g.pos) AS pos FROM g JOIN r ON g.h = r.h AND g.doc_id = r.low GROUP BY g.h),
x AS (SELECT g.doc_id, g.pos, CASE WHEN g.doc_id = r.low THEN r.high ELSE r.low END AS other, CASE WHEN g.doc_id = r.low AND g.pos = f.pos THEN 0 ELSE 1 END AS extra FROM g JOIN r ON g.h = r.h JOIN f ON f.h = g.h),
y AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM x),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM y),
v AS (SELECT doc_id, span, pos, lead(pos) OVER (PARTITION BY doc_id, span ORDER BY pos) AS ahead FROM z WHERE extra = 1),
u AS (SELECT doc_id, span, CAST(sum(least(50, coalesce(ahead - pos, 50))) AS bigint) AS removable FROM v GROUP BY doc_id, span)
SELECT z.doc_id, CAST(min(z.pos) AS bigint) AS start, CAST(max(z.pos) + 50 AS bigint) AS "end", CAST(max(z.pos) + 50 - min(z.pos) AS bigint) AS n_words, coalesce(max(u.removable), 0) AS removable, min(z.other) AS other_doc_id
FROM z LEFT JOIN u ON u.doc_id = z.doc_id AND u.span = z.span GROUP BY z.doc_id, z.span"""
