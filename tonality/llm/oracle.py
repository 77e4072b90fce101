"""DuckDB SQL for the operators that SQL can express; written apart from the Spark side."""

from __future__ import annotations

# Smallest id reachable over ``links(x, y)`` (both directions) from ``nodes(id)``.
_REACH = """reach AS (
  SELECT id, id AS r FROM nodes
  UNION
  SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.id)"""

MINHASH = rf"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'),
        lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

PIVOTS = f"""WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x IS NOT NULL AND x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACH},
c AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(max(c.n), 0) AS n_links, min(r) AS component_id, e.vec_id = min(r) AS kept
FROM embeddings e JOIN reach ON reach.id = e.vec_id LEFT JOIN c ON c.x = e.vec_id GROUP BY e.vec_id"""

_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     "list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 "
     "AND coalesce(try_cast(p AS HUGEINT), 256) <= 255))"),
    ("card", r"[0-9](?:[ -]?[0-9])+",
     "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: "
     "CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) "
     "ELSE CAST(d[i] AS INTEGER) * 2 - 9 * CAST(CAST(d[i] AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
)
_TERM = r"[\p{L}\p{N}](?:[^ \t\n\r\f]*[\p{L}\p{N}])?"


def _matches(pattern: str, source: str) -> str:
    """Every match with its place, from the lengths of the parts between matches."""
    return (f"(SELECT t, i, ms[i] AS value, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) "
            f"+ coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS s "
            f"FROM (SELECT t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT t, regexp_extract_all(t, '{pattern}') AS ms, "
            f"string_split_regex(t, '{pattern}') AS gs FROM {source})))")


def pii(radius: int, remove: float, generalise: float, support: int) -> str:
    base = "\nUNION ALL ".join(
        f"SELECT t, {k} AS o, '{kind}' AS kind, s, s + length(value) AS e, value FROM "
        f"(SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM {_matches(pattern, 'texts')}) WHERE {valid}"
        for k, (kind, pattern, valid) in enumerate(_PATTERNS))
    return rf"""WITH
texts AS MATERIALIZED (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({base}),
win AS (SELECT t, kind || ':' || lower(CASE WHEN kind = 'email' THEN value ELSE regexp_replace(value, '[ ()-]', '', 'g') END) AS entity,
    greatest(s - {radius} - 1, 0) AS low, substr(t, greatest(s - {radius} - 1, 0) + 1, s - greatest(s - {radius} - 1, 0)) AS l,
    substr(t, e + 1, {radius} + 1) AS r FROM base),
near AS (SELECT t, entity, (CASE WHEN low > 0 THEN regexp_replace(l, '^[^ \t\n\r\f]+', '') ELSE l END) || ' '
    || (CASE WHEN length(r) > {radius} THEN regexp_replace(r, '[^ \t\n\r\f]+$', '') ELSE r END) AS x FROM win),
ne AS (SELECT entity, count(DISTINCT t) AS n_e FROM near GROUP BY entity HAVING count(DISTINCT t) >= {support}),
pairs AS (SELECT near.entity, any_value(n_e) AS n_e, term, count(DISTINCT t) AS n_et
    FROM (SELECT t, entity, unnest(list_transform(regexp_extract_all(x, '{_TERM}'), lambda m: lower(m))) AS term FROM near) near
    JOIN ne ON ne.entity = near.entity
    WHERE regexp_matches(term, '\p{{L}}') AND NOT regexp_matches(term, '[0-9@]') AND length(term) >= 2
    GROUP BY near.entity, term HAVING count(DISTINCT t) >= {support}),
words AS (SELECT t, unnest(list_distinct(list_transform(regexp_extract_all(t, '{_TERM}'), lambda m: lower(m)))) AS term FROM texts),
nt AS (SELECT term, count(*) AS n_t FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM texts),
told AS (SELECT pairs.term, max(CASE WHEN log2(n / n_e) > 0 THEN log2(n_et * n / (n_e * n_t)) / log2(n / n_e) END) AS disclosure
    FROM pairs JOIN nt ON nt.term = pairs.term, n GROUP BY pairs.term),
flagged AS MATERIALIZED (SELECT term, CASE WHEN disclosure >= {remove} THEN 'term' ELSE 'hint' END AS action FROM told
    WHERE disclosure >= {generalise}),
with_terms AS (SELECT DISTINCT t FROM words WHERE term IN (SELECT term FROM flagged)),
added AS (SELECT f.t, CASE action WHEN 'hint' THEN 4 ELSE 5 END AS o, action AS kind, f.s, f.s + length(f.value) AS e
    FROM {_matches(_TERM, 'with_terms')} f JOIN flagged ON flagged.term = lower(f.value)
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.t = f.t AND b.s < f.s + length(f.value) AND f.s < b.e)),
spans AS (SELECT t, o, kind, s, e FROM base UNION ALL SELECT * FROM added),
per AS (SELECT t, {', '.join(f"count(*) FILTER (WHERE o = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(_PATTERNS))},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o < 4) AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS a FROM spans GROUP BY t)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in _PATTERNS)},
    sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents LEFT JOIN per ON per.t = coalesce(text, '')"""

NEGATIVES = """WITH
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
        CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER best <= 5"""

DIVERGENCE = r"""WITH
d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lg AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, source, w.term),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n.n + lg.v) AS p,
        1 + (1000000000::HUGEINT * (total + 1)) // (lg.n + lg.v) AS q
      FROM n JOIN lg ON lg.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200"""
