"""DuckDB counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import TEMPLATES

ORACLES: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op6_decontamination"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS a FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[a + 1:a + 13], ' ') AS s FROM cut),
lens AS (SELECT DISTINCT l FROM win),
places AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS a FROM d, lens WHERE len(w) >= l),
seen AS (SELECT doc_id, a, p.l, item_id FROM (SELECT doc_id, a, l, array_to_string(w[a + 1:a + l], ' ') AS s FROM places) p
         JOIN win USING (s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + l)) AS p FROM seen) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM seen) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({i}, '{label}', '{text}')" for i, (text, label) in enumerate(rows))


ORACLES["op8_licenses"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
p(i, label, s) AS (VALUES (0, 'mit', 'under the mit license'), (1, 'apache-2', 'apache license version 2'),
                          (2, 'cc-by-nc', 'cc by nc')),
pos AS (SELECT doc_id, w, unnest(range(0, len(w))) AS a FROM d),
exact AS (SELECT doc_id, a, label FROM pos, p WHERE array_to_string(w[a + 1:a + len(string_split(s, ' '))], ' ') = s),
base AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact GROUP BY doc_id),
t(i, label, s) AS (VALUES {_values([(t.replace("'", "''"), label) for label, t in TEMPLATES])}),
tw AS (SELECT i, label, {_WORDS.format('s')} AS w FROM t),
grams AS (SELECT i, label, len(w) - 2 AS n, unnest(range(0, len(w) - 2)) AS b, w FROM tw),
keyed AS (SELECT i, label, n, b, array_to_string(w[b + 1:b + 3], ' ') AS g FROM grams),
m AS (SELECT doc_id, i, label, n, a - b AS diagonal, a, b FROM
      (SELECT doc_id, a, array_to_string(w[a + 1:a + 3], ' ') AS g FROM pos WHERE a <= len(w) - 3) JOIN keyed USING (g)),
v AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, i ORDER BY diagonal, a), 0) > 3 AS gap FROM m),
s AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id, i ORDER BY diagonal, a) AS span FROM v),
spans AS (SELECT doc_id, label, count(DISTINCT b) / n AS share, max(a) + 3 - min(a) AS long, n FROM s
          GROUP BY doc_id, i, label, n, span),
score AS (SELECT doc_id, max(share) AS share FROM spans GROUP BY doc_id),
every AS (SELECT doc_id, label FROM exact UNION
          SELECT doc_id, label FROM spans WHERE share >= 0.8 AND long <= (n + 2) * 1.25 + 3),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN score USING (doc_id)"""

ORACLES["op4_maxscore"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM g"""


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# The checksum's steps as a list: a byte to be mixed in, then eight shifts (-1).
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def _sides(level: str, at: str, step: str) -> str:
    """What stands left, and right, of the node on the path in its run of three."""
    run, place = f"({at} // ({step} * 3)) * 3", f"{at} // {step}"
    return (f"array_to_string({level}[{run} + 1:{place}], '') AS l, "
            f"array_to_string({level}[{place} + 2:{run} + 3], '') AS r")


_ABOVE = "list_transform(range(0, (len(d) + 2) // 3), lambda i: sha256(array_to_string(d[3 * i + 1:3 * i + 3], '')))"

ORACLES["op11_merkle"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
                    CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claimed
             FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
                               row_number() OVER () AS rid FROM doc),
up AS (SELECT source, CAST(0 AS BIGINT) AS h, CAST(1 AS BIGINT) AS step, list(leaf ORDER BY p) AS d FROM placed GROUP BY source
       UNION ALL SELECT source, h + 1, step * 3, {_ABOVE} FROM up WHERE len(d) > 1),
subroots AS MATERIALIZED (SELECT source, h, d[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q
                          FROM up WHERE len(d) = 1),
high AS (SELECT CAST(0 AS BIGINT) AS h, CAST(1 AS BIGINT) AS step, list(subroot ORDER BY q) AS d FROM subroots
         UNION ALL SELECT h + 1, step * 3, {_ABOVE} FROM high WHERE len(d) > 1),
path AS (SELECT rid, up.h, {_sides('d', 'p', 'step')} FROM placed JOIN up ON up.source IS NOT DISTINCT FROM placed.source WHERE len(d) > 1
         UNION ALL SELECT rid, 1000 + high.h, {_sides('d', 'q', 'step')} FROM placed
         JOIN subroots ON subroots.source IS NOT DISTINCT FROM placed.source, high WHERE len(d) > 1),
steps AS (SELECT rid, string_agg(l || r, '' ORDER BY h) AS proof, list(l || '|' || r ORDER BY h) AS sides FROM path GROUP BY rid),
whole AS (SELECT d[1] AS root FROM high WHERE len(d) = 1),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
                  list_reduce(list_concat([claimed], coalesce(sides, [])),
                      lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
           FROM placed JOIN subroots ON subroots.source IS NOT DISTINCT FROM placed.source LEFT JOIN steps USING (rid), whole)
SELECT *, folded_root = root AS verified FROM folded"""


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(x) >= 131072)) = 0)""",
             f"""m0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v
    FROM v) WHERE c < {k})"""]
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - m.v[i]) * (v.v[i] - m.v[i])))"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d FROM
    (SELECT rid, c, CAST({gap} AS BIGINT) AS d FROM v, m{r} AS m) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""m{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, m.v) AS v FROM m{r} AS m LEFT JOIN
    (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM
     (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
      (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{r} USING (rid)) GROUP BY c, i) GROUP BY c) AS n USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN m{rounds} AS m USING (c)"""


ORACLES["op13_centroids"] = _cluster_sql()
