"""DuckDB SQL that gives the rows of a query."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), need AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS key
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM need)
), places AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, item_id, s, places.k FROM places JOIN windows USING (k, key)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Rounds of Lloyd's algorithm, a few tables each."""
    away = "list_sum(list_transform(list_zip(d.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v FROM kept, range({parts}) t(p)
), d AS MATERIALIZED (
  SELECT p, v, count(*) AS w FROM parts GROUP BY p, v
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {entries}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT d.p, d.v, w, b.e, {away} AS err FROM d JOIN b{r} b USING (p)
  QUALIFY row_number() OVER (PARTITION BY d.p, d.v ORDER BY err, b.e) = 1
)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(w * v[i]) / sum(w))::BIGINT AS m FROM a{r}, range(1, 4096) t(i) WHERE i <= len(v) GROUP BY p, e, i) GROUP BY p, e
), b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s USING (p, e)
)""")
    last = f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error
  FROM parts JOIN a{rounds} USING (p, v) GROUP BY vec_id, label
)"""
    return ", ".join(steps) + last


CODES = codes_sql()
