"""DuckDB SQL for the corpus operators that SQL can state."""

SQL: dict[str, str] = {}

SQL["op1_mix"] = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), named AS (
  SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS room FROM per
), run AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(room) OVER (ORDER BY room / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS room_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_from
  FROM named
), marked AS (
  SELECT *, room * weight_from <= weight * (total - room_before) AS is_full FROM run
), shared AS (
  SELECT *, total - coalesce(sum(CASE WHEN is_full THEN room END) OVER (), 0.0) AS left_all, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_weight FROM marked
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN room ELSE least(room, left_all / open_weight * weight) END AS target FROM shared
), expected AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM targets
), odds AS (
  SELECT *, CAST(floor(e) AS INTEGER) AS sure, e - CAST(floor(e) AS INTEGER) AS p FROM expected
), ranked AS (
  SELECT s.doc_id, s.size, s.source, o.source_size, o.target, o.sure, o.p, o.target - o.sure * o.source_size AS left_words,
         CASE WHEN p > 0 THEN 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + (u / (1 - u)) / (p / (1 - p))) END AS rank
  FROM sizes s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source
), line AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM ranked
), chosen AS (
  SELECT *, sure + CASE WHEN p > 0 AND before + size - left_words <= left_words - before THEN 1 ELSE 0 END AS copies FROM line
)
SELECT doc_id, size, source, source_size, target, CAST(copies AS INTEGER) AS copies, CAST(size * copies AS BIGINT) AS taken FROM chosen
"""

SQL["op5_topk"] = r"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op6_repeats"] = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, s, md5(substring(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 99, 0))) AS s FROM d)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w) WHERE k > 1
), edges AS (
  SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS island FROM later
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM edges GROUP BY doc_id, island
), marked AS (
  SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM runs
), spans AS (
  SELECT doc_id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM marked) GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(spans.z), 0), any_value(d.n) FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT cuts.doc_id, string_agg(substring(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS y FROM cuts JOIN d ON d.doc_id = cuts.doc_id GROUP BY cuts.doc_id
), totals AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM d LEFT JOIN totals t ON t.doc_id = d.doc_id JOIN kept k ON k.doc_id = d.doc_id
"""
