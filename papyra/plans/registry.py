"""Named queries over the driver's tables, with the DuckDB SQL that states the same result.

The tables are carriers: paragraphs are the lines of ``documents``; a synthetic page sets paragraph i
as line ``12 * (i mod 40)`` of page ``i div 40``, 72 from the left, six wide a character up to 80.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions import text as X
from papyra.operators import cache, content, detect, jobs, pricing, regions, segment, terms, typeset
from papyra.operators import paragraphs as P
from papyra.plans import chunked
from papyra.sources.files import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(dealt(table(spark, sf_dir, "documents", "doc_id", "text")))


# ---- SQL that several queries share ----------------------------------------------------------

PARAS = r"""lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
split AS (SELECT doc_id, list_filter(l, lambda p: p <> '') AS paras FROM lines),
p AS (SELECT doc_id, CAST(generate_subscripts(paras, 1) - 1 AS INTEGER) AS i, unnest(paras) AS text FROM split)"""
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BARE = rf"regexp_replace(regexp_replace(text, '\{{v\p{{Nd}}+\}}|</?b\p{{Nd}}+>', '', 'g'), '^{WS}+|{WS}+$', '', 'g')"
TRIVIAL = rf"(length({BARE}) < 3 OR NOT regexp_matches({BARE}, '\p{{L}}'))"
PAGES = rf"""{PARAS},
page AS (SELECT doc_id AS doc, CAST(i // 40 AS INTEGER) AS page, i AS line, text, 72.0::DOUBLE AS x0, CAST(12 * (i % 40) AS DOUBLE) AS y0,
  CAST(72 + 6 * least(length(text), 80) AS DOUBLE) AS x1, CAST(12 * (i % 40) + 10 AS DOUBLE) AS y1 FROM p)"""


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the synthetic pages: doc, page, line, text, x0, y0, x1, y1."""
    r = P.rows(_paras(spark, sf_dir))
    y = (F.col("i") % 40 * 12).cast("double")
    return r.select(F.col("doc_id").alias("doc"), F.floor(F.col("i") / 40).cast("int").alias("page"), F.col("i").alias("line"), "text", F.lit(72.0).alias("x0"), y.alias("y0"), (72 + 6 * F.least(F.length("text"), F.lit(80))).cast("double").alias("x1"), (y + 10).alias("y1"))


# ---- paragraphs --------------------------------------------------------------------------------


@query(rf"""WITH RECURSIVE {PARAS},
kept AS (SELECT doc_id, text, min(i) AS i FROM p WHERE NOT {TRIVIAL} GROUP BY doc_id, text),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, CAST(length(text) AS BIGINT) AS len FROM kept),
f AS (SELECT doc_id, k, len AS used, 1 AS chunks, len AS chars, len AS largest FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, CASE WHEN f.used + n.len > 1000 THEN n.len ELSE f.used + n.len END, CASE WHEN f.used + n.len > 1000 THEN f.chunks + 1 ELSE f.chunks END, f.chars + n.len,
  greatest(f.largest, CASE WHEN f.used + n.len > 1000 THEN n.len ELSE f.used + n.len END) FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
SELECT d.doc_id, CAST(coalesce(max(f.k), 0) AS INTEGER) AS units, CAST(coalesce(max(f.chunks), 0) AS INTEGER) AS chunks, CAST(coalesce(max(f.chars), 0) AS BIGINT) AS chars, CAST(coalesce(max(f.largest), 0) AS BIGINT) AS largest
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that translating each document would take: distinct, non-trivial paragraphs in greedy chunks. No shuffle."""
    units = _paras(spark, sf_dir).select("doc_id", F.array_distinct(F.filter("paras", lambda p: ~X.is_trivial(p))).alias("units"))
    t = units.select("doc_id", F.size("units").alias("units"), P.chunk_totals(F.col("units")).alias("t"))
    return t.select("doc_id", "units", "t.chunks", "t.chars", "t.largest")


@query(rf"WITH {PARAS} SELECT doc_id, i, {TRIVIAL} AS trivial, {BARE} = '' OR regexp_matches(text, '^\{{v\p{{Nd}}+\}}$') AS skipped FROM p")
def paragraphs_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.rows(_paras(spark, sf_dir))
    return r.select("doc_id", "i", X.is_trivial(F.col("text")).alias("trivial"), X.skips_translation(F.col("text")).alias("skipped"))


@query(rf"""WITH {PARAS},
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
f AS (SELECT doc_id, text, min(i) AS i FROM p GROUP BY doc_id, text),
s AS (SELECT f.doc_id, f.i, f.text, c.upto - length(f.text) AS before FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i),
k AS (SELECT s.doc_id, s.i, string_agg(c.text, chr(10) ORDER BY c.i) AS cache_key FROM s JOIN c ON c.doc_id = s.doc_id AND c.i >= s.i AND (c.i = s.i OR c.upto - length(c.text) - s.before < 200) GROUP BY s.doc_id, s.i)
SELECT doc_id, i, md5(cache_key) AS key_md5, CAST(length(cache_key) AS INTEGER) AS key_chars FROM k""")
def paragraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = P.keys(_paras(spark, sf_dir))
    return k.select("doc_id", "i", F.md5("cache_key").alias("key_md5"), F.length("cache_key").alias("key_chars"))


@query(rf"WITH {PARAS} SELECT doc_id, min(i) AS i, md5(text) AS text_md5, count(*) AS uses FROM p WHERE NOT {TRIVIAL} GROUP BY doc_id, text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.rows(_paras(spark, sf_dir)).where(~X.is_trivial(F.col("text")))
    return r.groupBy("doc_id", "text").agg(F.min("i").alias("i"), F.count("*").alias("uses")).select("doc_id", "i", F.md5("text").alias("text_md5"), "uses")


@query(rf"""WITH RECURSIVE {PARAS},
f AS (SELECT doc_id, i, CAST(length(text) AS BIGINT) AS used, 0 AS chunk FROM p WHERE i = 0
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN f.used + length(p.text) > 1000 THEN length(p.text) ELSE f.used + length(p.text) END, CASE WHEN f.used + length(p.text) > 1000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
SELECT f.doc_id, f.chunk, CAST(min(f.i) AS INTEGER) AS first, count(*) AS items, CAST(max(f.used) AS BIGINT) AS chars FROM f GROUP BY f.doc_id, f.chunk""")
def chunks_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _paras(spark, sf_dir).select("doc_id", "paras", P.greedy_chunks(F.col("paras")).alias("chunk"))
    each = c.select("doc_id", F.explode(F.arrays_zip(F.col("chunk"), F.transform("paras", lambda p, i: F.struct(i.alias("i"), F.length(p).cast("long").alias("n"))).alias("p"))).alias("z"))
    return each.groupBy("doc_id", F.col("z.chunk").alias("chunk")).agg(F.min("z.p.i").alias("first"), F.count("*").alias("items"), F.sum("z.p.n").alias("chars"))


@query(rf"""WITH {PARAS},
u AS (SELECT doc_id, i, text, length(text) AS len, least(length(text), 600) AS part FROM p WHERE NOT {TRIVIAL}),
b AS (SELECT doc_id, least(6000, sum(len), greatest(150, sum(len) // 5)) AS budget FROM u GROUP BY doc_id),
r AS (SELECT u.*, b.budget, coalesce(sum(part) OVER (PARTITION BY u.doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u JOIN b ON b.doc_id = u.doc_id)
SELECT doc_id, CAST(max(budget) AS BIGINT) AS budget, CAST(count(*) AS INTEGER) AS parts, md5(string_agg(substr(text, 1, 600), chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM r WHERE before = 0 OR before < budget GROUP BY doc_id""")
def opening_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _paras(spark, sf_dir).select("doc_id", P.opening(F.col("paras")).alias("o")).where(F.size("o.parts") > 0)
    return o.select("doc_id", "o.budget", F.size("o.parts").alias("parts"), F.md5(F.array_join("o.parts", "\n\n")).alias("text_md5"))


@query(rf"WITH {PARAS} SELECT d.doc_id, CAST(least(greatest(coalesce(sum(length(p.text)), 0) // 20, 3000), 20000) AS BIGINT) AS excerpt, CAST(least(greatest(coalesce(sum(length(p.text)), 0) // 4000, 25), 80) AS BIGINT) AS terms FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id")
def excerpt_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir).select("doc_id", P.sizing(F.col("paras")).alias("s")).select("doc_id", "s.excerpt", "s.terms")


@query(rf"""WITH RECURSIVE {PARAS},
u AS (SELECT doc_id, i, least(length(text), 600) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM p WHERE NOT {TRIVIAL}),
t AS (SELECT doc_id, sum(n) AS total, greatest(2, CAST(round_even(sum(n) / 1000.0::DOUBLE, 0) AS BIGINT)) AS stride FROM u GROUP BY doc_id),
o AS (SELECT u.doc_id, j, n, j % stride AS turn, row_number() OVER (PARTITION BY u.doc_id ORDER BY j % stride, j) AS k, total FROM u JOIN t ON t.doc_id = u.doc_id),
w AS (SELECT doc_id, k, turn, CAST(CASE WHEN n <= 1000 THEN n ELSE 0 END AS BIGINT) AS used, n <= 1000 AS taken, false AS done, j FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.turn, CASE WHEN (w.done OR (o.turn <> w.turn AND w.used >= 980)) OR w.used + o.n > 1000 THEN w.used ELSE w.used + o.n END,
  NOT (w.done OR (o.turn <> w.turn AND w.used >= 980)) AND w.used + o.n <= 1000, w.done OR (o.turn <> w.turn AND w.used >= 980), o.j FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
r AS (SELECT w.doc_id, w.j FROM w JOIN t ON t.doc_id = w.doc_id WHERE taken OR total <= 1000)
SELECT d.doc_id, CAST(count(r.j) AS INTEGER) AS parts, coalesce(string_agg(CAST(r.j AS VARCHAR), ',' ORDER BY r.j), '') AS places FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _paras(spark, sf_dir).select("doc_id", P.stride_sample(F.col("paras"), 1000).alias("taken"))
    return s.select("doc_id", F.size("taken").alias("parts"), F.array_join(F.transform("taken", lambda i: i.cast("string")), ",").alias("places"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) AS k0, unnest(ls) AS l, len(ls) AS m FROM t),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k0) AS k, CASE WHEN k0 < m THEN l || chr(10) ELSE l END AS l FROM e WHERE k0 < m OR l <> ''),
f AS (SELECT doc_id, k, l, length(l) AS used, 0 AS part FROM l WHERE k = 1
  UNION ALL SELECT l.doc_id, l.k, l.l, CASE WHEN f.used + length(l.l) > 5000 THEN length(l.l) ELSE f.used + length(l.l) END, CASE WHEN f.used + length(l.l) > 5000 THEN f.part + 1 ELSE f.part END FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
SELECT doc_id, part, md5(string_agg(l, '' ORDER BY k)) AS part_md5, CAST(max(used) AS INTEGER) AS chars FROM f GROUP BY doc_id, part""")
def request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a text cut at line ends for a service that takes 5,000 characters."""
    parts = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(P.split_lines(F.col("text"))).alias("part", "t"))
    return parts.select("doc_id", "part", F.md5("t").alias("part_md5"), F.length("t").alias("chars"))


# ---- terms ------------------------------------------------------------------------------------

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in terms.STOP)
WORDS = rf"""{PARAS},
w AS (SELECT doc_id, i AS para, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]+'), lambda x: lower(x)) AS ws FROM p)"""


@query(rf"""WITH {WORDS},
e AS (SELECT doc_id, para, generate_subscripts(ws, 1) AS pos, unnest(ws) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS n, min(para * 1000000 + pos) AS first FROM e WHERE length(term) > 2 AND term NOT IN ({STOPS}) GROUP BY doc_id, term),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM c)
SELECT doc_id, term, n, rank FROM r WHERE rank <= 120 AND n > 2""")
def vocab_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.vocabulary(_paras(spark, sf_dir))


@query(rf"""WITH {WORDS},
e AS (SELECT doc_id, para, generate_subscripts(ws, 1) AS pos, unnest(ws) AS a, unnest(list_append(ws[2:], NULL)) AS b FROM w),
c AS (SELECT doc_id, a || ' ' || b AS term, count(*) AS n, min(para * 1000000 + pos) AS first FROM e
  WHERE b IS NOT NULL AND length(a) > 2 AND length(b) > 2 AND a NOT IN ({STOPS}) AND b NOT IN ({STOPS}) GROUP BY doc_id, a || ' ' || b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM c)
SELECT doc_id, term, n, rank FROM r WHERE rank <= 60 AND n > 2""")
def vocab_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.vocabulary(_paras(spark, sf_dir), pairs=True)


FORMS = r"forms AS (SELECT DISTINCT list_extract(string_split(text, ' '), 2) AS form, list_extract(string_split(text, ' '), 2) || ' ' || list_extract(string_split(text, ' '), 3) AS term FROM benchmark WHERE len(string_split(text, ' ')) > 3)"
FLAT = lambda c: rf"regexp_replace(regexp_replace(replace({c}, '-', ' '), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", " ")
    return table(spark, sf_dir, "benchmark", "text").where(F.size(parts) > 3).select(parts[1].alias("form"), F.concat_ws(" ", parts[1], parts[2]).alias("term")).distinct()


@query(rf"""WITH {FORMS}, g AS (SELECT DISTINCT {FLAT("form")} AS form, term FROM forms),
d AS (SELECT doc_id, {FLAT("text")} AS flat FROM documents),
h AS (SELECT DISTINCT doc_id, term FROM d JOIN g ON form <> '' AND CASE WHEN length(form) >= 4 THEN contains(lower(flat), lower(form)) ELSE contains(flat, form) END),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) AS INTEGER) AS rank FROM h)
SELECT doc_id, term, rank FROM r WHERE rank <= 40""")
def term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.match_terms(dealt(table(spark, sf_dir, "documents", "doc_id", "text")), _forms(spark, sf_dir))


@query(rf"""WITH {PARAS}, o AS (SELECT DISTINCT doc_id + 1 AS doc_id, list_extract(string_split(text, ' '), 1) AS term, list_extract(string_split(text, ' '), 2) AS form FROM p),
d AS (SELECT doc_id, lower({FLAT("text")}) AS shown FROM documents)
SELECT o.doc_id, term, form FROM o JOIN d ON d.doc_id = o.doc_id WHERE (term <> '' AND contains(shown, lower({FLAT("term")}))) OR (coalesce(form, '') <> '' AND contains(shown, lower({FLAT("form")})))""")
def term_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the terms proposed for a document its text shows: the first words of the paragraphs of the document before it, with their second words as forms."""
    w = F.split("p", " ")
    proposed = _paras(spark, sf_dir).select((F.col("doc_id") + 1).alias("doc_id"), F.explode("paras").alias("p")).select("doc_id", w[0].alias("term"), F.get(w, 1).alias("form")).distinct()
    docs = table(spark, sf_dir, "documents", "doc_id", F.col("text").alias("excerpt"))
    return terms.grounded(proposed.withColumn("forms", F.array("form")), docs).select("doc_id", "term", "form")


_KEY = lambda c: f"CASE WHEN length({FLAT(c)}) >= 4 THEN lower({FLAT(c)}) ELSE {FLAT(c)} END"


@query(rf"""WITH RECURSIVE l AS (SELECT conv_id, turn, generate_subscripts(string_split_regex(text, '[.\n]'), 1) AS pos, unnest(string_split_regex(text, '[.\n]')) AS x FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, pos, string_split_regex(regexp_replace(x, '^ +| +$', '', 'g'), ' +') AS w FROM l),
e AS (SELECT conv_id, w[1] AS source, w[-1] AS target, {_KEY("w[1]")} AS key, {_KEY("lower(w[1])")} AS form, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(w[1]), pos) AS k
  FROM w WHERE len(w) > 2 AND length(w[1]) BETWEEN 1 AND 80 AND w[-1] <> ''),
f AS (SELECT conv_id, 0::BIGINT AS k, MAP([]::VARCHAR[], []::VARCHAR[]) AS terms, MAP([]::VARCHAR[], []::VARCHAR[]) AS forms, MAP([]::VARCHAR[], []::VARCHAR[]) AS lost FROM e GROUP BY conv_id
  UNION ALL SELECT s.conv_id, s.k, s.terms2, map_concat(MAP([s.form], [s.term]), MAP([s.key], [s.term]), s.forms), CASE WHEN s.kept <> s.target THEN map_concat(s.lost, MAP([s.target], [s.kept])) ELSE s.lost END
  FROM (SELECT *, map_concat(MAP([term], [target]), terms) AS terms2, coalesce(terms[term], target) AS kept FROM (SELECT f.conv_id, e.k, f.terms, f.forms, f.lost, e.target, e.key, e.form, coalesce(f.forms[e.key], e.source) AS term FROM f JOIN e ON e.conv_id = f.conv_id AND e.k = f.k + 1)) s),
z AS (SELECT DISTINCT ON (conv_id) * FROM f ORDER BY conv_id, k DESC),
u AS (SELECT conv_id, 'term' AS kind, unnest(map_entries(terms)) AS m FROM z UNION ALL SELECT conv_id, 'form', unnest(map_entries(forms)) FROM z UNION ALL SELECT conv_id, 'fixup', unnest(map_entries(lost)) FROM z)
SELECT conv_id, kind, m.key AS "left", m.value AS "right" FROM u WHERE (kind <> 'form' OR length(m.key) BETWEEN 1 AND 80) AND (kind <> 'fixup' OR NOT (contains(m.key, m.value) OR contains(m.value, m.key)))""")
def glossary_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossaries of conversations: the first word of each line is a term, the last its rendering."""
    lines = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", F.col("turn").cast("int").alias("chunk"), F.posexplode(F.split("text", "[.\n]")).alias("pos", "l"))
    w = F.split(F.trim("l"), " +")
    entries = lines.where(F.size(w) > 2).select("conv_id", "chunk", "pos", w[0].alias("source"), F.element_at(w, -1).alias("target"), F.array(F.lower(w[0])).alias("forms"))
    return terms.fold_glossary(entries, "conv_id")


@query(rf"""WITH RECURSIVE {PARAS},
m AS (SELECT DISTINCT text FROM p WHERE doc_id % 4 = 0 AND length(text) >= 200),
kept AS (SELECT doc_id, text, min(i) AS i FROM p WHERE NOT {TRIVIAL} GROUP BY doc_id, text),
k AS (SELECT kept.*, m.text IS NOT NULL AS known FROM kept LEFT JOIN m ON m.text = kept.text),
n AS (SELECT doc_id, i, text, CAST(length(text) AS BIGINT) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM k WHERE NOT known),
f AS (SELECT doc_id, r, i, text, len AS used, 0 AS chunk FROM n WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, n.i, n.text, CASE WHEN f.used + n.len > 1000 THEN n.len ELSE f.used + n.len END, CASE WHEN f.used + n.len > 1000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN n ON n.doc_id = f.doc_id AND n.r = f.r + 1),
c AS (SELECT doc_id, chunk, min(i) AS first, arg_min(string_split(text, ' ')[1], i) AS word FROM f GROUP BY doc_id, chunk),
o AS (SELECT *, first % 7 = 2 AS lost, '<' || word || first % 2 || '>' AS target, {_KEY("trim(word)")} AS key FROM c),
t AS (SELECT *, NOT lost AND trim(word) <> '' AND length(trim(word)) <= 80 AND key <> '' AS learned FROM o),
a AS (SELECT doc_id, chunk, lost, CASE WHEN learned THEN first_value(target) OVER (PARTITION BY doc_id, key, learned ORDER BY chunk) ELSE target END AS target FROM t)
SELECT f.doc_id, f.i, f.chunk, CASE WHEN lost THEN 'left' ELSE 'service' END AS source, CASE WHEN lost THEN '' ELSE md5(target || ' ' || f.text) END AS translation_md5 FROM f JOIN a ON a.doc_id = f.doc_id AND a.chunk = f.chunk
UNION ALL SELECT doc_id, i, -1, 'memory', md5(lower(text)) FROM k WHERE known""")
def chunk_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents translated chunk by chunk by a stand-in that answers wrongly at times and renders terms in two ways; the memory is a quarter of the carrier."""
    docs = _paras(spark, sf_dir)
    old = P.rows(docs).where((F.col("doc_id") % 4 == 0) & (F.length("text") >= P.MIN_KEY_CHARS)).select(F.col("text").alias("cache_key")).distinct()
    run = chunked.translate_documents(docs, old.withColumn("translation", F.lower("cache_key")), chunked.ScriptedService)
    return chunked.units(run).select("doc_id", "i", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "source", F.coalesce(F.md5("translation"), F.lit("")).alias("translation_md5"))


# ---- identity, memory, replies -----------------------------------------------------------------


@query(rf"WITH {PAGES}, t AS (SELECT doc, page, string_agg(text, '' ORDER BY line) AS text FROM page GROUP BY doc, page) SELECT doc, substr(sha256(string_agg(text, '' ORDER BY page)), 1, 16) AS doc_key FROM t GROUP BY doc")
def doc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate: lines in the order of their pages are the pages' texts in order."""
    lines = _page(spark, sf_dir)
    return P.document_key(lines, "doc", "line", "text")


MEMORY = r"memory AS (SELECT arg_max(role, conv_id * 1000 + turn) AS engine, text, max(conv_id * 1000 + turn) AS write_seq FROM conversations WHERE text IS NOT NULL GROUP BY text)"


@query(rf"WITH {MEMORY} SELECT md5(text) AS text_md5, engine, write_seq FROM memory")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("text IS NOT NULL").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("write_seq"), F.col("role").alias("engine"))
    return cache.upsert(log, ["text"], "write_seq").select(F.md5("text").alias("text_md5"), "engine", "write_seq")


@query(rf"WITH {PARAS}, m AS (SELECT text, min(doc_id) AS translation FROM p WHERE doc_id % 2 = 0 GROUP BY text) SELECT p.doc_id, p.i, m.translation FROM p LEFT JOIN m ON m.text = p.text WHERE p.doc_id % 2 = 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of odd documents looked up among those of even ones (two halves of the carrier: job and memory)."""
    r = P.rows(_paras(spark, sf_dir))
    memory = r.where("doc_id % 2 = 0").groupBy("text").agg(F.min("doc_id").alias("translation"))
    return cache.lookup(r.where("doc_id % 2 = 1"), memory, ["text"]).select("doc_id", "i", "translation")


@query(rf"""WITH asked AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS a FROM conversations WHERE role = 'user' GROUP BY conv_id),
got AS (SELECT conv_id, list_sort(list(DISTINCT turn - 1)) AS g, bool_or(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g') = '') AS blank FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT asked.conv_id, a, coalesce(g, []) AS g, coalesce(blank, false) AS blank FROM asked LEFT JOIN got ON got.conv_id = asked.conv_id)
SELECT conv_id, len(list_filter(a, lambda x: NOT list_contains(g, x))) = 0 AND len(list_filter(g, lambda x: NOT list_contains(a, x))) = 0 AND NOT blank AS accepted,
CAST(len(list_filter(a, lambda x: NOT list_contains(g, x))) AS INTEGER) AS missing, CAST(len(list_filter(g, lambda x: NOT list_contains(a, x))) AS INTEGER) AS extra FROM j""")
def chunk_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a chunk: each user turn asks, the assistant's next turn answers it."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return cache.aligned(c.where("role = 'user'"), c.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1), "conv_id", "turn")


# ---- prices and jobs ---------------------------------------------------------------------------

#: Price regimes of the carrier: start, peak hours (UTC), and rates a million tokens for each kind of event.
REGIMES = [("2024-01-05 12:00:00", [], 1.0), ("2024-01-12 00:00:00", [(1, 4), (6, 10)], 1.5), ("2024-01-20 16:00:00", [(9, 12)], 3.0)]
MODELS = {"click": 1.0, "view": 2.0, "purchase": 4.0, "signup": 0.5}
_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MODELS.items())
REGIME_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, TIMESTAMP '{t}', CAST([{', '.join(f'[{a}, {b}]' for a, b in h)}] AS INTEGER[][]), {s}::DOUBLE)" for i, (t, h, s) in enumerate(REGIMES)) + ") v(regime, effective_from, peak, scale))"
PRICED = rf"""{REGIME_SQL}, e AS (SELECT event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts FROM events),
j AS (SELECT e.*, coalesce(a.regime, 0) AS regime FROM e ASOF LEFT JOIN r a ON e.ts >= a.effective_from),
k AS (SELECT j.*, r.scale, len(list_filter(r.peak, lambda h: h[1] <= hour(j.ts) AND hour(j.ts) < h[2])) > 0 AS peak FROM j JOIN r ON r.regime = j.regime),
c AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS tokens, CASE event_type {_CASE} END * scale * CASE WHEN peak THEN 2.0 ELSE 1.0 END AS rate FROM k)"""


def _regimes(spark: SparkSession) -> DataFrame:
    rows = [(i, t, [{"start": a, "end": b} for a, b in h], {m: {p: {"cache_hit": v * s * f / 10, "cache_miss": v * s * f / 2, "output": v * s * f} for p, f in (("off_peak", 1.0), ("peak", 2.0))} for m, v in MODELS.items()}) for i, (t, h, s) in enumerate(REGIMES)]
    kind = "regime int, start string, peak_hours array<struct<start:int,end:int>>, rates map<string,map<string,struct<cache_hit:double,cache_miss:double,output:double>>>"
    return spark.createDataFrame(rows, kind).withColumn("effective_from", F.to_timestamp("start")).drop("start")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    held = pricing.in_force(e, _regimes(spark))
    peak = pricing.is_peak(F.col("ts"), F.col("peak_hours"))
    return held.withColumns({"peak": peak, "tokens": F.floor(F.col("value") * 100)}).withColumn("rate", pricing.rate(F.col("rates"), F.col("event_type"), F.col("peak")))


@query(rf"WITH {PRICED} SELECT event_id, CAST(regime AS INTEGER) AS regime FROM c")
def price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("event_id", "regime")


@query(rf"WITH {PRICED} SELECT event_id, peak, round(rate, 6) AS output_rate FROM c")
def peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("event_id", "peak", F.round("rate.output", 6).alias("output_rate"))


@query(rf"""WITH {PRICED}, t AS (SELECT *, tokens // 3 AS hit, tokens // 5 AS miss FROM c)
SELECT user_id AS job, CAST(sum(hit) AS BIGINT) AS tokens_hit, CAST(sum(miss) AS BIGINT) AS tokens_miss, CAST(sum(tokens) AS BIGINT) AS tokens_out, count(*) AS calls, bool_and(rate IS NOT NULL) AS priced,
round(coalesce(sum((hit * rate / 10 + miss * rate / 2 + tokens * rate) / 1000000), 0.0), 9) AS cost FROM t GROUP BY user_id""")
def job_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, miss = F.floor(F.col("tokens") / 3), F.floor(F.col("tokens") / 5)
    c = _priced(spark, sf_dir).select(F.col("user_id").alias("job"), hit.alias("tokens_hit"), miss.alias("tokens_miss"), F.col("tokens").alias("tokens_out"), pricing.cost(F.col("rate"), hit, miss, F.col("tokens")).alias("cost"))
    return pricing.usage(c).select("job", "tokens_hit", "tokens_miss", "tokens_out", "calls", "priced", F.round("cost", 9).alias("cost"))


@query("SELECT o_orderkey AS job, CAST(o_orderdate AS TIMESTAMP) AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").cast("timestamp").alias("created"))
    return jobs.recent(o)


@query("SELECT user_id AS job, last_event, CASE WHEN last_event IN ('queued', 'running') THEN 'interrupted' ELSE last_event END AS status FROM (SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'done' END AS last_event FROM events GROUP BY user_id)")
def jobs_reaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log folded to its last state, then what a restart makes of it."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    state = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "error", "failed").otherwise("done")
    last = jobs.fold_log(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), state.alias("last_event")))
    return last.select("job", "last_event", jobs.reap(F.col("last_event")).alias("status"))


@query("SELECT o_custkey AS job, CAST(sum(o_orderkey % 100) AS BIGINT) AS tokens_hit, CAST(sum(o_orderkey % 1000) AS BIGINT) AS tokens_out, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY o_custkey")
def usage_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    runs = o.select(F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 100).alias("tokens_hit"), (F.col("o_orderkey") % 1000).alias("tokens_out"), F.col("o_totalprice").alias("cost"))
    return jobs.add_usage(runs).withColumn("cost", F.round("cost", 2))


@query(r"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, CAST(user_id % 3 AS VARCHAR) AS stage, value / 500 AS progress, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT job, k, seq, stage, progress, true AS tell, progress AS at FROM e WHERE k = 1
 UNION ALL SELECT e.job, e.k, e.seq, e.stage, e.progress, e.stage <> f.stage OR abs(e.progress - f.at) >= 0.01, CASE WHEN e.stage <> f.stage OR abs(e.progress - f.at) >= 0.01 THEN e.progress ELSE f.at END FROM f JOIN e ON e.job = f.job AND e.k = f.k + 1)
SELECT job, seq, stage, progress FROM f WHERE tell""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return jobs.throttled(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("string").alias("stage"), (F.col("value") / 500).alias("progress")))


# ---- layout -------------------------------------------------------------------------------------


def _mono(lines: DataFrame) -> Column:
    """Carrier for typewriter lines: those whose text has a length of 0 or 1 modulo 3."""
    return F.length("text") % 3 < 2


@query(rf"""WITH {PAGES}, m AS (SELECT * FROM page WHERE length(text) % 3 < 2),
g AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY doc, page ORDER BY y0, line) >= 8 THEN 1 ELSE 0 END AS new FROM m),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY y0, line) AS cluster FROM g)
SELECT doc, page, CAST(cluster AS BIGINT) AS cluster, count(*) AS lines, min(y0) AS y0, max(y1) AS y1, max(x1) AS x1 FROM c GROUP BY doc, page, cluster HAVING count(*) >= 2""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    return regions.cluster_boxes(regions.clusters(lines.where(_mono(lines)))).select("doc", "page", "cluster", "lines", "y0", "y1", "x1")


@query(rf"""WITH {PAGES}, b AS (SELECT * FROM page WHERE line % 5 = 0), q AS (SELECT * FROM page WHERE length(text) % 3 = 2)
SELECT doc, page, line FROM b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = b.doc AND q.page = b.page AND b.y0 - 6 < q.y1 AND q.y0 < b.y1 + 6)""")
def prose_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    boxes = lines.where("line % 5 = 0").withColumns({"y0": F.col("y0") - 6, "y1": F.col("y1") + 6})
    return regions.without_prose(boxes, lines.where(~_mono(lines))).select("doc", "page", "line")


REGION = "SELECT doc, page, line AS region, CASE WHEN line % 4 = 3 THEN 'figure' ELSE 'plain text' END AS cls, x0 + 30 AS x0, y0 - 3 AS y0, least(x0 + 30 + 10 * (line % 30) + 40, 560) AS x1, y1 + 14 AS y1, (line * 37 % 101) / 100.0::DOUBLE AS conf FROM page WHERE line % 3 = 0"


def _region(lines: DataFrame) -> DataFrame:
    """Carrier for detections: over every third line and the one after it, cut at both ends."""
    cls = F.when(F.col("line") % 4 == 3, "figure").otherwise("plain text")
    return lines.where("line % 3 = 0").select("doc", "page", F.col("line").alias("region"), cls.alias("cls"), (F.col("x0") + 30).alias("x0"), (F.col("y0") - 3).alias("y0"), F.least(F.col("x0") + 30 + 10 * (F.col("line") % 30) + 40, F.lit(560.0)).alias("x1"), (F.col("y1") + 14).alias("y1"), (F.col("line") * 37 % 101 / 100).alias("conf"))


@query(rf"""WITH {PAGES}, r AS ({REGION}), l AS (SELECT doc, page, x0 AS l0, y0 AS t0, x1 AS l1, y1 AS t1 FROM page WHERE x1 - x0 > 20),
c AS (SELECT r.doc, r.page, r.region, min(l0) AS w0, max(l1) AS w1 FROM r JOIN l ON l.doc = r.doc AND l.page = r.page
 WHERE cls <> 'figure' AND least(y1, t1) - greatest(y0, t0) > 0.5 * (t1 - t0) AND x1 > l0 AND x0 < l1 AND NOT (x0 <= l0 + 2 AND x1 >= l1 - 2) GROUP BY r.doc, r.page, r.region)
SELECT r.doc, r.page, r.region, least(r.x0, coalesce(w0, r.x0)) AS x0, greatest(r.x1, coalesce(w1, r.x1)) AS x1, coalesce(w0 < r.x0 OR w1 > r.x1, false) AS healed FROM r LEFT JOIN c ON c.doc = r.doc AND c.page = r.page AND c.region = r.region""")
def line_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    return regions.heal(_region(lines), lines).select("doc", "page", "region", "x0", "x1", "healed")


FILL = "SELECT doc, page, line + 5 AS seqno, x0 - 2 AS x0, y0 - 13 AS y0, x1 + 40 AS x1, y1 + 1 AS y1, CASE WHEN line % 8 = 0 THEN 0.5 ELSE 1.0 END AS opacity FROM page WHERE line % 4 = 0"


def _fill(lines: DataFrame) -> DataFrame:
    return lines.where("line % 4 = 0").select("doc", "page", (F.col("line") + 5).alias("seqno"), (F.col("x0") - 2).alias("x0"), (F.col("y0") - 13).alias("y0"), (F.col("x1") + 40).alias("x1"), (F.col("y1") + 1).alias("y1"), F.array(F.lit(1.0)).alias("fill"), F.when(F.col("line") % 8 == 0, 0.5).otherwise(1.0).alias("opacity"))


@query(rf"""WITH {PAGES}, f AS ({FILL})
SELECT doc, page, line FROM page s WHERE EXISTS (SELECT 1 FROM f WHERE f.doc = s.doc AND f.page = s.page AND f.opacity >= 0.9 AND f.seqno > s.line
 AND greatest(least(s.x1, f.x1) - greatest(s.x0, f.x0), 0) * greatest(least(s.y1, f.y1) - greatest(s.y0, f.y0), 0) > 0.9 * (s.x1 - s.x0) * (s.y1 - s.y0))""")
def covered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    return regions.covered_spans(lines.withColumn("seqno", F.col("line")), _fill(lines)).select("doc", "page", "line")


@query(rf"""WITH {PAGES}, f AS ({FILL}), s AS (SELECT * FROM page),
h AS (SELECT doc, page, x0 - 0.5 AS x0, y0 - 0.5 AS y0, x1 + 0.5 AS x1, y1 + 0.5 AS y1 FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.doc = s.doc AND f.page = s.page AND f.opacity = 1 AND f.seqno > s.line AND f.x0 <= s.x0 AND f.y0 <= s.y0 AND s.x1 <= f.x1 AND s.y1 <= f.y1)),
c AS (SELECT g.doc, g.page, g.line, g.x0, g.y0, g.x1, g.y1, EXISTS (SELECT 1 FROM h WHERE h.doc = g.doc AND h.page = g.page AND h.x0 <= g.x0 AND h.y0 <= g.y0 AND g.x1 <= h.x1 AND g.y1 <= h.y1) AS hid FROM s g)
SELECT doc, page, line FROM c WHERE hid AND EXISTS (SELECT 1 FROM c o WHERE o.doc = c.doc AND o.page = c.page AND NOT o.hid AND greatest(least(c.x1, o.x1) - greatest(c.x0, o.x0), 0) * greatest(least(c.y1, o.y1 + 9) - greatest(c.y0, o.y0 + 9), 0) > 0.4 * (c.x1 - c.x0) * (c.y1 - c.y0))""")
def ghost_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines wholly under a later fill whose place another line, set 9 lower, still takes."""
    lines = _page(spark, sf_dir).withColumns({"seqno": F.col("line"), "font": F.lit("F"), "size": F.lit(10.0)})
    hidden = regions.covered_spans(lines, _fill(lines), None)
    own = G.pad(G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 0.5)
    covered, rest = regions.hidden_styles(lines, hidden.withColumn("r", own).select("doc", "page", "font", "size", "r.*"))
    return regions.ghosts(covered, rest.withColumns({"y0": F.col("y0") + 9, "y1": F.col("y1") + 9}))[0].select("doc", "page", "line")


@query(rf"""WITH {PAGES}, r AS ({REGION}), k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY conf DESC, region) - 1 AS rank FROM r WHERE conf > 0.25),
b AS (SELECT doc, page, rank, cls = 'figure' AS kept, least(greatest(trunc(x0)::INT - 1, 0), 599) AS bx0, least(greatest(trunc(y0)::INT - 1, 0), 799) AS by0, least(greatest(trunc(x1)::INT + 1, 0), 599) AS bx1, least(greatest(trunc(y1)::INT + 1, 0), 799) AS by1 FROM k),
t AS (SELECT doc, page, line, least(greatest(trunc(x0 + 35)::INT, 0), 599) AS x, least(greatest(trunc(y0)::INT, 0), 799) AS y FROM page),
m AS (SELECT t.doc, t.page, t.line, max(CASE WHEN bx0 <= x AND x < bx1 AND by0 <= y AND y < by1 THEN CASE WHEN kept THEN 1000000 ELSE rank END END) AS best FROM t LEFT JOIN b ON b.doc = t.doc AND b.page = t.page GROUP BY t.doc, t.page, t.line)
SELECT doc, page, line, CAST(CASE WHEN best IS NULL THEN 1 WHEN best = 1000000 THEN 0 ELSE best + 2 END AS INTEGER) AS region FROM m""")
def region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    boxes = regions.confident(_region(lines).withColumnsRenamed({"region": "i"}).withColumns({"width": F.lit(600), "height": F.lit(800)}))
    return regions.label(lines.select("doc", "page", "line", (F.col("x0") + 35).alias("x"), F.col("y0").alias("y")), boxes).select("doc", "page", "line", "region")


@query(rf"""WITH {PAGES}, n AS (SELECT doc, page, line AS link, x0, y0, x1, y1, unnest([1, 2]) AS needle_rank FROM page WHERE line % 6 = 0),
m AS (SELECT *, CASE needle_rank WHEN 1 THEN link % 12 ELSE link % 5 END AS needle FROM n), h AS (SELECT doc, page, CASE WHEN line % 4 = 0 THEN line % 5 ELSE -1 END AS needle, x0 + 11 AS x0, y0 + 3 AS y0, x1 + 11 AS x1, y1 + 3 AS y1 FROM page),
d AS (SELECT m.doc, m.page, m.link, m.needle_rank, h.x0, h.y0, row_number() OVER (PARTITION BY m.doc, m.page, m.link ORDER BY m.needle_rank, sqrt(power((m.x0 + m.x1 - h.x0 - h.x1) / 2, 2) + power((m.y0 + m.y1 - h.y0 - h.y1) / 2, 2)), h.x0, h.y0, h.x1, h.y1) AS k FROM m JOIN h ON h.doc = m.doc AND h.page = m.page AND h.needle = m.needle)
SELECT doc, page, link, needle_rank, x0, y0 FROM d WHERE k = 1""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    n = lines.where("line % 6 = 0").select("doc", "page", F.col("line").alias("link"), "x0", "y0", "x1", "y1", F.explode(F.array(F.lit(1), F.lit(2))).alias("needle_rank"))
    n = n.withColumn("needle", F.when(F.col("needle_rank") == 1, F.col("link") % 12).otherwise(F.col("link") % 5))
    h = lines.select("doc", "page", F.when(F.col("line") % 4 == 0, F.col("line") % 5).otherwise(-1).alias("needle"), (F.col("x0") + 11).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x1") + 11).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return regions.reanchor(n, h).select("doc", "page", "link", "needle_rank", "x0", "y0")


@query(r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc, page_id, CAST(length(html) AS DOUBLE) AS area, length(html) * (page_id % 10) / 9.0::DOUBLE AS images, length(url) AS chars FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_id) AS n FROM p), m AS (SELECT doc, sum(images / area) / count(*) AS coverage, CAST(floor(sum(chars) / count(*)) AS BIGINT) AS chars FROM f WHERE n <= 5 GROUP BY doc)
SELECT doc, round(coverage, 2) AS coverage, chars, coverage >= 0.8 AND chars > 50 AS scanned FROM m""")
def scan_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    area = F.length("html").cast("double")
    pages = p.select(host.alias("doc"), F.col("page_id").alias("page"), area.alias("page_area"), (area * (F.col("page_id") % 10) / 9.0).alias("image_area"), F.length("url").alias("page_chars"))
    return detect.scanned(pages).select("doc", F.round("coverage", 2).alias("coverage"), "chars", "scanned")


#: Letters of the carrier for pages in another script.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз"


@query(rf"""WITH {PAGES}, t AS (SELECT doc, page, string_agg(CASE WHEN doc % 3 = 0 AND (page + doc) % 2 = 0 THEN translate(text, '{LATIN}', '{CYRILLIC}') ELSE text END, chr(10) ORDER BY line) AS text FROM page GROUP BY doc, page),
c AS (SELECT doc, len(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]')) AS n, len(regexp_extract_all(text, '[A-Za-zªµºÀ-ÖØ-öø-\x{{024F}}]')) AS latin FROM t)
SELECT doc, round(coalesce(sum(CASE WHEN n + latin >= 50 AND n >= 0.5 * (n + latin) THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN n + latin >= 50 THEN 1 ELSE 0 END), 0), 0.0::DOUBLE), 6) AS ratio, sum(CASE WHEN n + latin >= 50 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN n + latin >= 50 AND n >= 0.5 * (n + latin) THEN 1.0 ELSE 0 END) >= 0.25 * sum(CASE WHEN n + latin >= 50 THEN 1 ELSE 0 END) AS hit FROM c GROUP BY doc""")
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents judged for Cyrillic; every second page of every third document is written in it."""
    other = (F.col("doc") % 3 == 0) & ((F.col("page") + F.col("doc")) % 2 == 0)
    lines = _page(spark, sf_dir).withColumn("text", F.when(other, F.translate("text", LATIN, CYRILLIC)).otherwise(F.col("text")))
    pages = lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return detect.already_translated(pages, "ru").withColumn("ratio", F.round("ratio", 6))


@query(rf"""WITH {PAGES} SELECT doc, page, CAST(sum(CASE WHEN regexp_matches(CASE WHEN line % 3 = 0 THEN text || ' . . . . . ' || line ELSE text END, '(?:[.·]{WS}?){{4,}}') THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM page GROUP BY doc, page
HAVING sum(CASE WHEN regexp_matches(CASE WHEN line % 3 = 0 THEN text || ' . . . . . ' || line ELSE text END, '(?:[.·]{WS}?){{4,}}') THEN 1 ELSE 0 END) >= 4""")
def leader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line gets dot leaders, as the carrier has none; pages with four such lines are contents pages."""
    lines = _page(spark, sf_dir)
    return detect.contents_pages(lines.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat("text", F.lit(" . . . . . "), F.col("line").cast("string"))).otherwise(F.col("text"))))


@query(rf"""WITH {PAGES}, w AS (SELECT DISTINCT doc, page FROM page), m AS (SELECT doc, page, page % 3 = 1 OR doc % 5 = 0 AS toc FROM w), k AS (SELECT *, bool_or(NOT toc) OVER (PARTITION BY doc) AS others FROM m) SELECT doc, page FROM k WHERE NOT toc OR NOT others""")
def contents_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _page(spark, sf_dir).select("doc", "page").distinct()
    return detect.without_contents(wanted, wanted.where("page % 3 = 1 OR doc % 5 = 0"))


@query("SELECT page_id, CAST(page_id * 2 AS BIGINT) AS \"at\", CAST(0 AS INTEGER) AS side FROM pages UNION ALL SELECT page_id, CAST(page_id * 2 + 1 AS BIGINT), CAST(1 AS INTEGER) FROM pages")
def dual_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id")
    return regions.interleave(p, p, "page_id").select("page_id", "at", "side")


@query("SELECT a.page_id, b.page_id AS target FROM pages a JOIN pages b ON b.page_id = a.page_id * 2 + 1")
def page_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id")
    return p.join(p.select(F.col("page_id").alias("target")), regions.remap(F.col("page_id"), True) == F.col("target")).select("page_id", "target")


@query("SELECT item_id, CAST(unnest(list_concat(range(item_id % 4, item_id % 4 + 3), [item_id % 7 + 9])) AS INTEGER) AS page FROM benchmark")
def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark", "item_id")
    i = F.col("item_id")
    spec = F.concat_ws("", (i % 4 + 1).cast("string"), F.lit("-"), (i % 4 + 3).cast("string"), F.lit(", "), (i % 7 + 10).cast("string"))
    return b.select("item_id", F.explode(regions.page_numbers(spec)).alias("page"))


@query("WITH k AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN ['mono', 'dual'] WHEN quality = 1 THEN ['mono'] WHEN toxic = 1 THEN ['dual'] ELSE [] END AS kinds FROM labels) SELECT doc_id, unnest(list_filter(['mono', 'dual'], lambda x: NOT list_contains(kinds, x))) AS missing FROM k")
def kinds_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    kinds = F.filter(F.array(F.when(F.col("quality") == 1, "mono"), F.when(F.col("toxic") == 1, "dual")), lambda x: x.isNotNull())
    return lab.withColumn("kinds", kinds).select("doc_id", F.explode(jobs.missing_kinds(lab)).alias("missing"))


# ---- content streams, links, lookups ------------------------------------------------------------

STROKE = "SELECT doc, page, line AS seq, CASE WHEN line % 3 = 0 THEN 'f' ELSE 'S' END AS kind, x0, y0, x1, CASE WHEN line % 4 = 0 THEN y1 ELSE y0 END AS ye, line % 5 = 0 AS red, CAST(line % 9 AS DOUBLE) AS linewidth FROM page"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier for paths: a stroke under each line, some filled, some slanted, some coloured."""
    lines, i = _page(spark, sf_dir), F.col("line")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.when(i % 4 == 0, F.col("y1")).otherwise(F.col("y0"))))
    return lines.select("doc", "page", i.alias("seq"), F.when(i % 3 == 0, "f").otherwise("S").alias("kind"), ends.alias("points"), F.when(i % 5 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0))).alias("colour"), (i % 9).cast("double").alias("linewidth"))


@query(rf"""WITH {PAGES}, s AS ({STROKE}) SELECT doc, page, seq, x0 AS px0, y0 AS py0, x1 AS px1, ye AS py1, linewidth FROM s WHERE kind = 'S' AND y0 = ye AND NOT red AND linewidth < 5""")
def layout_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.drawn_lines(content.layout_strokes(_paths(spark, sf_dir)))


NAMES = ["Tj", "re", "BDC", "cm", "EMC", "n", "T*", "BI"]


@query(rf"""WITH {PAGES}, o AS (SELECT doc, page, line, list_extract({NAMES}, line % 8 + 1) AS name FROM page),
k AS (SELECT *, CASE WHEN name IN ('EMC', 'n', 'T*', 'BI') THEN '' ELSE printf('%.6f', line / 4.0::DOUBLE) || ' /F' || line END AS args FROM o WHERE name NOT LIKE 'T%' AND name NOT IN ('BDC', 'EMC', 'BI'))
SELECT doc, page, md5(string_agg(args || ' ' || name || ' ', '' ORDER BY line)) AS ops_md5, count(*) AS operators FROM k GROUP BY doc, page""")
def residual_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, i = _page(spark, sf_dir), F.col("line")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (i % 8 + 1).cast("int"))
    arg = lambda t, real: F.struct(t.alias("text"), F.lit(real).alias("real"))
    ops = lines.select("doc", "page", i.alias("seq"), name.alias("name")).withColumn("args", F.when(F.col("name").isin("EMC", "n", "T*", "BI"), F.array().cast("array<struct<text:string,real:boolean>>")).otherwise(F.array(arg((F.col("seq") / 4).cast("string"), True), arg(F.concat(F.lit("/F'"), F.col("seq").cast("string")), False))))
    text = content.residual(ops)
    return text.select("doc", "page", F.md5("ops").alias("ops_md5"), F.regexp_count("ops", F.lit("(?:re|cm|n) ")).cast("long").alias("operators"))


@query(rf"WITH {PAGES} SELECT doc, page, line FROM page WHERE line % 6 <> 3 AND length(text) > 10")
def visible_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _page(spark, sf_dir).withColumns({"type": F.when(F.col("line") % 6 == 3, 3).when(F.col("line") % 2 == 0, 0), "n_chars": F.greatest(F.length("text") - 10, F.lit(0))})
    return content.visible(spans).select("doc", "page", "line")


@query(rf"""WITH {PAGES}, a AS (SELECT doc, page, line, text AS anchor FROM page WHERE line % 4 = 0),
n AS (SELECT doc, page, line, regexp_replace(anchor, '^{WS}+|{WS}+$', '', 'g') AS anchor FROM a),
l AS (SELECT doc, page, line, list_concat([anchor], regexp_extract_all(anchor, '[0-9][\p{{L}}\p{{M}}\p{{Nd}}_.+\-]*|[A-Z][\p{{L}}\p{{M}}\p{{Nd}}_.+\-]+')) AS needles FROM n WHERE anchor <> '')
SELECT doc, page, line, CAST(generate_subscripts(needles, 1) - 1 AS INTEGER) AS needle_rank, unnest(needles) AS needle FROM l""")
def link_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _page(spark, sf_dir).where("line % 4 = 0").select("doc", "page", "line", F.col("text").alias("anchor"))
    return content.needles(links)


@query(rf"""WITH {PAGES}, n AS (SELECT doc, count(DISTINCT page) AS n FROM page GROUP BY doc), l AS (SELECT doc, line, CASE line % 3 WHEN 0 THEN 'goto' WHEN 1 THEN 'uri' ELSE 'launch' END AS kind, line % 5 - 1 AS dest FROM page)
SELECT l.doc, l.line, kind, CAST(CASE WHEN kind = 'goto' THEN dest * 2 + 1 END AS BIGINT) AS target FROM l JOIN n ON n.doc = l.doc WHERE kind = 'uri' OR (kind = 'goto' AND dest >= 0 AND dest < n)""")
def link_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir)
    kind = F.when(F.col("line") % 3 == 0, "goto").when(F.col("line") % 3 == 1, "uri").otherwise("launch")
    links = lines.select("doc", "line", kind.alias("kind"), (F.col("line") % 5 - 1).cast("long").alias("dest_page"))
    return content.destinations(links, lines.select("doc", "page").distinct(), True).select("doc", "line", "kind", "target")


@query(rf"""WITH {PAGES}, u AS (SELECT doc, page FROM page WHERE line % 3 = 0 UNION ALL SELECT doc, page FROM page WHERE line % 7 = 0) SELECT doc, count(*) AS regions, count(DISTINCT page) AS pages FROM u GROUP BY doc""")
def regions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page(spark, sf_dir).select("doc", "page", "line")
    return content.region_counts(content.merged_regions(lines.where("line % 3 = 0"), lines.where("line % 7 = 0")))


@query("SELECT n_nationkey, CASE lower(n_name) WHEN 'en' THEN 1.2 ELSE CASE n_nationkey % 4 WHEN 0 THEN 1.4 WHEN 1 THEN 0.8 ELSE 1.1 END END::DOUBLE AS height FROM nation")
def line_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_nationkey")
    code = F.element_at(F.array(F.lit("zh"), F.lit("ru"), F.lit("xx"), F.lit("yy")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select("n_nationkey", content.looked_up(typeset.LINE_HEIGHT, code, typeset.DEFAULT_HEIGHT).alias("height"))


@query("WITH f AS (SELECT o_custkey AS job, 'f' || o_orderkey % 7 AS path, o_orderkey % 7 < 5 AS made FROM orders), r AS (SELECT DISTINCT job, path FROM f WHERE NOT made AND (job, path) NOT IN (SELECT (job, path) FROM f WHERE made)) SELECT job, min(path) AS path FROM r GROUP BY job HAVING count(*) = 1")
def job_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("job"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("path"), (F.col("o_orderkey") % 7 < 5).alias("made"))
    return jobs.single_source(f.select("job", "path").distinct(), f.where("made").select("job", "path"))


@query("SELECT event_id, round(CASE event_type WHEN 'view' THEN 0.0 + 0.1 * value / 500 WHEN 'click' THEN 0.1 + 0.5 * value / 500 WHEN 'purchase' THEN 0.6 + 0.4 * value / 500 END, 9) AS progress FROM events")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    phase = F.when(F.col("event_type") == "view", "collect").when(F.col("event_type") == "click", "context").when(F.col("event_type") == "purchase", "layout")
    return e.select("event_id", F.round(jobs.progress(phase, F.col("value"), F.lit(500)), 9).alias("progress"))


@query(r"SELECT p_partkey, CAST(ceil(CAST(round_even(h * least(1024.0 / h, 1024.0 / w), 0) AS INTEGER) / 32.0) * 32 AS INTEGER) AS height, CAST(ceil(CAST(round_even(w * least(1024.0 / h, 1024.0 / w), 0) AS INTEGER) / 32.0) * 32 AS INTEGER) AS width FROM (SELECT p_partkey, CAST(100 + p_size * 17 AS DOUBLE) AS h, CAST(100 + p_partkey % 977 AS DOUBLE) AS w FROM part)")
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    f = G.fitted((100 + F.col("p_size") * 17).cast("double"), (100 + F.col("p_partkey") % 977).cast("double"), 1024, 32)
    return p.select("p_partkey", f["height"].alias("height"), f["width"].alias("width"))


@query("SELECT DISTINCT doc_id, list_extract(string_split(text, ' '), 1) AS term, list_sort(list_distinct([lower(list_extract(string_split(text, ' '), 1)), list_extract(string_split(text, ' '), 1)])) AS forms FROM documents WHERE length(text) > 0".replace("doc_id, ", ""))
def glossary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "text").where(F.length("text") > 0).select(F.split("text", " ")[0].alias("term"))
    forms = d.select("term", F.explode(F.array(F.lower("term"), F.col("term"))).alias("form"))
    return terms.forms_by_term(forms)


# ---- segmentation and typesetting on glyphs made from the carrier --------------------------------

#: Boxes of the hidden-text carrier: x0, y0, x1, y1 and how many glyphs each hides.
HIDDEN = [(0.0, 760.0, 600.0, 820.0, 20), (100.0, 700.0, 300.0, 800.0, 15)]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier for glyphs: a page is 40 lines, its glyphs their words, in twelve columns that wide words reach over.

    Three lines share a region, every eleventh is kept as it is, every seventh begins in a font of
    formulas, and a rule stands under every fifth. Brackets are square. One row a page, no shuffle.
    """
    docs = _paras(spark, sf_dir).where(F.size("paras") > 0)
    page = F.sequence(F.lit(0), F.floor((F.size("paras") - 1) / 40).cast("int"))
    docs = docs.select(F.col("doc_id").cast("string").alias("doc"), "paras", F.explode(page).alias("page"))
    empty, one = F.lit(None).cast("array<double>"), F.lit(1.0)

    def line(text: Column, at: Column) -> Column:
        i, y = F.col("page") * 40 + at, 800.0 - at * 12.0
        region = F.when(i % 11 == 5, 0).otherwise(2 + F.floor(i / 3)).cast("int")

        def item(kind: str, text: Column, x0: Column, y0: Column, x1: Column, y1: Column, size: float, font: Column) -> Column:
            return F.struct(F.lit(0).alias("container"), F.lit(kind).alias("kind"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(size).alias("size"), font.alias("font"), one.alias("m0"), one.alias("m3"), region.alias("region"), empty.alias("color"))

        def word(w: Column, k: Column) -> Column:
            x = 72.0 + (k % 12) * 40.0
            font = F.when((i % 7 == 3) & (k < 3), "ABCDEF+CMMI10").otherwise("ABCDEF+Times")
            return item("glyph", w, x, y, x + F.length(w) * 6.0, y + 10.0, 10.0, font)

        words = F.transform(F.filter(F.split(F.translate(text, "()", "[]"), " "), lambda w: w != ""), word)
        rule = F.array(item("line", F.lit(""), F.lit(72.0), y - 2.0, F.lit(172.0), y - 2.0, 1.0, F.lit("")))
        return F.concat(words, F.when(i % 5 == 0, rule).otherwise(F.filter(rule, lambda _: F.lit(False))))

    items = F.flatten(F.transform(F.slice("paras", F.col("page") * 40 + 1, 40), line))
    return docs.select("doc", "page", F.lit(600.0).alias("page_width"), items.alias("items"))


def _segment_sql(hidden: bool = False) -> str:
    """Paragraphs and formulas of the carrier by windows: its sizes are one, so only regions, fonts, characters and places tell."""
    inside = lambda b: f"((x0 + x1) / 2 BETWEEN {b[0]} AND {b[2]} AND y0 + 5 BETWEEN {b[1]} AND {b[3]})"
    first, second = HIDDEN
    stay = f"""h1 AS (SELECT *, {inside(first)} AND sum(CAST({inside(first)} AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY i, k) <= {first[4]} AS gone1 FROM g0),
h2 AS (SELECT *, NOT gone1 AND {inside(second)} AS in2 FROM h1),
g AS (SELECT * EXCLUDE (gone1, in2, gone2) FROM (SELECT *, in2 AND sum(CAST(in2 AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY i, k) <= {second[4]} AS gone2 FROM h2) WHERE NOT gone1 AND NOT gone2)"""
    return rf"""{PARAS},
l AS (SELECT doc_id, i, list_filter(string_split(translate(text, '()', '[]'), ' '), lambda w: w <> '') AS ws FROM p),
w AS (SELECT doc_id, i, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS k, unnest(ws) AS t FROM l),
g0 AS (SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(i // 40 AS INTEGER) AS page, i, k, t, CAST(72 + 40 * (k % 12) AS DOUBLE) AS x0, CAST(72 + 40 * (k % 12) + 6 * length(t) AS DOUBLE) AS x1,
  CAST(800 - 12 * (i % 40) AS DOUBLE) AS y0, CASE WHEN t = '•' OR i % 11 = 5 THEN 0 ELSE 2 + i // 3 END AS region FROM w),
{stay if hidden else "g AS (SELECT * FROM g0)"},
a AS (SELECT *, row_number() OVER o AS n, lag(x0) OVER o AS px0, lag(x1) OVER o AS px1, lag(y0) OVER o AS py0, coalesce(region <> lag(region) OVER o, true) AS moved,
  region = 0 OR (i % 7 = 3 AND k < 3) OR regexp_matches(t, '^[\p{{Lm}}\p{{Mn}}\p{{Sk}}\p{{Sm}}\p{{Zl}}\p{{Zp}}\p{{Zs}}\x{{0370}}-\x{{03FF}}]') AS f FROM g WINDOW o AS (PARTITION BY doc, page ORDER BY i, k)),
b AS (SELECT *, sum(CAST(moved AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY n) AS island FROM a),
c AS (SELECT *, moved OR n = coalesce(min(CASE WHEN NOT f THEN n END) OVER (PARTITION BY doc, page, island), -1) AND bool_and(f) OVER (PARTITION BY doc, page, island ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new FROM b),
d AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY n) - 1 AS para, lag(f) OVER (PARTITION BY doc, page ORDER BY n) AS pf FROM c),
e AS (SELECT *, f AND (new OR NOT pf OR (abs(x0 - px0) > 150 AND NOT bool_and(f) OVER (PARTITION BY doc, page, para))) AS opens, x0 > px1 + 1 AS gap, x1 < px0 AS back FROM d),
s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY n) - 1 AS formula, NOT new AND (NOT f OR opens) AS joins FROM e)"""


@query(rf"""WITH {_segment_sql()}
SELECT doc, page, CAST(para AS INTEGER) AS para, md5(string_agg(CASE WHEN joins AND (gap OR back) THEN ' ' ELSE '' END || CASE WHEN NOT f THEN t WHEN opens THEN '{{v' || formula || '}}' ELSE '' END, '' ORDER BY n)) AS text_md5,
min(x0) AS x0, max(x1) AS x1, arg_min(y0, n) AS y, bool_or(joins AND back AND NOT gap) AS brk FROM s GROUP BY doc, page, para""")
def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segment.segment(_pages(spark, sf_dir))
    return s.select("doc", "page", "para", F.md5("text").alias("text_md5"), "x0", "x1", "y", "brk")


@query(rf"""WITH {_segment_sql()},
q AS (SELECT *, lead(f) OVER o AS nf, lead(island) OVER o AS ni, lead(x0) OVER o AS nx, lead(y0) OVER o AS ny, n = max(n) OVER (PARTITION BY doc, page, i) AND i % 5 = 0 AS ruled FROM s WINDOW o AS (PARTITION BY doc, page ORDER BY n)),
m AS (SELECT doc, page, formula, md5(string_agg(t, '' ORDER BY n)) AS text_md5, max(x1) - arg_min(x0, n) AS width, max(x0) AS mx, arg_min(y0, n) AS fy, CAST(sum(CAST(ruled AS INTEGER)) AS INTEGER) AS lines,
  arg_min(CASE WHEN NOT new AND x0 > px0 THEN y0 - py0 ELSE 0.0 END, n) AS lift, arg_max(struct_pack(x := CASE WHEN NOT nf AND ni = island THEN nx END, y := ny), n) AS after,
  arg_max(CASE WHEN regexp_matches(t, '^[\p{{Lm}}\p{{Mn}}\p{{Sk}}]') THEN x1 - x0 ELSE 0.0 END, n) AS modifier FROM q WHERE f GROUP BY doc, page, formula)
SELECT doc, page, CAST(formula AS INTEGER) AS formula, text_md5, width, CAST(CASE WHEN after.x > mx THEN fy - after.y ELSE lift END AS DOUBLE) AS shift, CAST(modifier AS DOUBLE) AS modifier, lines FROM m""")
def segment_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segment.formulas(_pages(spark, sf_dir))
    return f.select("doc", "page", "formula", F.md5("text").alias("text_md5"), "width", "shift", "modifier", F.size("lines").alias("lines"))


@query(rf"""WITH {_segment_sql(hidden=True)},
u AS (SELECT doc, page, para, string_agg(CASE WHEN joins AND (gap OR back) THEN ' ' ELSE '' END || CASE WHEN NOT f THEN t WHEN opens THEN '{{v' || formula || '}}' ELSE '' END, '' ORDER BY n) AS text FROM s GROUP BY doc, page, para)
SELECT doc, page, CAST(para AS INTEGER) AS para, md5(text) AS text_md5 FROM u""")
def hidden_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation with two hidden boxes that overlap, each of which takes the first glyphs it still finds."""
    box = lambda b: F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1", "n"), b, strict=True)])
    s = segment.segment(_pages(spark, sf_dir).withColumn("hidden", F.array(*map(box, HIDDEN))))
    return s.select("doc", "page", "para", F.md5("text").alias("text_md5"))


#: Advances of the carrier's two fonts, in the size.
WIDTHS = {("tiro", chr(c)): 0.6 for c in range(32, 127)}


@query()
def typeset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page set anew, in capitals, as the content stream of its container."""
    pages = typeset.translated(segment.read(_pages(spark, sf_dir)), with_text=F.upper)
    streams = typeset.drawn(typeset.typeset(pages, WIDTHS))
    return streams.select("doc", "page", F.md5("stream").alias("stream_md5"), F.length("stream").alias("chars"), F.regexp_count("stream", F.lit(" TJ ")).alias("runs"), F.regexp_count("stream", F.lit(" l S ")).alias("lines"))



_HEIGHTS = ["1.2::DOUBLE" + " - 0.05::DOUBLE" * k for k in range(5)]
_HEIGHT = "CASE " + " ".join(f"WHEN NOT n * 10.0::DOUBLE * ({h}) > high THEN {h}" for h in _HEIGHTS) + f" ELSE {_HEIGHTS[4]} END"


@query(rf"""WITH {PARAS},
t AS (SELECT doc_id, i, i % 3 = 0 AS f, CASE WHEN i % 3 = 0 THEN '##' ELSE '' END || regexp_replace(text, '[^!-z]', '_', 'g') AS cells, 10.0::DOUBLE * (1 + length(text) % 7) AS high FROM p),
n AS (SELECT *, CAST(ceil(length(cells) / 40.0) AS INTEGER) AS n FROM t),
h AS (SELECT *, {_HEIGHT} AS height FROM n),
l AS (SELECT *, unnest(range(n)) AS line FROM h),
o AS (SELECT doc_id, i, CAST(line AS INTEGER) AS line, 'text' AS kind, 'tiro' AS font, CASE WHEN f AND line = 0 THEN substr(cells, 3, 38) ELSE substr(cells, line * 40 + 1, 40) END AS text,
  CASE WHEN f AND line = 0 THEN 84.0 ELSE 72.0 END AS x, 700.0 - i - line * 10 * height AS y, CASE WHEN f AND line = 0 THEN '0 g ' ELSE '' END AS color FROM l
  UNION ALL SELECT doc_id, i, 0, 'text', 'CM', 'x', 72.0, 700.0 - i, '1.000000 0.000000 0.000000 rg ' FROM h WHERE f
  UNION ALL SELECT doc_id, i, 0, 'line', '', '', 73.0, 698.0 - i, '' FROM h WHERE f)
SELECT CAST(doc_id AS VARCHAR) AS doc, i AS para, line, kind, font, md5(text) AS text_md5, CAST(x AS DOUBLE) AS x, round(CAST(y AS DOUBLE), 4) AS y, color FROM o""")
def typeset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs set in columns forty cells wide, every third behind a red formula two cells wide with a line under it."""
    pair = "struct<text:string,font:string,size:double,x:double,y:double,color:array<double>>"
    formula = F.struct(F.lit(0).alias("container"), F.lit(0).alias("formula"), F.lit("x").alias("text"), F.lit(12.0).alias("width"), F.lit(2.0).alias("shift"), F.lit(0.0).alias("modifier"), F.array(F.struct(F.lit("x").alias("text"), F.lit("CM").alias("font"), F.lit(9.0).alias("size"), F.lit(300.0).alias("x"), F.lit(50.0).alias("y"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("color")).cast(pair)).alias("glyphs"), F.array(F.struct(F.lit(301.0).alias("x"), F.lit(48.0).alias("y"), F.lit(5.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("width"))).alias("lines"))

    def para(p: Column, i: Column) -> Column:
        said = F.concat(F.when(i % 3 == 0, "{v0}").otherwise(""), F.regexp_replace(p, "[^!-z]", "_"))
        return F.struct(F.lit(0).alias("container"), i.alias("para"), p.alias("text"), F.lit(72.0).alias("x"), (700.0 - i).alias("y"), F.lit(72.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(312.0).alias("x1"), (10.0 * (1 + F.length(p) % 7)).alias("y1"), F.lit(10.0).alias("size"), F.lit(True).alias("brk"), said.alias("translation"))

    rules = F.array().cast("array<struct<container:int,x:double,y:double,dx:double,dy:double,width:double>>")
    pages = _paras(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("page"), F.transform("paras", para).alias("paras"), F.array(formula).alias("formulas"), rules.alias("rules"))
    ops = typeset.typeset(pages, WIDTHS).select("doc", F.explode("ops").alias("o"))
    none = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(""))
    return ops.select("doc", "o.para", F.coalesce("o.line", F.lit(0)).alias("line"), "o.kind", none("font").alias("font"), F.md5(none("text")).alias("text_md5"), "o.x", F.round("o.y", 4).alias("y"), none("color").alias("color"))


from papyra.plans import scalars  # noqa: E402,F401  it adds its queries to these
