"""Named queries of scalar functions and small lookups, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions import text as X
from papyra.operators import cache, jobs, regions, typeset
from papyra.operators import paragraphs as P
from papyra.plans.registry import FILL, PAGES, PARAS, _fill, _page, _paras, query, table
from papyra.sources import adapters, files


@query(r"""WITH t AS (SELECT doc_id, text, chr(7) || coalesce(text, '') || chr(8203) AS c, '<think>' || substr(text, 1, 30) || chr(10) || '</think>' || text AS r FROM documents)
SELECT doc_id, md5(regexp_replace(c, '\p{C}', '', 'g')) AS clean_md5, coalesce(md5(regexp_replace(r, '\A(?s)<think>.+?</think>', '')), '') AS answer_md5 FROM t""")
def replies_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without control characters, and replies without the deliberation put before them."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    reply = F.concat(F.lit("<think>"), F.substring("text", 1, 30), F.lit("\n</think>"), F.col("text"))
    return d.select("doc_id", F.md5(X.without_controls(F.concat(F.lit("\x07"), F.coalesce("text", F.lit("")), F.lit("​")))).alias("clean_md5"), F.coalesce(F.md5(X.without_thinking(reply)), F.lit("")).alias("answer_md5"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace('<think>' || role || chr(10) || chr(10) || '</think>' || chr(10) || '</think>' || chr(10) || 'A ' || conv_id || ' ', '\A(?s)<think>.+?\n*(</think>|\n)*(</think>)\n*', ''))) AS answer_md5 FROM conversations""")
def streamed_replies_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    reply = F.concat(F.lit("<think>"), F.col("role"), F.lit("\n\n</think>\n</think>\nA "), F.col("conv_id").cast("string"), F.lit(" "))
    return c.select("conv_id", "turn", F.md5(X.without_thinking_streamed(reply)).alias("answer_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\p{C}', '', 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL AND text <> ''")
def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found again in web pages that show them escaped."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text <> ''")
    shown = F.col("text")
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;")):
        shown = F.replace(shown, F.lit(raw), F.lit(said))
    page = F.concat(F.lit('<html><div class="header">x</div><div class="result-container">'), shown, F.lit("</div><b>y</b>"))
    return d.select("doc_id", F.md5(X.found_translation(page)).alias("text_md5"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS suffix, string_split(url, ':')[1] AS service, substr(url, instr(url, ':') + 1) AS model FROM pages WHERE contains(url, ':')""")
def names_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url").where(F.contains("url", F.lit(":")))
    parts = X.service_and_model(F.col("url"))
    return p.select("page_id", X.stem(F.col("url")).alias("stem"), X.suffix(F.col("url")).alias("suffix"), parts["service"].alias("service"), parts["model"].alias("model"))


@query(r"SELECT conv_id, turn, md5('From ' || role || ' (' || turn || '): ' || coalesce(text, '') || ' costs $5, $other stays') AS prompt_md5 FROM conversations")
def prompts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    filled = X.fill_template("From $role (${turn}): $text costs $$5, $other stays", role=F.col("role"), turn=F.col("turn").cast("string"), text=F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", F.md5(filled).alias("prompt_md5"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'This document — Field: ' || role || chr(10) || 'Use these agreed translations where they apply: a -> ' || turn || '; b -> c' || chr(10) || chr(10)
  WHEN role = 'user' THEN 'This document — Field: ' || role || chr(10) || chr(10) WHEN turn % 2 = 0 THEN 'Use these agreed translations where they apply: a -> ' || turn || '; b -> c' || chr(10) || chr(10) ELSE '' END AS preface FROM conversations""")
def prompt_prefaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    agreed = F.array(pair(F.lit("a"), F.col("turn").cast("string")), pair(F.lit("b"), F.lit("c")))
    agreed = F.when(F.col("turn") % 2 == 0, agreed).otherwise(F.slice(agreed, 1, 0))
    return c.select("conv_id", "turn", X.prompt_preface({"field": F.when(F.col("role") == "user", F.col("role")).otherwise("")}, agreed).alias("preface"))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'e', 'ee'), 'ee', 'a'), 'aa', '')) AS text_md5, substr(text, 1, 300) AS clip FROM documents WHERE text IS NOT NULL")
def replaced_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    pairs = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("e", "ee"), ("ee", "a"), ("aa", ""))])
    return d.select("doc_id", F.md5(X.replace_chain(F.col("text"), pairs)).alias("text_md5"), X.clipped(F.col("text"), 300).alias("clip"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: printf('%04x', unicode(c))), '') AS wide, array_to_string(list_transform(string_split(p_name, ''), lambda c: printf('%02x', unicode(c))), '') AS narrow,
CASE p_partkey % 5 WHEN 0 THEN '0 g ' WHEN 2 THEN '0 g ' ELSE array_to_string(list_transform(range(p_partkey % 5), lambda i: printf('%f', (p_size + i) / 64.0::DOUBLE)), ' ') || ' ' || CASE p_partkey % 5 WHEN 1 THEN 'g' WHEN 3 THEN 'rg' ELSE 'k' END || ' ' END AS colour,
'/F' || p_size || ' ' || printf('%f', p_size / 8.0::DOUBLE) || ' Tf 1 0 0 1 ' || printf('%f', p_partkey / 4.0::DOUBLE) || ' ' || printf('%f', p_size / 2.0::DOUBLE) || ' Tm [<41>] TJ ' AS text_op,
'ET q 1 0 0 1 ' || printf('%f', p_size / 8.0::DOUBLE) || ' ' || printf('%f', p_partkey / 4.0::DOUBLE) || ' cm [] 0 d 0 J 1.500000 w 0 0 m ' || printf('%f', p_size / 2.0::DOUBLE) || ' 0.000000 l S Q BT ' AS line_op FROM part""")
def drawing_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    n, size = F.col("p_partkey"), F.col("p_size").cast("double")
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n % 5), lambda i: (size + i) / 64.0)
    text = typeset.text_operator(F.concat(F.lit("F"), F.col("p_size").cast("string")), size / 8, n / 4, size / 2, F.lit("41"))
    line = typeset.line_operator(size / 8, n / 4, size / 2, F.lit(0.0), F.lit(1.5))
    return p.select("p_partkey", X.hex_glyphs(F.col("p_name"), True).alias("wide"), X.hex_glyphs(F.col("p_name"), False).alias("narrow"), X.colour_operator(parts).alias("colour"), text.alias("text_op"), line.alias("line_op"))


@query(r"""WITH v AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 90)::DOUBLE AS k, (p_partkey % 4) * 90 AS deg FROM part),
r AS (SELECT *, CASE deg WHEN 90 THEN [0.0, -1.0, 1.0, 0.0, -2.0, 100.0 + k] WHEN 180 THEN [-1.0, 0.0, 0.0, -1.0, 100.0 + k, 200.0 + s] WHEN 270 THEN [0.0, 1.0, -1.0, 0.0, 200.0 + s, -1.0] ELSE [1.0, 0.0, 0.0, 1.0, -1.0, -2.0] END AS m FROM v)
SELECT p_partkey, round(m[1] * s + m[3] * k + m[5], 6) AS x, round(m[2] * s + m[4] * k + m[6], 6) AS y, round(s / (s * (k + 1) - 1.0) , 6) AS inverse_d, round(500.0 - (k + s), 6) AS flipped_y0, round(500.0 - k, 6) AS flipped_y1 FROM r WHERE s * (k + 1) <> 1""")
def points_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points under the matrix of a page's rotation, the inverse of a matrix, rectangles turned upside down."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    s, k = F.col("p_size").cast("double"), (F.col("p_partkey") % 90).cast("double")
    m = G.rotation(F.col("p_partkey") % 4 * 90, F.lit(1.0), F.lit(2.0), 100.0 + k, 200.0 + s)
    at = G.transform_point(m, s, k)
    inverse = G.invert_2x2(F.array(s, F.lit(1.0), F.lit(1.0), k + 1))
    up = G.flip(G.rect(F.lit(0.0), k, F.lit(1.0), k + s), F.lit(500.0))
    return p.where(s * (k + 1) != 1).select("p_partkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), F.round(inverse[3], 6).alias("inverse_d"), F.round(up["y0"], 6).alias("flipped_y0"), F.round(up["y1"], 6).alias("flipped_y1"))


@query(r"""WITH v AS (SELECT p_partkey, 1024.0::DOUBLE AS h, 512.0::DOUBLE AS w, (300 + p_size * 7)::DOUBLE AS th, (200 + p_partkey % 300)::DOUBLE AS tw FROM part),
g AS (SELECT *, least(h / th, w / tw) AS gain FROM v), p AS (SELECT *, round_even((w - tw * gain) / 2 - 0.1, 0) AS px, round_even((h - th * gain) / 2 - 0.1, 0) AS py FROM g)
SELECT p_partkey, round((100 - px) / gain, 4) AS x0, round((200 - py) / gain, 4) AS y0, round((300 - px) / gain, 4) AS x1, round((400 - py) / gain, 4) AS y1 FROM p""")
def boxes_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    box = G.rect(*[F.lit(v) for v in (100.0, 200.0, 300.0, 400.0)])
    r = G.rescaled(box, F.lit(1024.0), F.lit(512.0), (300 + F.col("p_size") * 7).cast("double"), (200 + F.col("p_partkey") % 300).cast("double"))
    return p.select("p_partkey", *[F.round(r[c], 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(rf"""WITH {PARAS} SELECT doc_id, i, CASE WHEN length(text) >= 200 THEN md5(text) WHEN doc_id % 3 > 0 THEN md5('k' || i) ELSE '' END AS key_md5 FROM p""")
def cacheable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that paragraphs are remembered under; in every third document short ones have none."""
    r = P.rows(_paras(spark, sf_dir))
    mapped = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("k"), F.col("i").cast("string")))
    return r.select("doc_id", "i", F.coalesce(F.md5(P.cacheable(F.col("text"), mapped)), F.lit("")).alias("key_md5"))


@query("""SELECT conv_id, turn, '{"a":"' || turn || '","model":"m' || conv_id % 7 || '","role":"' || role || '"}' AS params FROM conversations""")
def params_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    params = F.create_map(F.lit("role"), F.col("role"), F.lit("a"), F.col("turn").cast("string"), F.lit("model"), F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")))
    return c.select("conv_id", "turn", cache.canonical_params(params).alias("params"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 2 = 0 AND l_quantity <= 20 AND l_linenumber <> 2 AND (l_linenumber <> 3 OR l_discount <= 0.05)")
def hand_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations made of order lines: kind, dashes, width and stroke from their numbers."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    n = F.col("l_linenumber")
    stroke = F.when(n == 2, F.lit(None).cast("array<double>")).when(n == 3, F.array(F.lit(0.0), F.col("l_discount") * 5, F.lit(0.1))).otherwise(F.array(F.lit(0.25)))
    dashes = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit(3.0)))
    annots = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, "Circle").otherwise("Square").alias("type"), dashes.alias("dashes"), (F.col("l_quantity") / 10).alias("width"), stroke.alias("stroke"))
    return regions.marks(annots).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_partkey % 4 <> 0 AND (p_partkey % 2 = 0 OR p_size % 3 <> 2) AS monospaced, CASE WHEN p_partkey % 2 = 0 THEN 'CourierNew' ELSE 'cmtt10' END AS base FROM part")
def monospaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fonts made of parts; a line of none, or with a proportional face in it, is no typewriter line."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    n = F.col("p_partkey")
    first = F.when(n % 2 == 0, "ABCDEF+CourierNew").otherwise("XYZ+cmtt10")
    second = F.when((n % 2 == 1) & (F.col("p_size") % 3 == 2), "ABCDEF+Times-Roman").otherwise("Menlo-Bold")
    fonts = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(first, second))
    return p.select("p_partkey", regions.is_monospaced(fonts).alias("monospaced"), X.font_base(first).alias("base"))


@query(rf"""WITH {PAGES}, f AS ({FILL}) SELECT DISTINCT s.doc, s.page, s.line FROM page s JOIN f ON f.doc = s.doc AND f.page = s.page
WHERE greatest(least(s.x1, f.x1 + 0.5) - greatest(s.x0, f.x0 - 0.5), 0) * greatest(least(s.y1, f.y1 + 0.5) - greatest(s.y0, f.y0 - 0.5), 0) > 0""")
def redrawn_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that erasing padded rectangles over others would hit."""
    lines = _page(spark, sf_dir)
    return regions.redrawn(lines, _fill(lines)).select("doc", "page", "line")


@query("""WITH j AS (SELECT o_orderkey, o_custkey FROM orders), k AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey AS job, coalesce(c_mktsegment, '') AS field, CASE WHEN c_custkey IS NULL THEN 'found' ELSE 'known' END AS title, 'found' AS topic FROM j LEFT JOIN k ON c_custkey = o_custkey""")
def job_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with what is known of their document; what this run finds fills in the rest."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("doc_key"))
    known = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 3 <> 0")
    profiles = known.select(F.col("c_custkey").alias("doc_key"), F.create_map(F.lit("field"), F.col("c_mktsegment"), F.lit("title"), F.lit("known")).alias("facts"), F.lit(None).cast("map<string,string>").alias("terms"))
    found = F.create_map(F.lit("title"), F.lit("found"), F.lit("topic"), F.lit("found"))
    facts = files.overlay(found, F.coalesce("facts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    both = files.with_profiles(orders, profiles).withColumn("facts", facts)
    return both.select("job", F.coalesce(F.try_element_at("facts", F.lit("field")), F.lit("")).alias("field"), F.col("facts")["title"].alias("title"), F.col("facts")["topic"].alias("topic"))


@query("""WITH k AS (SELECT n_regionkey AS source, n_nationkey % 3 AS target, min(n_nationkey) AS i FROM nation GROUP BY 1, 2), w AS (SELECT s_suppkey, s_nationkey % 5 AS source, s_suppkey % 4 AS target FROM supplier)
SELECT s_suppkey, k.i, n_name AS name FROM w JOIN k ON k.source = w.source AND k.target = w.target JOIN nation ON n_nationkey = k.i""")
def language_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source"), (F.col("n_nationkey") % 3).alias("target"), F.col("n_nationkey").alias("i"), F.col("n_name").alias("name"))
    wanted = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", (F.col("s_nationkey") % 5).alias("source"), (F.col("s_suppkey") % 4).cast("int").alias("target"))
    return files.language_pack(packs, wanted).select("s_suppkey", "i", "name")


@query(rf"""WITH {PAGES}, w AS (SELECT doc_id AS doc, unnest([2, 0, 1]) AS page, unnest([0, 1, 2]) AS ordinal FROM documents) SELECT w.doc, CAST(ordinal AS INTEGER) AS ordinal, b.line FROM w JOIN page b ON b.doc = w.doc AND b.page = w.page WHERE b.line % 10 = 0""")
def blocks_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the pages that each document lists as 2, 0, 1, under the place of the page in that list."""
    wanted = table(spark, sf_dir, "documents", F.col("doc_id").alias("doc")).withColumn("pages", F.array(F.lit(2), F.lit(0), F.lit(1)))
    return regions.by_ordinal(wanted, _page(spark, sf_dir).where("line % 10 = 0").select("doc", "page", "line")).select("doc", "ordinal", "line")


@query(rf"WITH {PAGES} SELECT DISTINCT doc, page FROM page WHERE page IN (0, 3)")
def pages_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.select_pages(_page(spark, sf_dir).select("doc", "page").distinct(), [3, 0, 0])


@query("SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS seconds FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants written as ISO 8601 with a Z, and read again."""
    e = table(spark, sf_dir, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return e.select("event_id", F.unix_seconds(F.to_timestamp(said)).alias("seconds"))


@query(rf"""WITH {PARAS} SELECT d.doc_id, substr(sha256(coalesce(string_agg(p.text, chr(10) ORDER BY p.i), '')), 1, 32) AS profile_key FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir).select("doc_id", P.profile_key(F.array_join("paras", "\n")).alias("profile_key"))


@query("""SELECT conv_id AS call, md5(coalesce(string_agg(CASE WHEN turn % 3 <> 2 THEN text END, '' ORDER BY turn), '')) AS text_md5, coalesce(arg_max(turn * 10, turn) FILTER (WHERE turn % 2 = 1), 0) AS usage FROM conversations GROUP BY conv_id""")
def replies_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of a reply's pieces: every third is empty, every second tells the usage so far."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    chunks = c.select(F.col("conv_id").alias("call"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 != 2, F.col("text")).alias("delta"), F.when(F.col("turn") % 2 == 1, F.col("turn") * 10).alias("usage"))
    return jobs.streamed_replies(chunks).select("call", F.md5("text").alias("text_md5"), F.coalesce("usage", F.lit(0)).alias("usage"))


_CODES = ", ".join(f"('{s.name}', '{k}', '{v}')" for s in adapters.SERVICES.values() for k, v in s.codes.items())
_NAMES = ", ".join(f"('{n}')" for n in adapters.SERVICES)


@query(f"WITH c(service, language, code) AS (VALUES {_CODES}), s(service) AS (VALUES {_NAMES}), l(language) AS (VALUES ('zh'), ('en'), ('fr')) SELECT s.service, l.language, coalesce(c.code, l.language) AS code FROM s CROSS JOIN l LEFT JOIN c ON c.service = s.service AND c.language = l.language")
def engine_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in the writing of each service."""
    some = spark.createDataFrame([(n,) for n in adapters.SERVICES], "service string")
    each = some.withColumn("language", F.explode(F.array(*map(F.lit, ("zh", "en", "fr")))))
    return each.withColumn("code", adapters.engine_code(F.col("service"), F.col("language")))
