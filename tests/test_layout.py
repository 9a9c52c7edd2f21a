"""Regions, lines, fills, links, pages, segmentation and typesetting."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.operators import detect, regions, segment, typeset

BOX = "doc string, page int, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows, more=""):
    return spark.createDataFrame([("d", 0, *map(float, r[:4]), *r[4:]) for r in rows], BOX + more)


def test_geometry(spark):
    one = spark.range(1)
    r = lambda *v: G.rect(*map(F.lit, v))
    get = lambda c: one.select(c.alias("r")).first()["r"]
    assert get(G.area(r(0, 0, 2, 3))) == 6 and get(G.area(r(2, 0, 0, 3))) == 0
    assert get(G.area(G.intersection(r(0, 0, 2, 2), r(5, 5, 6, 6)))) == 0
    assert tuple(get(G.union(r(0, 1, 2, 2), r(1, 0, 3, 1)))) == (0, 0, 3, 2)
    assert get(G.contains(r(0, 0, 2, 2), r(0, 0, 2, 2))) and not get(G.intersects(r(0, 0, 1, 1), r(1, 0, 2, 1)))
    assert tuple(get(G.flip(r(0, 10, 5, 30), F.lit(100)))) == (0, 70, 5, 90)
    assert get(G.covered_share(r(0, 0, 2, 2), r(0, 0, 1, 2))) == 0.5 and get(G.covered_share(r(0, 0, 0, 2), r(0, 0, 1, 2))) is None
    m = F.array(*map(F.lit, (2.0, 0.0, 0.0, 4.0, 1.0, 1.0)))
    assert tuple(get(G.transform_point(m, F.lit(1.0), F.lit(1.0)))) == (3, 5) and get(G.invert_2x2(m)) == [0.5, 0, 0, 0.25]
    assert get(G.fitted(F.lit(100), F.lit(200), 1024, 32))[:2] == (512, 1024)
    fit = get(G.rescaled(r(512, 512, 768, 768), F.lit(1024), F.lit(1024), F.lit(500), F.lit(300)))
    assert all(v <= 500 for v in fit)


def test_confident(spark):
    b = spark.createDataFrame([("d", 0, 0, 0.8), ("d", 0, 1, 0.9), ("d", 0, 2, 0.2), ("d", 0, 3, 0.9)], "doc string, page int, i int, conf double")
    assert [r["i"] for r in regions.confident(b).orderBy("rank").collect()] == [1, 3, 0]


def test_label_equals_painting(spark):
    rng = random.Random(1)
    raster = [[1] * 60 for _ in range(40)]
    found = [((x := rng.randint(-5, 50)), (y := rng.randint(-5, 30)), x + rng.randint(3, 15), y + rng.randint(3, 12), rng.random(), "figure" if k % 5 == 0 else "plain text") for k in range(12)]
    found = [(x0, y0, max(x0 + 1, x1), max(y0 + 1, y1), 0.3 + c / 2, k) for x0, y0, x1, y1, c, k in found]
    ranked = sorted(found, key=lambda b: -b[4])
    clip = lambda v, n: min(max(int(v), 0), n - 1)
    for kept in (False, True):
        for i, (x0, y0, x1, y1, _, k) in enumerate(ranked):
            if (k == "figure") == kept:
                for y in range(clip(y0 - 1, 40), clip(y1 + 1, 40)):
                    for x in range(clip(x0 - 1, 60), clip(x1 + 1, 60)):
                        raster[y][x] = 0 if kept else i + 2
    b = spark.createDataFrame([("d", 0, i, float(x0), float(y0), float(x1), float(y1), c, k, 60, 40) for i, (x0, y0, x1, y1, c, k) in enumerate(found)], "doc string, page int, i int, x0 double, y0 double, x1 double, y1 double, conf double, cls string, width int, height int")
    points = [(i, rng.uniform(-3, 65), rng.uniform(-3, 45)) for i in range(300)]
    p = spark.createDataFrame([("d", 0, i, x, y) for i, x, y in points], "doc string, page int, i int, x double, y double")
    got = {r["i"]: r["region"] for r in regions.label(p, regions.confident(b)).collect()}
    assert got == {i: raster[clip(y, 40)][clip(x, 60)] for i, x, y in points}
    assert {0, 1} < set(got.values())
    twice = p.select("doc", "page", "x", "y").unionByName(p.select("doc", "page", "x", "y"))
    assert regions.label(twice, regions.confident(b)).count() == 600  # equal points stay apart
    alone = p.withColumn("page", F.lit(9))
    assert {r["region"] for r in regions.label(alone, regions.confident(b)).collect()} == {1}


def test_clusters_and_prose(spark):
    lines = boxes(spark, [(0, 0, 9, 10, 0), (0, 12, 9, 22, 1), (0, 40, 9, 50, 2), (0, 57, 9, 60, 3), (0, 90, 9, 99, 4)], ", line int")
    got = regions.cluster_boxes(regions.clusters(lines))
    assert sorted((r["lines"], r["y0"], r["y1"]) for r in got.collect()) == [(2, 0, 22), (2, 40, 60)]
    prose = boxes(spark, [(50, 20, 60, 30), (50, 60, 60, 70)])
    assert [r["y0"] for r in regions.without_prose(got, prose).collect()] == [40]


def test_heal(spark):
    lines = boxes(spark, [(161, 100, 484, 112), (161, 300, 250, 312)])
    r = [(195, 98, 442, 114, 1, "plain text"), (150, 98, 500, 114, 2, "plain text"), (195, 90, 442, 101, 3, "plain text"), (195, 98, 442, 114, 4, "figure"), (300, 296, 400, 316, 5, "plain text")]
    got = {x["region"]: (x["x0"], x["x1"], x["healed"]) for x in regions.heal(boxes(spark, r, ", region int, cls string"), lines).collect()}
    assert got == {1: (161, 484, True), 2: (150, 500, False), 3: (195, 442, False), 4: (195, 442, False), 5: (300, 400, False)}


def test_hidden_spans(spark):
    spans = boxes(spark, [(10, 10, 40, 20, 1), (10, 10, 40, 20, 3), (80, 10, 90, 20, 1)], ", seqno int")
    fills = boxes(spark, [(5, 5, 50, 25, 2, [1.0], None), (75, 5, 95, 25, 2, [1.0], 0.0), (75, 5, 95, 25, 2, None, 1.0)], ", seqno int, fill array<double>, opacity double")
    assert [(r["x0"], r["seqno"]) for r in regions.covered_spans(spans, fills).collect()] == [(10, 1)]
    assert [(r["x0"], r["seqno"]) for r in regions.covered_spans(spans, fills, None).collect()] == [(10, 1)]


def test_ghosts(spark):
    glyphs = boxes(spark, [(10, 10, 14, 20, "C", "F", 9.0), (10, 10, 15, 20, "P", "G", 9.0), (30, 10, 34, 20, "O", "F", 9.001)], ", text string, font string, size double")
    hidden = boxes(spark, [(9, 9, 41, 21, "F", 9.0)], ", font string, size double")
    covered, rest = regions.hidden_styles(glyphs, hidden)
    assert sorted(r["text"] for r in covered.collect()) == ["C", "O"] and [r["text"] for r in rest.collect()] == ["P"]
    gone, stay = regions.ghosts(covered, rest)
    assert [r["text"] for r in gone.collect()] == ["C"] and [r["text"] for r in stay.collect()] == ["O"]
    assert [r["text"] for r in regions.redrawn(rest, gone).collect()] == ["P"]


def test_monospaced_and_rotation(spark):
    lines = spark.createDataFrame([(["A+Courier", "CMTT"],), (["ABC+cmtt10", "Menlo-Bold"],), (["Times"],), ([],)], "fonts array<string>")
    assert [r["m"] for r in lines.select(regions.is_monospaced(F.col("fonts")).alias("m")).collect()] == [False, True, False, False]
    box = [F.lit(v) for v in (10.0, 20.0, 110.0, 220.0)]
    corner = {90: (110.0, 20.0), 180: (110.0, 220.0), 270: (10.0, 220.0), 0: (10.0, 20.0)}
    for degrees, (x, y) in corner.items():  # the corner that comes to the origin
        at = spark.range(1).select(G.transform_point(G.rotation(F.lit(degrees), *box), F.lit(x), F.lit(y)).alias("p")).first()["p"]
        assert tuple(at) == (0, 0)


def test_marks(spark):
    rows = [("Square", [3.0], 1.0, [0.0, 0.0, 0.0]), ("Square", [], 1.0, [0.0]), ("Circle", [3.0], 1.0, [0.0]), ("Square", [3.0], 1.0, [1.0, 0.0, 0.0]), ("Square", [3.0], 5.0, [0.0]), ("Square", [3.0], None, None)]
    a = spark.createDataFrame(rows, "type string, dashes array<double>, width double, stroke array<double>")
    assert regions.marks(a).count() == 1


def test_reanchor(spark):
    needles = boxes(spark, [(0, 0, 10, 10, 1, "Figure 3", 0), (0, 0, 10, 10, 1, "3", 1), (0, 0, 10, 10, 2, "gone", 0)], ", link int, needle string, needle_rank int")
    hits = boxes(spark, [(90, 0, 99, 10, "3"), (20, 0, 30, 10, "3"), (0, 0, 1, 1, "other")], ", needle string")
    assert [(r["link"], r["x0"]) for r in regions.reanchor(needles, hits).collect()] == [(1, 20)]


def test_pages(spark):
    spec = spark.createDataFrame([(0, "1,3-5"), (1, " 2 , 2"), (2, ""), (3, None)], "i int, s string")
    assert [r["p"] for r in spec.orderBy("i").select(regions.page_numbers(F.col("s")).alias("p")).collect()] == [[0, 2, 3, 4], [1, 1], None, None]
    with pytest.raises(SparkRuntimeException):
        spark.createDataFrame([("5-3",)], "s string").select(regions.page_numbers(F.col("s"))).collect()
    p = spark.range(6).select(F.col("id").alias("page"))
    assert regions.select_pages(p, []).count() == 6 and regions.select_pages(p, [1, 1, 9]).count() == 1
    assert [(r["page"], r["side"]) for r in regions.interleave(p.limit(2), p.limit(2)).orderBy("at").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_detectors(spark):
    pages = [("scan", i, 90.0, 100.0, 80) for i in range(5)] + [("scan", 9, 0.0, 100.0, 0), ("text", 0, 10.0, 100.0, 900), ("void", 0, 5.0, 0.0, 900)]
    s = detect.scanned(spark.createDataFrame(pages, "doc string, page int, image_area double, page_area double, page_chars int"))
    assert {r["doc"]: r["scanned"] for r in s.collect()} == {"scan": True, "text": False, "void": False}
    en, zh = "plain english words " * 5, "中文内容" * 20
    docs = spark.createDataFrame([("en", i, en) for i in range(4)] + [("dual", i, zh if i % 2 else en) for i in range(4)] + [("thin", 0, "中")], "doc string, page int, text string")
    assert {r["doc"]: r["hit"] for r in detect.already_translated(docs, "zh").collect()} == {"en": False, "dual": True, "thin": False}
    assert not any(r["hit"] for r in detect.already_translated(docs, "fr").collect())
    toc = spark.createDataFrame([("d", 0, f"Chapter {i} . . . . . {i}") for i in range(4)] + [("d", 1, "Chapter . . . . . 1"), ("d", 1, "words... go on")], "doc string, page int, text string")
    found = detect.contents_pages(toc)
    assert [(r["page"], r["lines"]) for r in found.collect()] == [(0, 4)]
    wanted = spark.createDataFrame([("d", 0), ("d", 1), ("e", 0)], "doc string, page int")
    assert {tuple(r) for r in detect.without_contents(wanted, found).collect()} == {("d", 1), ("e", 0)}
    assert {tuple(r) for r in detect.without_contents(wanted, found.unionByName(found.withColumns({"doc": F.lit("e")}))).collect()} == {("d", 1), ("e", 0)}


def glyphs(words, region=2, font="Times", size=10.0, y=700.0, x=50.0, container=0):
    out = []
    for c in words:
        out.append({"container": container, "kind": "glyph", "text": c, "x0": x, "y0": y, "x1": x + 5, "y1": y + size, "size": size, "font": font, "m0": 1.0, "m3": 1.0, "region": region, "color": None})
        x += 5.0
    return out


def rule(region, x=50.0, y=690.0, container=0, width=1.0):
    return {"container": container, "kind": "line", "text": "", "x0": x, "y0": y, "x1": x + 30, "y1": y, "size": width, "font": "", "m0": 1.0, "m3": 1.0, "region": region, "color": None}


ITEMS = pa.struct([(f, {"container": pa.int32(), "region": pa.int32(), "color": pa.list_(pa.float64())}.get(f, pa.string() if f in ("kind", "text", "font") else pa.float64())) for f in segment.FIELDS])


def read_all(items, hidden=None, **options):
    columns = segment.Columns.of(pa.array(items, ITEMS), **options)
    return dict(segment.containers(columns, 600.0, [dict(zip(("x0", "y0", "x1", "y1", "n"), b, strict=True)) for b in hidden or []]))


def read(items, **options):
    (one,) = read_all(items, **options).values()
    return one


def said(container):
    return ["".join(p.parts) for p in container.paras]


def test_segment_paragraphs():
    r = read(glyphs("one") + glyphs("two", x=80) + glyphs("next", y=680) + glyphs("other", region=3, y=600))
    assert said(r) == ["one two next", "other"] and [p.brk for p in r.paras] == [True, False]
    assert (r.paras[0].box[0], r.paras[0].box[2]) == (50, 95)
    assert read_all([]) == {} and said(read([rule(2)])) == [] and len(read([rule(2)]).rules) == 1


def test_segment_sizes():
    """An initial doesn't set the size of its paragraph; a larger letter does, and the tops align."""
    initial = read(glyphs("T", size=30.0, y=680.0) + glyphs("he rest", size=10.0, x=55.0))
    assert said(initial) == ["The rest"] and (initial.paras[0].size, initial.paras[0].y) == (10, 700)
    grows = read(glyphs("ab", size=10.0) + glyphs("cd", size=12.0, x=60.0))
    assert (grows.paras[0].size, grows.paras[0].y) == (12, 698)
    spaced = read(glyphs(" a", size=30.0) + glyphs(" b", size=20.0, x=60.0))
    assert said(spaced) == [" a b"] and spaced.paras[0].size == 20


def test_segment_formulas():
    r = read(glyphs("let ") + glyphs("x", font="ABC+CMMI10", x=70) + glyphs("(", x=75) + glyphs("y", font="CMMI10", x=80) + glyphs(")", x=85) + glyphs("be", x=92))
    assert said(r) == ["let {v0} be"]
    assert r.formula_rows(0)[0]["text"] == "x(y)"
    small = read(glyphs("ab") + glyphs("2", size=7.0, x=60))
    assert said(small) == ["ab{v0}"]
    assert said(read(glyphs("α", x=50))) == ["{v0}"]
    assert said(read(glyphs("•") + glyphs("item", x=60))) == ["{v0}", "item"]
    assert said(read(glyphs("ab", region=0))) == ["{v0}"]
    assert said(read(glyphs("(a)"))) == ["(a)"]
    # a bracket that a formula opened is closed by the next one, however far
    assert said(read(glyphs("a=(b) c)"))) == ["a{v0}b{v1} c)"]


def test_formulas_end_at_jumps_in_text_only():
    far = lambda: glyphs("x", font="CMMI10", x=60) + glyphs("y", font="CMMI10", x=400)
    assert said(read(glyphs("ab") + far())) == ["ab{v0} {v1}"]
    assert said(read(far())) == ["{v0}"]


def test_formula_shift_width_and_lines():
    r = read(glyphs("ab", y=700) + glyphs("xˆ", font="CMMI10", x=60, y=703) + [rule(2)] + glyphs("c", x=75, y=701) + [rule(2), rule(7, width=9.0)])
    (f,) = r.formula_rows(0)
    assert (f["width"], f["shift"], f["modifier"], len(f["lines"]), len(r.rules)) == (10, 2, 5, 1, 2)
    (alone,) = read(glyphs("ab", y=700) + glyphs("x", font="CMMI10", x=60, y=703)).formula_rows(0)
    assert alone["shift"] == 3


def test_containers_in_the_order_of_their_first_item():
    mixed = glyphs("AA", container=9) + glyphs("bb", container=2, x=300) + glyphs("cc", container=9, x=60)
    assert [(k, said(v)) for k, v in read_all(mixed).items()] == [(9, ["AAcc"]), (2, ["bb"])]
    # they share the boxes: the first one takes what it can
    box = [[0.0, 0.0, 600.0, 800.0, 3]]
    assert [(k, said(v)) for k, v in read_all(mixed, hidden=box).items()] == [(9, ["c"]), (2, ["bb"])]


def test_segment_hidden_budget():
    both = glyphs("COND") + glyphs("PRED")
    r = read(both, hidden=[[0.0, 0.0, 600.0, 800.0, 4]])
    assert [t.replace(" ", "") for t in said(r)] == ["PRED"]
    twice = read(both, hidden=[[0.0, 0.0, 600.0, 800.0, 2], [0.0, 0.0, 600.0, 800.0, 1]])
    assert "".join(said(twice)).replace(" ", "") == "DPRED"


def test_formula_rules():
    yes = [("CMMI10", "x"), ("A+CMSY10", "x"), ("Times-Ital", "x"), ("Times", "(cid:3)"), ("Times", "∑"), ("Times", "ˆ"), ("Times", "λ"), ("Times", "́")]
    no = [("CMR10", "x"), ("Times", " "), ("Times", "a"), ("Times", "é")]
    assert all(segment.is_formula_glyph(*g) for g in yes) and not any(segment.is_formula_glyph(*g) for g in no)
    assert segment.is_formula_glyph("Times", "a", vchar="a") and not segment.is_formula_glyph("CMMI10", "x", vfont="Other")


ROWS = "doc string, page int, container int, seq long, kind string, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, m0 double, m3 double, region int, page_width double"


def frame(spark, pages):
    rows = [("d", page, g["container"], i, *(g[c] for c in ("kind", "text", "x0", "y0", "x1", "y1", "size", "font", "m0", "m3", "region")), 600.0) for page, items in pages.items() for i, g in enumerate(items)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def test_segment_on_spark(spark):
    df = frame(spark, {0: glyphs("one") + glyphs("2", font="CMMI10", x=66.0)})
    assert [r["text"] for r in segment.segment(df).collect()] == ["one{v0}"]
    assert [(r["text"], r["width"]) for r in segment.formulas(df).collect()] == [("2", 5)]
    hidden = spark.createDataFrame([("d", 0, 0, 0.0, 0.0, 600.0, 800.0, 2.0)], "doc string, page int, i int, x0 double, y0 double, x1 double, y1 double, n double")
    assert [r["text"] for r in segment.segment(df, hidden=hidden).collect()] == ["e{v0}"]


METRICS = typeset.Metrics({("tiro", c): 0.5 for c in "abcdefgh "})
PARA = {"x": 10.0, "x0": 10.0, "x1": 40.0, "y": 100.0, "y0": 70.0, "y1": 110.0, "size": 10.0, "brk": True}


def runs(text, para=PARA, formulas=None):
    return typeset.set_paragraph(para, text, METRICS, formulas or {})


def formula(width=20.0, shift=2.0, modifier=0.0, lines=()):
    return {"width": width, "shift": shift, "modifier": modifier, "glyphs": [{"text": "x", "font": "CM", "size": 9.0, "x": 300.0, "y": 50.0, "color": [1.0, 0.0, 0.0]}, {"text": "2", "font": "CM", "size": 6.0, "x": 306.0, "y": 53.0, "color": None}], "lines": list(lines)}


def test_lines():
    got, lines = runs("abcdef gh")
    assert lines == 2 and [(p["text"], p["line"], p["x"]) for p in got] == [("abcdef", 0, 10), ("gh", 1, 10)]
    one, lines = runs("abcdef gh", PARA | {"brk": False})
    assert lines == 1 and "".join(p["text"] for p in one) == "abcdef gh"
    mixed, _ = runs("ab{v0}字{v9}c", PARA | {"x1": 400.0}, {0: formula()})
    assert [(p["font"], p["text"], p["x"], p["up"]) for p in mixed] == [("tiro", "ab", 10, 0), ("CM", "x", 20, 2), ("CM", "2", 26, 5), ("noto", "字", 40, 0), ("tiro", "c", 45, 0)]
    first, _ = runs("{ V 0 }ab", PARA | {"x1": 400.0}, {0: formula(modifier=4.0)})
    assert [(p["text"], p["x"], p["up"]) for p in first] == [("x", 10, 0), ("2", 16, 3), ("ab", 26, 0)]
    assert runs("")[0] == [] and runs("{v3}")[0] == []
    assert typeset.line_height("zh-CN") == 1.4 and typeset.line_height("xx") == 1.1
    assert abs(typeset.fitted_height(4, 10, 45, 1.4) - 1.1) < 0.06 and typeset.fitted_height(1, 10, 45, 1.4) == 1.4


def test_places_cell_by_cell():
    """Lines found in the sums of advances are those of walking over the cells one by one."""
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", "字", "{v0}", "  "]) for _ in range(rng.randrange(600 if rng.random() < 0.1 else 40)))
        para = PARA | {"brk": rng.random() < 0.7, "x": rng.choice([10.0, 10.0, 14.0]), "x1": rng.choice([12.0, 30.0, 70.0])}
        cells = typeset.Cells.of(text, 10.0, METRICS, {0: formula(rng.choice([4.0, 33.0]), modifier=rng.choice([0.0, 3.0]))})
        x, line, _, out = typeset.place(cells, para)
        at, row = para["x"], 0
        for i, code in enumerate(cells.code.tolist()):
            if para["brk"] and at + cells.advance[i] > para["x1"] + 1.0:
                at, row = para["x0"], row + 1
            skipped = at == para["x0"] and code == 32
            assert (round(x[i], 6), line[i], out[i]) == (round(at, 6), row, skipped), (text, i, para)
            at += 0 if skipped else cells.step[i]


def test_typeset(spark):
    """Formulas are told apart by page, colours stated where they change, thick lines left out, loose lines drawn last."""
    red = [g | {"color": [1.0, 0.0, 0.0]} for g in glyphs("x", font="CMMI10", x=60.0)]
    pages = {0: [*glyphs("ab"), *red, rule(2), *glyphs("a", x=65.0), rule(5, width=2.0), rule(5, width=6.0)], 1: [*glyphs("ab"), *glyphs("y", font="CMMI10", x=60.0)]}
    df = frame(spark, pages).withColumn("color", F.when(F.col("text") == "x", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    found = segment.read(segment.by_page(df))
    paras = found.select("doc", "page", F.inline("paras"))
    told = paras.select("doc", "page", "container", "para", F.upper("text").alias("translation"))
    widths = {("tiro", chr(c)): 0.5 for c in range(32, 127)}
    ops = typeset.typeset(typeset.translated(found, told), widths)
    got = {r["page"]: [(o["kind"], o["text"], o["color"]) for o in r["ops"]] for r in ops.collect()}
    assert got == {0: [("text", "AB", "0 g "), ("text", "x", "1.000000 0.000000 0.000000 rg "), ("line", None, None), ("text", "A", "0 g "), ("line", None, None)], 1: [("text", "AB", "0 g "), ("text", "y", None)]}
    streams = {r["page"]: r["stream"] for r in typeset.drawn(ops).collect()}
    assert streams[1] == "BT 0 g /tiro 10.000000 Tf 1 0 0 1 50.000000 700.000000 Tm [<4142>] TJ /CMMI10 10.000000 Tf 1 0 0 1 60.000000 700.000000 Tm [<79>] TJ ET "
    assert "ET q 1 0 0 1 50.000000 690.000000 cm [] 0 d 0 J 2.000000 w 0 0 m 30.000000 0.000000 l S Q BT ET " in streams[0]
    same = typeset.typeset(typeset.translated(found, told.where("page = 1")), widths).where("page = 0").first()["ops"]
    assert [o["text"] for o in same if o["kind"] == "text"] == ["ab", "x", "a"]  # without a translation the text stays
