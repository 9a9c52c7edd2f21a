"""Layout regions, lines, fills and links of pages.

Rectangles of a page only ever meet rectangles of the same page, so every join here is an equi-join on
(document, page) with the geometry as its condition: it is shuffled by page and never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions.text import font_base

#: Layout classes that are kept as they are; fonts of verbatim text (fixed values).
PRESERVED = ["abandon", "figure", "table", "isolate_formula", "formula_caption"]
MONOSPACED = ["txtt", "cmtt", "Courier", "Mono", "Consol", "Inconsolata", "Menlo", "SFMono", "Typewriter"]
LEAST_CONFIDENCE, LINE_GAP, LINE_COVER, MARGIN, COVERED, OPAQUE, GHOST = 0.25, 8.0, 0.5, 2.0, 0.9, 0.9, 0.4
BLACK, MARK_WIDTH = 0.25, 2.0
PAGE = ["doc", "page"]


def confident(boxes: DataFrame) -> DataFrame:
    """Detections worth keeping, ranked by confidence; equal ones keep their order."""
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("conf"), "i")) - 1
    return boxes.where(F.col("conf") > LEAST_CONFIDENCE).withColumn("rank", rank)


def label(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (x, y) with the region they lie in: 0 kept as it is, rank + 2 a text region, 1 none.

    Boxes are widened by a pixel, cut to the page and half-open; of text boxes the least confident
    wins, and preserved boxes beat all. Points outside the page count as on its edge.
    """
    span = lambda low, high, size: (G.clamp(F.col(low).cast("int") - 1, F.lit(0), F.col(size) - 1), G.clamp(F.col(high).cast("int") + 1, F.lit(0), F.col(size) - 1))
    (x0, x1), (y0, y1) = span("x0", "x1", "width"), span("y0", "y1", "height")
    box = F.struct(F.col("cls").isin(PRESERVED).alias("kept"), "rank", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    # a page has few boxes: they come to its points as one array, so points are never grouped and equal ones stay apart
    pages = boxes.groupBy(*PAGE).agg(F.max("width").alias("_w"), F.max("height").alias("_h"), F.collect_list(box).alias("_boxes"))
    px, py = G.clamp(F.col("x").cast("int"), F.lit(0), F.col("_w") - 1), G.clamp(F.col("y").cast("int"), F.lit(0), F.col("_h") - 1)
    inside = F.filter("_boxes", lambda b: (b["x0"] <= px) & (px < b["x1"]) & (b["y0"] <= py) & (py < b["y1"]))
    best = F.array_max(F.transform(inside, lambda b: F.struct(b["kept"].alias("kept"), b["rank"].alias("rank"))))
    joined = points.join(pages, PAGE, "left").withColumn("_best", best)
    region = F.when(F.col("_best").isNull(), 1).when(F.col("_best.kept"), 0).otherwise(F.col("_best.rank") + 2)
    return joined.select(*[points[c] for c in points.columns], region.cast("int").alias("region"))


def clusters(lines: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """Lines with the number of their cluster down the page: a new one where the gap to the last line is ``gap`` or more."""
    line = W.partitionBy(*PAGE).orderBy("y0", "line")
    new = F.coalesce((F.col("y0") - F.lag("y1").over(line) >= gap).cast("int"), F.lit(0))
    return lines.withColumn("new", new).withColumn("cluster", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def cluster_boxes(clustered: DataFrame, least: int = 2) -> DataFrame:
    box = clustered.groupBy(*PAGE, "cluster").agg(F.count("*").alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return box.where(F.col("lines") >= least)


def is_monospaced(fonts: Column) -> Column:
    """All spans of the line are set in a typewriter face; a line without spans is neither."""
    return (F.size(fonts) > 0) & F.forall(fonts, lambda f: F.rlike(font_base(f), F.lit("|".join(MONOSPACED))))


def without_prose(boxes: DataFrame, prose: DataFrame) -> DataFrame:
    """Boxes that share no band of the page with a line of prose."""
    p = prose.select(*PAGE, F.col("y0").alias("p0"), F.col("y1").alias("p1"))
    on = (boxes["doc"] == p["doc"]) & (boxes["page"] == p["page"]) & (boxes["y0"] < p["p1"]) & (p["p0"] < boxes["y1"])
    return boxes.join(p, on, "left_anti")


def heal(regions: DataFrame, lines: DataFrame, key: str = "region") -> DataFrame:
    """Text regions widened so that they hold the lines they sit on; ``healed`` tells which changed."""
    a = lines.where((F.col("x1") - F.col("x0") > 20) & (F.col("y1") > F.col("y0"))).select(*PAGE, F.col("x0").alias("l0"), F.col("y0").alias("t0"), F.col("x1").alias("l1"), F.col("y1").alias("t1"))
    on_line = F.least("y1", "t1") - F.greatest("y0", "t0") > LINE_COVER * (F.col("t1") - F.col("t0"))
    beside = (F.col("x1") > F.col("l0")) & (F.col("x0") < F.col("l1"))
    holds = (F.col("x0") <= F.col("l0") + MARGIN) & (F.col("x1") >= F.col("l1") - MARGIN)
    cuts = regions.where(~F.col("cls").isin(PRESERVED)).join(a, PAGE).where(on_line & beside & ~holds)
    wide = cuts.groupBy(*PAGE, key).agg(F.min("l0").alias("w0"), F.max("l1").alias("w1"))
    out = regions.join(wide, [*PAGE, key], "left")
    changed = F.coalesce((F.col("w0") < F.col("x0")) | (F.col("w1") > F.col("x1")), F.lit(False))
    return out.select(*[c for c in regions.columns if c not in ("x0", "x1")], F.least("x0", "w0").alias("x0"), F.greatest("x1", "w1").alias("x1"), changed.alias("healed"))


def _rects(df: DataFrame, prefix: str, *also: str) -> DataFrame:
    return df.select(*PAGE, G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in also])


def covered_spans(spans: DataFrame, fills: DataFrame, share: float | None = COVERED) -> DataFrame:
    """Spans that a later opaque fill covers: over ``share`` of their area, or wholly where ``share`` is None."""
    opaque = F.coalesce("opacity", F.lit(1.0))
    f = _rects(fills.where(F.col("fill").isNotNull() & ((opaque == 1.0) if share is None else (opaque >= OPAQUE))), "f", "seqno")
    own = G.rect(spans["x0"], spans["y0"], spans["x1"], spans["y1"])
    over = G.contains(f["f"], own) if share is None else G.covered_share(own, f["f"]) > share
    return spans.join(f, (spans["doc"] == f["doc"]) & (spans["page"] == f["page"]) & (f["f_seqno"] > spans["seqno"]) & (G.area(own) > 0) & over, "left_semi")


def hidden_styles(glyphs: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Glyphs in a hidden region of their own font and size, and all others."""
    h = _rects(hidden, "h", "font", "size")
    own = G.rect(glyphs["x0"], glyphs["y0"], glyphs["x1"], glyphs["y1"])
    on = (glyphs["doc"] == h["doc"]) & (glyphs["page"] == h["page"]) & (glyphs["font"] == h["h_font"]) & (F.bround(glyphs["size"], 2) == F.bround(h["h_size"], 2)) & G.contains(h["h"], own)
    return glyphs.join(h, on, "left_semi"), glyphs.join(h, on, "left_anti")


def ghosts(covered: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered glyphs whose place another glyph still takes, and those that stay since nothing else is there."""
    s = _rects(survivors, "s")
    own = G.rect(covered["x0"], covered["y0"], covered["x1"], covered["y1"])
    on = (covered["doc"] == s["doc"]) & (covered["page"] == s["page"]) & (G.area(G.intersection(own, s["s"])) > GHOST * G.area(own))
    return covered.join(s, on, "left_semi"), covered.join(s, on, "left_anti")


def redrawn(kept: DataFrame, gone: DataFrame, pad: float = 0.5) -> DataFrame:
    """Kept glyphs that erasing the ghosts' padded areas would hit."""
    g = _rects(gone, "g")
    own = G.rect(kept["x0"], kept["y0"], kept["x1"], kept["y1"])
    return kept.join(g, (kept["doc"] == g["doc"]) & (kept["page"] == g["page"]) & G.intersects(own, G.pad(g["g"], pad)), "left_semi")


def marks(annotations: DataFrame) -> DataFrame:
    """Hand-drawn marks: black, dashed, thin squares."""
    stroke = F.coalesce("stroke", F.array().cast("array<double>"))
    return annotations.where((F.col("type") == "Square") & (F.size(F.coalesce("dashes", F.array().cast("array<double>"))) > 0) & (F.coalesce("width", F.lit(0.0)) <= MARK_WIDTH) & (F.size(stroke) > 0) & F.forall(stroke, lambda c: c <= BLACK))


def reanchor(needles: DataFrame, hits: DataFrame) -> DataFrame:
    """A link's new rectangle: of its first needle that is found at all, the hit nearest to where the link was."""
    n = needles.select(*PAGE, "link", "needle", "needle_rank", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("n"))
    h = hits.select(*PAGE, "needle", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("h"))
    both = n.join(h, [*PAGE, "needle"])
    best = F.min_by(F.struct("needle_rank", "h"), F.struct("needle_rank", G.centre_distance(F.col("n"), F.col("h")), F.col("h")))
    return both.groupBy(*PAGE, "link").agg(best.alias("b")).select(*PAGE, "link", F.col("b.needle_rank").alias("needle_rank"), "b.h.*")


def remap(page: Column, dual: bool) -> Column:
    """Where a source page stands in the output: at the odd places of a dual one."""
    return page * 2 + 1 if dual else page


def interleave(original: DataFrame, translated: DataFrame, page: str = "page") -> DataFrame:
    """Pages of the dual document: each original one before its translation."""
    a = original.withColumns({"side": F.lit(0), "at": F.col(page) * 2})
    b = translated.withColumns({"side": F.lit(1), "at": F.col(page) * 2 + 1})
    return a.unionByName(b)


def page_numbers(spec: Column) -> Column:
    """"1,3-5" as pages from 0, in its order; null or blank for all pages, an error for a range that runs backwards."""
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: p != "")
    ends = lambda p: F.split(p, "-")
    one = lambda p: F.get(ends(p), 0).cast("int")
    last = lambda p: F.coalesce(F.get(ends(p), 1), F.get(ends(p), 0)).cast("int")
    checked = F.transform(parts, lambda p: F.when(last(p) < one(p), F.raise_error(F.concat(F.lit("page range runs backwards: "), p)).cast("array<int>")).otherwise(F.sequence(one(p) - 1, F.greatest(last(p), one(p)) - 1)))
    return F.when(F.size(parts) > 0, F.flatten(checked))


def select_pages(pages: DataFrame, wanted: list[int] | None, page: str = "page") -> DataFrame:
    """Only the wanted pages; none wanted means all."""
    return pages.where(F.col(page).isin(sorted(set(wanted)))) if wanted else pages


def by_ordinal(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the pages that a document's list names, under each page's place in it: a model sees places, blocks know pages."""
    places = wanted.select("doc", F.posexplode("pages").alias("ordinal", "page"))
    return places.join(blocks, ["doc", "page"])
