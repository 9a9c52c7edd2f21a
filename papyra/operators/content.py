"""What a page's content stream leaves to the layout and what it keeps: strokes, operators, spans, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import LINK_TOKEN, strip

#: Operators that go with their arguments, and those without arguments that go (fixed values).
DROPPED, DROPPED_BARE = ['"', "'", "EI", "MP", "DP", "BMC", "BDC"], ["BI", "ID", "EMC"]
THICK = 5.0
PAGE = ["doc", "page"]


def is_layout_stroke(kind: Column, points: Column, colour: Column) -> Column:
    """A stroked path of two points, level and black. ``points`` are structs (x, y), already transformed."""
    black = F.aggregate(F.coalesce(colour, F.array(F.lit(0.0))), F.lit(0.0), lambda a, c: a + c) == 0
    return (kind == "S") & (F.size(points) == 2) & (F.get(points, 0)["y"] == F.get(points, 1)["y"]) & black


def layout_strokes(paths: DataFrame) -> DataFrame:
    """Lines (px0, py0, px1, py1, linewidth) of the paths that enter the layout; all other paths stay graphics."""
    taken = paths.where(is_layout_stroke(F.col("kind"), F.col("points"), F.col("colour")))
    a, b = F.get("points", 0), F.get("points", 1)
    return taken.select(*PAGE, "seq", a["x"].alias("px0"), a["y"].alias("py0"), b["x"].alias("px1"), b["y"].alias("py1"), "linewidth")


def drawn_lines(lines: DataFrame) -> DataFrame:
    """Lines worth drawing again; thick ones are backgrounds."""
    return lines.where(F.col("linewidth") < THICK)


def argument(value: Column, is_real: Column) -> Column:
    """An operand as text: six decimals for a real number, anything else without quotes."""
    return F.when(is_real, F.format_string("%f", value.cast("double"))).otherwise(F.replace(value, F.lit("'"), F.lit("")))


def residual(operators: DataFrame) -> DataFrame:
    """doc, page, ops: the stream without text and marked content, in order.

    ``operators``: seq, name, args (structs of text and real). A stroke taken into the layout is
    written as ``n``, so that it is not drawn twice. A page's operators are gathered by page.
    """
    bare = F.size("args") == 0
    keep = ~F.startswith("name", F.lit("T")) & ~F.when(bare, F.col("name").isin(DROPPED_BARE)).otherwise(F.col("name").isin(DROPPED))
    said = F.array_join(F.transform("args", lambda a: argument(a["text"], a["real"])), " ")
    kept = operators.where(keep).select(*PAGE, "seq", F.concat(said, F.lit(" "), F.col("name"), F.lit(" ")).alias("op"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "op")))
    return kept.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda s: s["op"]), "").alias("ops"))


def visible(spans: DataFrame) -> DataFrame:
    """Spans that are drawn and hold a character."""
    return spans.where((F.coalesce("type", F.lit(0)) != 3) & (F.col("n_chars") > 0))


def needles(links: DataFrame) -> DataFrame:
    """What to look for of a link's anchor text: all of it, then the numbers and names in it; by rank."""
    anchor = strip(F.coalesce("anchor", F.lit("")))
    every = F.concat(F.array(anchor), F.regexp_extract_all(anchor, F.lit(LINK_TOKEN), 0))
    return links.where(anchor != "").select(*[c for c in links.columns if c != "anchor"], F.posexplode(every).alias("needle_rank", "needle"))


def destinations(links: DataFrame, pages: DataFrame, dual: bool) -> DataFrame:
    """Links that still lead somewhere: internal ones to the translated page, web addresses as they are."""
    n = pages.groupBy("doc").agg(F.count("*").alias("n_pages"))
    known = links.join(n, "doc")
    inside = F.col("kind").isin("goto", "named")
    real = (F.col("dest_page") >= 0) & (F.col("dest_page") < F.col("n_pages"))
    target = F.when(inside, F.col("dest_page") * 2 + 1 if dual else F.col("dest_page"))
    return known.where(F.when(inside, real).otherwise(F.col("kind") == "uri")).withColumn("target", target).drop("n_pages")


def merged_regions(found: DataFrame, marked: DataFrame) -> DataFrame:
    """Detected and hand-marked rectangles together, none dropped."""
    return found.unionByName(marked)


def region_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("doc").agg(F.count("*").alias("regions"), F.countDistinct("page").alias("pages"))


def looked_up(table: dict[str, object], key: Column, default: object) -> Column:
    """A dictionary as an expression, with what unknown keys get."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
