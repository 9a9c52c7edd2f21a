"""The life of a translation as one plan: glyphs, paragraphs, memory, misses, translations, layout.

Nothing is computed twice for the pass that only collects paragraphs: ``paragraphs`` is an ordinary
table with two readers. Texts are distinct before they reach a service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import is_trivial, skips_translation
from papyra.operators import cache, regions, segment
from papyra.sources.adapters import translate_texts


def paragraphs_of(glyphs: DataFrame, boxes: DataFrame, **options) -> DataFrame:
    """Segmented paragraphs of glyphs under detected regions."""
    points = glyphs.withColumns({"x": F.col("x0"), "y": F.col("y0")})
    labelled = regions.label(points, regions.confident(boxes)).drop("x", "y")
    return segment.segment(labelled, **options)


def translate_paragraphs(paras: DataFrame, memory: DataFrame, make: Callable[[], object], engine: str, params: str) -> DataFrame:
    """``paras`` with ``translation``: themselves if there is nothing to translate, else remembered or new."""
    own = paras.withColumn("original", F.col("text"))
    todo = own.where(~is_trivial(F.col("text")) & ~skips_translation(F.col("text")))
    units = todo.select("original").distinct().withColumns({"engine": F.lit(engine), "params": F.lit(params)})
    known = cache.lookup(units, memory, ["engine", "params", "original"])
    fresh = translate_texts(known.where(F.col("translation").isNull()).select("original"), make, column="original")
    every = known.where(F.col("translation").isNotNull()).select("original", "translation").unionByName(fresh)
    return own.join(every, "original", "left").withColumn("translation", F.coalesce("translation", "text")).drop("original")
