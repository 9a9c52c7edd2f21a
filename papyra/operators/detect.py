"""Detectors of scans, of documents already translated, and of contents pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions.text import LEADER, SCRIPTS, latin_count, script_count

SAMPLE_PAGES, COVERAGE, SCAN_CHARS = 5, 0.8, 50
PAGE_SHARE, DOC_SHARE, PAGE_CHARS = 0.5, 0.25, 50
LEADER_LINES = 4


def scanned(pages: DataFrame, *, key: str = "doc", page: str = "page", images: str = "image_area", area: str = "page_area", chars: str = "page_chars") -> DataFrame:
    """key, coverage, chars, scanned, from the first pages of each document; a page without area covers nothing but counts."""
    first = pages.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(page))).where(F.col("_n") <= SAMPLE_PAGES)
    share = F.when(F.col(area) > 0, F.col(images) / F.col(area)).otherwise(F.lit(0.0))
    mean = first.groupBy(key).agg((F.sum(share) / F.count("*")).alias("coverage"), F.floor(F.sum(chars) / F.count("*")).alias("chars"))
    return mean.withColumn("scanned", (F.col("coverage") >= COVERAGE) & (F.col("chars") > SCAN_CHARS))


def already_translated(pages: DataFrame, language: str, *, key: str = "doc", text: str = "text") -> DataFrame:
    """key, ratio, hit: share of judged pages mostly in the language's script. Other languages never hit."""
    if language not in SCRIPTS:
        return pages.select(key).distinct().select(key, F.lit(0.0).alias("ratio"), F.lit(False).alias("hit"))
    target, latin = script_count(F.col(text), language), latin_count(F.col(text))
    judged = pages.select(key, target.alias("t"), (target + latin).alias("n"))
    hits = F.sum(F.when((F.col("n") >= PAGE_CHARS) & (F.col("t") >= PAGE_SHARE * F.col("n")), 1).otherwise(0))
    of = F.sum(F.when(F.col("n") >= PAGE_CHARS, 1).otherwise(0))
    ratio = F.when(of > 0, hits / of).otherwise(F.lit(0.0))
    return judged.groupBy(key).agg(ratio.alias("ratio")).withColumn("hit", F.col("ratio") >= DOC_SHARE)


def is_leader(line: Column) -> Column:
    return F.rlike(line, F.lit(LEADER))


def contents_pages(lines: DataFrame, *, key: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """key, page, lines of pages with four or more lines of dot leaders."""
    return lines.groupBy(key, page).agg(F.sum(is_leader(F.col(text)).cast("int")).cast("long").alias("lines")).where(F.col("lines") >= LEADER_LINES)


def without_contents(wanted: DataFrame, contents: DataFrame, *, key: str = "doc", page: str = "page") -> DataFrame:
    """Wanted pages without contents pages; a document that would keep none keeps all."""
    marked = wanted.join(contents.select(key, page).distinct().withColumn("toc", F.lit(True)), [key, page], "left").withColumn("toc", F.coalesce("toc", F.lit(False)))
    other = F.max((~F.col("toc")).cast("int")).over(W.partitionBy(key)) == 1
    return marked.withColumn("some", other).where(~F.col("toc") | ~F.col("some")).drop("toc", "some")
