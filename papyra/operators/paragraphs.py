"""Paragraphs of documents: keys, first occurrences, openings, samples, chunks.

A document's paragraphs travel in one array, so these operators are projections: nothing is exploded
or shuffled unless the caller wants rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.binding import let
from papyra.functions.text import is_trivial

CHUNK_CHARS, CLIP, OPENING_CAP, OPENING_FLOOR, MIN_KEY_CHARS, SAMPLE_CHARS = 1000, 600, 6000, 150, 200, 6000


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``paras``: the lines of the text that are not empty, in order. Null text has none."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: p != "")
    return docs.select(F.col(key), lines.alias("paras"))


def rows(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a paragraph: key, i (from 0), text."""
    return paras.select(key, F.posexplode("paras").alias("i", "text"))


def widen_key(paras: Column, i: Column, least: int = MIN_KEY_CHARS) -> Column:
    """Paragraph i joined with those after it until they have ``least`` characters together."""
    # a paragraph is not empty, so ``least`` of them are always enough
    ahead = F.slice(paras, i + 1, least)
    seed = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("first"))

    def grow(s: Column, p: Column) -> Column:
        more = s["first"] | (s["n"] < least)
        text = F.when(s["first"], p).when(more, F.concat(s["text"], F.lit("\n"), p)).otherwise(s["text"])
        return F.struct(text.alias("text"), F.when(more, s["n"] + F.length(p)).otherwise(s["n"]).alias("n"), F.lit(False).alias("first"))

    return F.aggregate(ahead, seed, grow, lambda s: s["text"])


def first_places(paras: Column) -> Column:
    """Structs (i, text) of each distinct paragraph's first occurrence, in order; by sorting, not by looking each one up."""

    def of(line: Column) -> Column:
        first = F.filter(line, lambda x, k: (k == 0) | (F.get(line, k - 1)["text"] != x["text"]))
        return F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"))))

    return let(F.array_sort(F.transform(paras, lambda p, i: F.struct(p.alias("text"), i.cast("int").alias("i")))), of)


def keys(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, text, cache_key of each distinct paragraph; the first occurrence names the key."""
    first = paras.select(key, "paras", F.explode(first_places(F.col("paras"))).alias("p"))
    own = F.when(F.length("p.text") >= MIN_KEY_CHARS, F.col("p.text")).otherwise(widen_key(F.col("paras"), F.col("p.i")))
    return first.select(key, F.col("p.i").alias("i"), F.col("p.text").alias("text"), own.alias("cache_key"))


def cacheable(text: Column, mapped: Column) -> Column:
    """Key to cache under: a long text itself, a short one only if the document's keys have it."""
    return F.when(F.length(text) >= MIN_KEY_CHARS, text).otherwise(mapped)


def greedy_chunks(items: Column, limit: int = CHUNK_CHARS, size=F.length) -> Column:
    """Chunk number of each item: consecutive items of ``limit`` together at most, none split, an oversize one alone.

    Only the sizes go to Python, in Arrow batches: an array that grows item by item in the JVM is copied for each.
    """

    @F.pandas_udf("array<int>")
    def number(sizes: pd.Series) -> pd.Series:
        def one(sizes: np.ndarray | None) -> list[int] | None:
            if sizes is None:
                return None
            out, used, chunk = [], 0, 0
            for n in sizes.tolist():
                if out and used + n > limit:
                    used, chunk = 0, chunk + 1
                used += n
                out.append(chunk)
            return out

        return sizes.map(one)

    return number(F.transform(items, lambda x: F.coalesce(size(x), F.lit(0)).cast("long")))


def chunk_totals(items: Column, limit: int = CHUNK_CHARS) -> Column:
    """Struct (chunks, chars, largest) of the same grouping, without building it."""
    seed = F.struct(F.lit(0).alias("chunks"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("largest"))

    def add(s: Column, item: Column) -> Column:
        n = F.length(item).cast("long")
        new = (s["chunks"] == 0) | (s["used"] + n > limit)
        used = F.when(new, n).otherwise(s["used"] + n)
        return F.struct(F.when(new, s["chunks"] + 1).otherwise(s["chunks"]).alias("chunks"), used.alias("used"), (s["chars"] + n).alias("chars"), F.greatest(s["largest"], used).alias("largest"))

    return F.aggregate(items, seed, add)


def split_lines(text: Column, limit: int = 5000) -> Column:
    """Request parts of ``limit`` characters at most, cut at line ends; a longer line stays whole.

    Each line keeps its line feed, and the parts together are the text.
    """
    lines = F.filter(F.transform(F.split(text, "(?<=\n)"), lambda x: x), lambda x: x != "")
    seed = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(s: Column, line: Column) -> Column:
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(line) > limit)
        return F.struct(F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"), F.when(full, line).otherwise(F.concat(s["now"], line)).alias("now"))

    return F.aggregate(lines, seed, add, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))


def total_length(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, p: n + F.length(p))


def opening(paras: Column) -> Column:
    """Struct (parts, budget): the first paragraphs of a fifth of the text, bounded; the one that crosses is kept."""

    def of(usable: Column) -> Column:
        total = total_length(usable)
        budget = F.least(F.lit(OPENING_CAP), total, F.greatest(F.lit(OPENING_FLOOR), F.floor(total / 5))).cast("long")
        seed = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("used"), budget.alias("budget"))

        def add(s: Column, p: Column) -> Column:
            part = F.substring(p, 1, CLIP)
            more = (F.size(s["parts"]) == 0) | (s["used"] < s["budget"])
            return F.struct(F.when(more, F.concat(s["parts"], F.array(part))).otherwise(s["parts"]).alias("parts"), F.when(more, s["used"] + F.length(part)).otherwise(s["used"]).alias("used"), s["budget"].alias("budget"))

        return F.aggregate(usable, seed, add, lambda s: F.struct(s["parts"].alias("parts"), s["budget"].alias("budget")))

    return let(F.filter(paras, lambda p: ~is_trivial(p)), of)


def sizing(paras: Column) -> Column:
    """Struct (excerpt, terms): characters to show of a document and terms to ask for."""
    total = total_length(paras)
    bound = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high)).cast("long")
    return F.struct(bound(F.floor(total / 20), 3000, 20000).alias("excerpt"), bound(F.floor(total / 4000), 25, 80).alias("terms"))


def stride_sample(paras: Column, budget: int = SAMPLE_CHARS) -> Column:
    """Places of the usable paragraphs that an excerpt of ``budget`` characters shows, spread over the document.

    A stride is walked from place 0, then from 1, and so on; the walk that reaches 98 % of the budget
    is the last, and an item that would overflow is passed over.
    """
    ints = F.array().cast("array<int>")

    def walk(v: Column) -> Column:
        order = F.array_sort(F.transform(v["lens"], lambda n, i: F.struct((i % v["stride"]).alias("turn"), i.alias("i"), n.alias("n"))))
        seed = F.struct(ints.alias("taken"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("turn"), F.lit(False).alias("done"))

        def add(s: Column, x: Column) -> Column:
            done = s["done"] | ((x["turn"] != s["turn"]) & (s["used"] >= budget * 0.98))
            fits = ~done & (s["used"] + x["n"] <= budget)
            return F.struct(F.when(fits, F.concat(s["taken"], F.array(x["i"]))).otherwise(s["taken"]).alias("taken"), F.when(fits, s["used"] + x["n"]).otherwise(s["used"]).alias("used"), x["turn"].alias("turn"), done.alias("done"))

        spread = F.array_sort(F.aggregate(order, seed, add, lambda s: s["taken"]))
        return F.when(v["total"] <= budget, F.transform(v["lens"], lambda _, i: i)).otherwise(spread)

    def plan(lens: Column) -> Column:
        total = F.aggregate(lens, F.lit(0).cast("long"), lambda a, n: a + n)
        return let(F.struct(lens.alias("lens"), total.alias("total"), F.greatest(F.lit(2), F.bround(total / budget)).cast("int").alias("stride")), walk)

    usable = F.filter(paras, lambda p: ~is_trivial(p))
    return let(F.transform(usable, lambda p: F.least(F.length(p), F.lit(CLIP))), plan)


def document_key(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text", digits: int = 16) -> DataFrame:
    """key and doc_key: hex digits of the digest of all page texts in page order, nothing between them."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    joined = F.array_join(F.transform(ordered, lambda s: s[text]), "")
    return pages.groupBy(key).agg(F.substring(F.sha2(joined, 256), 1, digits).alias("doc_key"))


def profile_key(excerpt: Column, digits: int = 32) -> Column:
    """Under what a document's profile is kept: hex digits of the digest of the excerpt that it was drawn from."""
    return F.substring(F.sha2(excerpt, 256), 1, digits)
