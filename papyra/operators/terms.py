"""Vocabulary, glossary matching and the glossary itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions.text import CASEFOLD_FROM, adjacent, flat, fold, words

UNIGRAMS, BIGRAMS, LEAST, MAX_INJECTED, MAX_SOURCE = 120, 60, 3, 40, 80
#: Words too common to be terms (fixed values).
STOP = (
    "a an the and or but if then else of in on at to for from by with without into over under about as is are was were be been being do does did "
    "this that these those it its we our you your they their he she his her not no than such can may might must shall should will would have has had "
    "also more most other some any each which what when where who whom whose there here how why all both few many much only own same so too very just "
    "now new one two three first second next last another between during before after above below up down out off again further once because while "
    "until although however therefore thus hence e.g i.e et al fig figure section chapter table example note see let us"
).split()


def _content(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(STOP)


def vocabulary(paras: DataFrame, *, pairs: bool = False, top: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, term, n, rank: a document's most frequent content words, or neighbours that both are.

    Ties go to the earlier first occurrence. The top is cut first, then terms of under three uses go.
    A document's words are in one task before the shuffle, which so carries distinct terms only.
    """
    found = paras.select(key, F.posexplode("paras").alias("para", "text")).select(key, "para", words(F.col("text")).alias("w"))
    items = adjacent(F.col("w")) if pairs else F.col("w")
    each = found.select(key, "para", F.posexplode(items).alias("at", "term")).where(F.col("term").isNotNull())
    sides = F.split("term", " ")
    each = each.where(_content(sides[0]) & _content(sides[1]) if pairs else _content(F.col("term")))
    counted = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min(F.struct("para", "at")).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= (top or (BIGRAMS if pairs else UNIGRAMS)))
    return best.where(F.col("n") >= LEAST).select(key, "term", "n", "rank")


def match_terms(texts: DataFrame, forms: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = MAX_INJECTED, block: int = 50_000) -> DataFrame:
    """key, term, rank: the terms whose forms a text holds, longest first, ``limit`` at most.

    A form is found as a part of the text; its case matters only for acronyms; an empty one is none.
    ``forms`` (form, term) is the glossary of a job. Its forms make automata of about ``block`` each,
    and a text is read once by each, whatever the number of forms.
    """
    small = forms.select(flat(F.col("form")).alias("form"), "term").where((F.col("form") != "") & F.col("term").isNotNull()).distinct()
    small = small.select("term", F.when(F.length("form") >= CASEFOLD_FROM, F.lower("form")).otherwise(F.col("form")).alias("form"), (F.length("form") >= CASEFOLD_FROM).alias("any_case"))
    blocks = max(1, -(-small.count() // block))
    level = flat(F.col(text))
    shown = texts.select(key, level.alias("exact"), F.lower(level).alias("low"))
    schema, found = f"{key} {texts.schema[key].dataType.simpleString()}, term string", None
    for n in range(blocks):
        own = [tuple(r) for r in small.where(F.pmod(F.xxhash64("form", "term"), F.lit(blocks)) == n).collect()]  # about ``block`` rows
        hit = shown.mapInArrow(_finder(own, schema), schema)
        found = hit if found is None else found.unionByName(hit)
    if blocks > 1:
        found = found.distinct()  # a term's forms may be in several blocks
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.length("term")), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _finder(forms: list[tuple[str, str, bool]], schema: str):
    """mapInArrow over (key, exact, low): a row for each term that a row's texts hold a form of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        terms = sorted({t for t, _, _ in forms})
        number, automata = {t: i for i, t in enumerate(terms)}, []
        for any_case in (False, True):
            by: dict[str, list[int]] = {}
            for term, form, folded in forms:
                if folded == any_case:
                    by.setdefault(form, []).append(number[term])
            automaton = ahocorasick.Automaton()
            for form, own in by.items():
                automaton.add_word(form, tuple(own))
            if by:
                automaton.make_automaton()
                automata.append((1 + any_case, automaton))
        for batch in batches:
            rows, hits = [], []
            for column, automaton in automata:
                for i, text in enumerate(batch.column(column).to_pylist()):
                    if text:
                        new = {n for _, own in automaton.iter(text) for n in own}
                        rows += [i] * len(new)
                        hits += sorted(new)
            one = np.unique(np.array([rows, hits], np.int64).reshape(2, -1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(one[0])), pa.array([terms[n] for n in one[1]], pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    return run


def grounded(terms: DataFrame, excerpts: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Proposed (key, term, forms) whose name or any form the key's excerpt shows, case and hyphens aside."""
    joined = terms.join(excerpts.select(key, F.lower(flat(F.col("excerpt"))).alias("shown")), key)
    names = F.filter(F.concat(F.array("term"), F.coalesce("forms", F.array().cast("array<string>"))), lambda f: f.isNotNull() & (f != ""))
    return joined.where(F.exists(names, lambda f: F.contains(F.col("shown"), F.lower(flat(f))))).select(*terms.columns)


def forms_by_term(forms: DataFrame) -> DataFrame:
    return forms.groupBy("term").agg(F.array_sort(F.collect_set("form")).alias("forms"))


class Glossary:
    """Terms of one document in the order they are met; the first rendering of a term stays."""

    def __init__(self) -> None:
        self.terms: dict[str, str] = {}
        self.forms: dict[str, str] = {}
        self.lost: dict[str, str] = {}

    @staticmethod
    def key(form: str) -> str:
        level = " ".join(form.replace("-", " ").split())
        return level.lower() if len(level) >= CASEFOLD_FROM else level

    def add(self, batch: list[tuple[str, str, list[str] | None]]) -> None:
        """Shorter names first, so that a general decision stands before the phrases built on it."""
        for source, target, forms in sorted(batch, key=lambda e: len(e[0])):
            source, target = source.strip(), target.strip()
            if not source or not target or len(source) > MAX_SOURCE:
                continue
            term = self.forms.get(self.key(source), source)
            kept = self.terms.setdefault(term, target)
            if kept != target:
                self.lost[target] = kept
            for form in (source, *(forms or ())):
                if form and 0 < len(self.key(form)) <= MAX_SOURCE:
                    self.forms.setdefault(self.key(form), term)

    def matching(self, text: str, limit: int = MAX_INJECTED) -> list[tuple[str, str]]:
        """Agreed terms whose name or a form of it the text shows, with their renderings; longest names first."""
        exact = " ".join(text.replace("-", " ").split())
        low = exact.lower()
        shown = {t for f, t in self.forms.items() if f in (low if len(f) >= CASEFOLD_FROM else exact)}
        return [(t, self.terms[t]) for t in sorted(shown, key=lambda t: (-len(t), t))[:limit] if t in self.terms]

    def fixups(self) -> dict[str, str]:
        """Renderings that lost and what replaces them, unless one holds the other."""
        return {a: b for a, b in self.lost.items() if a and b and a not in b and b not in a}


def fold_glossary(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind (term, form, fixup), left, right after folding (key, chunk, pos, source, target, forms) in order.

    The identity of a term depends on all forms learned before, so a document's entries are folded in
    one task; the terms proposed for one document are bounded by its chunks.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = Glossary()
        for _, chunk in group.sort_values(["chunk", "pos"]).groupby("chunk", sort=True):
            clean = [(s, t, None if f is None else list(f)) for s, t, f in zip(chunk["source"], chunk["target"], chunk["forms"], strict=True) if isinstance(s, str) and isinstance(t, str)]
            g.add(clean)
        out = [("term", *x) for x in g.terms.items()] + [("form", *x) for x in g.forms.items()] + [("fixup", *x) for x in g.fixups().items()]
        return pd.DataFrame([(group[key].iloc[0], *x) for x in out], columns=[key, "kind", "left", "right"])

    kind = entries.schema[key].dataType.simpleString()
    return entries.groupBy(key).applyInPandas(run, f"{key} {kind}, kind string, left string, right string")


def folded(form: Column) -> Column:
    return fold(flat(form))
