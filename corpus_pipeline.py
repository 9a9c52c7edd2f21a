"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Languages that can't be told go, one document of each group of near copies stays, documents that hold
benchmark passages go, personal data is masked, and the sources are mixed to their target weights.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import langid
from papyra.llm.common import cut, held_out, remove, shared_dir, small_side, table
from papyra.llm.decontam import find_leaks
from papyra.llm.mixing import mix
from papyra.llm.pii import redact_pii
from papyra.llm.queries import SOURCE_WEIGHTS
from papyra.llm.simhash import drop_similar

#: Least pooled probability of a document's language; four languages guessed at random have 0.25.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from those outside the held-out fold."""
    net = langid.fit(docs, ~held_out("doc_id"))
    told = langid.identify(docs, net, keep_text=True, names=("_language", "_language_score"))
    return told.where((F.col("_language") != "und") & (F.col("_language_score") >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return drop_similar(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    digest = F.md5("text")  # whether a document leaks hangs on its text alone, and ids may be null or repeated
    leaks = find_leaks(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = small_side(cut(leaks.select(F.col("doc_id").alias("gone")).distinct()))
    return docs.join(gone, digest == gone["gone"], "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    masked = redact_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, with their size in words and the copies taken of each."""
    return mix(docs, weights=SOURCE_WEIGHTS, share=1.0, max_copies=3, carry=True).where("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("mix_sources", mix_sources),
]

#: No stage but the last can be stated in SQL; tests hold run() against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's folder goes once the next one is written."""
    docs, base, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
