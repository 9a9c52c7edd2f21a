"""The corpus operators applied to the driver's tables, with SQL where SQL states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, toxicity
from .common import held_out, table
from .decontam import find_leaks
from .mixing import mix
from .pii import find_pii
from .repeats import remove_repeats
from .simhash import near_duplicates
from .tokens import count_tokens, load_vocabulary
from .topk import top_k

#: Longest text, in tokens, that op8 calls within its limit.
TOKEN_LIMIT = 2048
#: Weights of sources in the order of their names, repeating.
SOURCE_WEIGHTS = [1, 2, 3]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), weights=SOURCE_WEIGHTS, share=1.0, max_copies=3, seed=7)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), html_text.train())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = toxicity.fit(docs, labels, ~held_out("doc_id"))
    return toxicity.score(docs.withColumn("held_out", held_out("doc_id")), machine)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), width=100)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    net = langid.fit(docs, ~F.col("held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), net)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, TOKEN_LIMIT)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, seed=42, t=2, blocks=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_html": op2_html, "op3_toxicity": op3_toxicity, "op4_decontaminate": op4_decontaminate, "op5_topk": op5_topk, "op6_repeats": op6_repeats, "op7_langid": op7_langid, "op8_tokens": op8_tokens, "op9_simhash": op9_simhash, "op10_pii": op10_pii}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
