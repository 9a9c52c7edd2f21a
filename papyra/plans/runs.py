"""Runs that can be stopped and taken up again.

What a run has written to the memory is not asked for again, so a run that broke off is resumed by
starting it anew. A streamed batch is written under its number and overwrites itself if it is tried
again. Cancelling goes by the job group of the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from papyra.operators.cache import upsert
from papyra.plans import chunked


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, translation: of runs written under ``path``, the last one's; empty before the first run."""
    schema = "cache_key string, translation string, run long"
    try:
        saved = spark.read.schema(schema).parquet(f"{path}/run=*")
    except Exception as e:  # a path that is not there has no exception class of its own
        if "PATH_NOT_FOUND" not in str(e):
            raise
        saved = spark.createDataFrame([], schema)
    return upsert(saved, ["cache_key"], "run").select("cache_key", "translation")


def translate_into(docs: DataFrame, path: str, run: int, make: Callable[[], chunked.ChunkService], **options) -> DataFrame:
    """Translate what the memory under ``path`` lacks and write it as run ``run``; the same number again replaces that run's rows."""
    known = read_translations(docs.sparkSession, path)
    done = chunked.translate_documents(docs, known, make, **options)
    new = chunked.written(done, options.get("key", "doc_id")).withColumn("run", F.lit(run).cast("long"))
    new.dropDuplicates(["cache_key"]).write.mode("overwrite").parquet(f"{path}/run={run}")
    return read_translations(docs.sparkSession, path)


def idempotent(stream: DataFrame, path: str) -> DataStreamWriter:
    """A writer whose batches stand under their numbers, so a batch that is tried again is not written twice."""
    return stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))


def cancellable(spark: SparkSession, run: str, action: Callable[[], object]) -> object:
    """``action`` under the name of a run, so that ``cancel`` ends its tasks."""
    context = spark.sparkContext
    context.setJobGroup(run, run, interruptOnCancel=True)
    try:
        return action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, run: str) -> None:
    spark.sparkContext.cancelJobGroup(run)
