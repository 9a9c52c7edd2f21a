"""Files as tables, and the small JSON and Parquet stores around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import stem, suffix
from papyra.operators.cache import upsert

DOCUMENT_SUFFIXES = [".pdf", ".doc", ".docx"]
RATE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("cache_hit", "cache_miss", "output")])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PRICES = T.StructType([T.StructField("currency", T.StringType()), T.StructField("regimes", T.ArrayType(T.StructType([T.StructField("effective_from", T.StringType()), T.StructField("peak_hours_utc", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("rates", T.MapType(T.StringType(), T.MapType(T.StringType(), RATE)))])))])
CACHE = "engine string, params string, original string, translation string, write_seq long"


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of fewer files than there are cores dealt anew, so that what follows has work for all; of more files as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def scan_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of whole files; content is read only if a plan asks for it."""
    return spark.read.format("binaryFile").load(list(paths))


def scan_folder(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """Documents below a folder, by suffix in any case; the filter is on the path, so nothing else is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(suffix(F.col("path")).isin(suffixes or DOCUMENT_SUFFIXES))


def missing_files(wanted: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Wanted paths that are no addresses on the web and are not listed."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    have = listing.select(bare(F.col(path)).alias("_have")).distinct()
    return wanted.where(~F.rlike(F.col(path), F.lit("^https?://"))).join(have, bare(F.col(path)) == F.col("_have"), "left_anti")


def output_names(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """path, kind, name of the documents to write for each source."""
    return files.select("path", F.explode(F.array(*[F.lit(k) for k in kinds or ["mono", "dual"]])).alias("kind")).withColumn("name", F.concat(stem(F.col("path")), F.lit("-"), F.col("kind"), F.lit(".pdf")))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """effective_from, peak_hours, rates: a row for each regime of a price file, oldest first."""
    regime = spark.read.schema(PRICES).json(path, multiLine=True).select(F.explode("regimes").alias("r"))
    spans = F.transform("r.peak_hours_utc", lambda h: F.struct(h[0].alias("start"), h[1].alias("end")))
    return regime.select(F.to_timestamp("r.effective_from").alias("effective_from"), spans.alias("peak_hours"), F.col("r.rates").alias("rates")).orderBy("effective_from")


def append_memory(rows: DataFrame, path: str) -> None:
    """Translations are appended, never rewritten; reading folds them (``read_memory``)."""
    rows.write.mode("append").parquet(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The last translation of each (engine, params, original)."""
    return upsert(spark.read.schema(CACHE).parquet(path), ["engine", "params", "original"], "write_seq")


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles of documents; one without any fact is not saved, so that it never hides an older one."""
    profiles.where(F.size("facts") > 0).write.mode("append").json(path)


def read_profiles(spark: SparkSession, path: str, schema: str = "doc_key string, seq long, facts map<string,string>, terms map<string,string>") -> DataFrame:
    """The last saved profile of each document; an unreadable line counts as none."""
    saved = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("doc_key").isNotNull())
    rank = F.max_by(F.struct("facts", "terms"), "seq").alias("p")
    return saved.groupBy("doc_key").agg(rank).select("doc_key", "p.facts", "p.terms")


def overlay(found: Column, known: Column) -> Column:
    """A map with the entries of ``known``, and those of ``found`` for keys it lacks."""
    new = F.map_filter(found, lambda k, _: ~F.array_contains(F.map_keys(known), k))
    return F.map_concat(new, known)


def save_regions(regions: DataFrame, path: str) -> None:
    """Hand-marked rectangles (doc_key, page, x0, y0, x1, y1) by the identity of the document's text."""
    regions.write.mode("append").partitionBy("doc_key").parquet(path)


def load_regions(spark: SparkSession, path: str, doc_keys: DataFrame | None = None) -> DataFrame:
    """doc_key, page, x0, y0, x1, y1 as saved; with ``doc_keys`` (doc_key) of those documents only, by pruned folders."""
    saved = spark.read.parquet(path)
    return saved if doc_keys is None else saved.join(doc_keys.select("doc_key").distinct(), "doc_key", "left_semi")


def with_profiles(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Jobs (job, doc_key and more) with the facts and terms known of their document, null where nothing is."""
    return jobs.join(profiles.select("doc_key", "facts", "terms"), "doc_key", "left")


def language_pack(packs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Wanted pairs (source, target) with the first pack (source, target, i and more) that translates between them; a pair without one stays out."""
    rest = [c for c in packs.columns if c not in ("source", "target", "i")]
    first = packs.groupBy("source", "target").agg(F.min(F.struct("i", *rest)).alias("p"))
    return pairs.join(first, ["source", "target"]).select(*pairs.columns, "p.*")
