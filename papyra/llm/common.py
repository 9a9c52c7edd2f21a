"""What the corpus operators share: reading, cutting lineage, hold-out folds, bounded samples."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.files import dealt


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table by Spark's own reader, narrowed to ``columns`` where given; texts of a few files are dealt over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return dealt(df) if name in ("documents", "pages") else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, one is made on this machine if the session runs on it alone; on a
    cluster that would be each executor's own disk, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"{tempfile.gettempdir()}/papyra-checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor loses none of it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: A key with over this share of all rows is hot; there are fewer than its inverse of them.
HOT_SHARE = 1e-4


def join_hot(left: DataFrame, right: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """Inner join of ``left`` to one row a key in ``right``, whose column ``uses`` counts the left rows of a key.

    Keys that over ``HOT_SHARE`` of the ``total`` left rows have are fewer than 10,000: their right
    rows are broadcast, so no task gathers a hot key. All other keys meet by an ordinary join.
    """
    is_hot = F.col(uses) > F.lit(total * HOT_SHARE)
    hot = F.broadcast(right.where(is_hot).drop(uses))
    rest = left.join(F.broadcast(right.where(is_hot).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.where(~is_hot).drop(uses), key))


def held_out(key: str, folds: int = 5) -> Column:
    """True for rows of the fold that models never learn from; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == 0


#: Rows of a side that may be broadcast; more than that and Spark plans an ordinary join.
BROADCAST_ROWS = 20_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, already cut, with a broadcast hint only if its counted rows are within ``limit``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bounded_sample(df: DataFrame, by: str, per_value: int, key: str, values: int = 1000) -> DataFrame:
    """About ``per_value`` rows of each value of ``by``, the same rows on every run.

    Rows are kept by a hash of ``key`` against their value's share, so the sample needs counts and
    one filter, no shuffle of rows. Nulls in ``by`` are left out; ``values`` bounds how many values
    are taken, the most frequent first.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(values).collect()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 30))
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((F.col(by) == F.lit(r[by])) & (draw < F.lit(min(1 << 30, (per_value << 30) // r["count"]))))
    return df.where(keep)


def release() -> None:
    """In a Python worker: give what earlier groups have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass
