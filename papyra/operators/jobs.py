"""Job accounting over an append-only event log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each phase of a job lies on its progress bar (fixed values).
PHASES = {"collect": (0.0, 0.1), "context": (0.1, 0.6), "layout": (0.6, 1.0)}
STEP = 0.01


def fold_log(log: DataFrame, job: str = "job", order: str = "seq") -> DataFrame:
    """The state of each job after its last event."""
    rest = [c for c in log.columns if c not in (job, order)]
    return log.groupBy(job).agg(F.max(F.struct(order, *rest)).alias("s")).select(job, F.col(f"s.{order}").alias(order), *[F.col(f"s.{c}").alias(c) for c in rest])


def recent(jobs: DataFrame, created: str = "created", job: str = "job", limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc(created), job).limit(limit)


def reap(status: Column) -> Column:
    """Jobs that a restart finds unfinished were interrupted."""
    return F.when(status.isin("queued", "running"), "interrupted").otherwise(status)


def add_usage(runs: DataFrame, job: str = "job") -> DataFrame:
    """A resumed job's usage adds to what it had."""
    return runs.groupBy(job).agg(*[F.sum(c).alias(c) for c in ("tokens_hit", "tokens_miss", "tokens_out", "cost") if c in runs.columns])


def progress(phase: Column, done: Column, total: Column) -> Column:
    """Fraction of the whole job, from the fraction of its phase."""
    out = F.lit(None).cast("double")
    for name, (low, high) in PHASES.items():
        out = F.when(phase == name, low + (high - low) * F.when(total > 0, done / total).otherwise(F.lit(0.0))).otherwise(out)
    return out


def throttle(events: Column, step: float = STEP) -> Column:
    """Of structs (seq, stage, progress) in order, those worth telling: a new stage, or ``step`` beyond the last told.

    Stages and progress go to Python in Arrow batches, and the places told come back.
    """

    @F.pandas_udf("array<int>")
    def told(stages: pd.Series, progress: pd.Series) -> pd.Series:
        def one(stages: np.ndarray, progress: np.ndarray) -> list[int]:
            out, stage, at = [], None, None
            for i, (s, p) in enumerate(zip(stages, progress, strict=True)):
                p = None if p is None or p != p else float(p)
                if at is None or s != stage or (p is not None and abs(p - at) >= step):
                    out.append(i)
                    stage, at = s, p
            return out

        return pd.Series([one(s, p) for s, p in zip(stages, progress, strict=True)])

    places = told(F.transform(events, lambda e: e["stage"]), F.transform(events, lambda e: e["progress"].cast("double")))
    pick = lambda i: F.get(events, i)
    return F.transform(places, lambda i: F.struct(pick(i)["seq"].cast("long").alias("seq"), pick(i)["stage"].alias("stage"), pick(i)["progress"].cast("double").alias("progress")))


def throttled(log: DataFrame, job: str = "job") -> DataFrame:
    """job, seq, stage, progress of the events told; a job's own events are bounded by its length."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "stage", "progress")))
    return log.groupBy(job).agg(ordered.alias("events")).select(job, F.explode(throttle(F.col("events"))).alias("e")).select(job, "e.*")


def missing_kinds(jobs: DataFrame, kinds: str = "kinds") -> Column:
    return F.array_except(F.array(F.lit("mono"), F.lit("dual")), F.col(kinds))


def single_source(files: DataFrame, outputs: DataFrame, job: str = "job", path: str = "path") -> DataFrame:
    """job, path where exactly one of a job's files is not an output of it."""
    rest = files.join(outputs.select(job, path).distinct(), [job, path], "left_anti")
    return rest.groupBy(job).agg(F.count("*").alias("n"), F.min(path).alias(path)).where("n = 1").drop("n")


def streamed_replies(chunks: DataFrame, by: str = "call", order: str = "seq", delta: str = "delta", usage: str = "usage") -> DataFrame:
    """by, text, usage: a reply put together from its pieces, null ones left out, and the usage that the last piece with one tells."""
    pieces = F.array_sort(F.collect_list(F.when(F.col(delta).isNotNull(), F.struct(order, delta))))
    last = F.max_by(F.col(usage), F.when(F.col(usage).isNotNull(), F.col(order)))
    told = chunks.groupBy(by).agg(pieces.alias("p"), last.alias(usage))
    return told.select(by, F.array_join(F.transform("p", lambda p: p[delta]), "").alias("text"), usage)
