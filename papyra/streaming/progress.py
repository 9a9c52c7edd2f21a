"""Streams of job events: throttled progress, running usage, last states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.jobs import STEP

TOLD = "job string, seq long, stage string, progress double"


def told(rows: list[tuple[int, str, float]], last: tuple[str, float] | None, step: float = STEP) -> tuple[list[tuple[int, str, float]], tuple[str, float] | None]:
    """Events worth telling after the one told last, and the new last one."""
    out = []
    for seq, stage, progress in rows:
        if last is None or stage != last[0] or abs(progress - last[1]) >= step:
            out.append((seq, stage, progress))
            last = (stage, progress)
    return out, last


def throttle_stream(events: DataFrame, step: float = STEP, idle: str = "1 hour") -> DataFrame:
    """The batch operator ``jobs.throttled`` for a stream: state is one (stage, progress) a job.

    Events of a micro-batch are put in order of seq; a job's state goes once it is idle.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        last = state.get if state.exists else None
        out, last = told(list(zip(rows["seq"], rows["stage"], rows["progress"], strict=True)), last, step)
        state.update(last)
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["job", "seq", "stage", "progress"])

    return events.groupBy("job").applyInPandasWithState(run, TOLD, "stage string, progress double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_usage(calls: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Tokens and cost of each job by the hour; hours close once the watermark has passed them."""
    timed = calls.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span), "job").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("calls"))
