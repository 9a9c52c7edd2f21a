"""Prices that change over time, and the usage of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MILLION = 1_000_000


def intervals(regimes: DataFrame, start: str = "effective_from") -> DataFrame:
    """Regimes with the half-open interval they hold for; the first also holds for all time before."""
    line = W.orderBy(start)
    first = F.row_number().over(line) == 1
    return regimes.withColumns({"holds_from": F.when(~first, F.col(start)), "holds_to": F.lead(start).over(line)})


def in_force(calls: DataFrame, regimes: DataFrame, when: str = "ts", start: str = "effective_from", most: int = 10_000) -> DataFrame:
    """Calls with the regime in force: the last that began by then, else the first.

    A price table has few rows; it is counted, and broadcast only up to ``most``. A longer one is
    met by spans of time (``in_force_by_span``).
    """
    n = regimes.count()
    if n > most:
        return in_force_by_span(calls, regimes, when, start, spans=-(-n // 1000))
    held = F.broadcast(intervals(regimes, start))
    return calls.join(held, _holds(when), "left").drop("holds_from", "holds_to")


def _holds(when: str) -> Column:
    return (F.col("holds_from").isNull() | (F.col(when) >= F.col("holds_from"))) & (F.col("holds_to").isNull() | (F.col(when) < F.col("holds_to")))


def in_force_by_span(calls: DataFrame, regimes: DataFrame, when: str, start: str, spans: int) -> DataFrame:
    """The same for any number of regimes: time is cut into spans, an interval stands in each that it touches, a call in its own.

    No window goes over more than a span's regimes or the spans themselves, and calls are joined by span.
    """
    ends = regimes.agg(F.min(start).alias("low"), F.max(start).alias("high")).first()
    low, high = F.lit(ends["low"]), F.lit(ends["high"])
    share = lambda t: (F.unix_micros(t) - F.unix_micros(low)) / F.greatest(F.unix_micros(high) - F.unix_micros(low), F.lit(1))
    span = lambda t: F.least(F.greatest(F.floor(share(t) * spans), F.lit(0)), F.lit(spans - 1)).cast("int")
    line = W.partitionBy("_span").orderBy(start)
    placed = regimes.withColumn("_span", span(F.col(start))).withColumns({"_n": F.row_number().over(line), "_next": F.lead(start).over(line)})
    first = placed.groupBy("_span").agg(F.min(start).alias("_first")).withColumn("_after", F.lead("_first").over(W.orderBy("_span"))).drop("_first")
    held = placed.join(F.broadcast(first), "_span")  # ``spans`` rows at most
    held = held.withColumns({"holds_to": F.coalesce("_next", "_after"), "holds_from": F.when((F.col("_span") > 0) | (F.col("_n") > 1), F.col(start))})
    until = F.when(F.col("holds_to").isNull(), spans - 1).otherwise(span(F.col("holds_to")))
    held = held.withColumn("_span", F.explode(F.sequence(F.when(F.col("holds_from").isNull(), 0).otherwise(F.col("_span")), until))).drop("_n", "_next", "_after")
    own = calls.withColumn("_call_span", span(F.col(when)))
    return own.join(held, (F.col("_call_span") == F.col("_span")) & _holds(when), "left").drop("_call_span", "_span", "holds_from", "holds_to")


def is_peak(when: Column, peak_hours: Column) -> Column:
    """The hour, in UTC, lies in one of the half-open spans."""
    hour = F.hour(when)
    return F.coalesce(F.exists(peak_hours, lambda h: (h["start"] <= hour) & (hour < h["end"])), F.lit(False))


def rate(rates: Column, model: Column, peak: Column) -> Column:
    """Rates of the model in the period, those off peak if the period has none; null for an unknown model."""
    of = F.try_element_at(rates, model)
    return F.coalesce(F.when(peak, F.try_element_at(of, F.lit("peak"))), F.try_element_at(of, F.lit("off_peak")))


def cost(rates: Column, hit: Column, miss: Column, out: Column) -> Column:
    return (hit * rates["cache_hit"] + miss * rates["cache_miss"] + out * rates["output"]) / MILLION


def usage(calls: DataFrame, job: str = "job") -> DataFrame:
    """Totals of each job's priced calls; calls of an unknown model count tokens and leave the job unpriced."""
    return calls.groupBy(job).agg(F.sum("tokens_hit").alias("tokens_hit"), F.sum("tokens_miss").alias("tokens_miss"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("calls"), F.bool_and(F.col("cost").isNotNull()).alias("priced"))
