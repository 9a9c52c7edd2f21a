"""Translation memory: lookups, upserts, canonical parameters, and the check of replies against requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import strip


def canonical_json(text: str) -> str:
    """Parameters as one text whatever the order of their keys, at every depth; lists keep their order."""
    import json

    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_params(params: Column) -> Column:
    """The same for a map of strings, in the JVM."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def upsert(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row written for each key; rows written together tie by their content. One partial aggregate, no sort."""
    rest = [c for c in log.columns if c not in (*keys, order)]
    last = F.max(F.struct(order, *rest)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, F.col(f"last.{order}").alias(order), *[F.col(f"last.{c}").alias(c) for c in rest])


def lookup(units: DataFrame, memory: DataFrame, keys: list[str], value: str = "translation") -> DataFrame:
    """Units with the remembered value, null where there is none; null keys never match."""
    return units.join(memory.select(*keys, value), keys, "left")


def first_occurrences(units: DataFrame, text: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows whose text occurs for the first time in its group; by an aggregate, so a frequent text costs no task more."""
    by = by or []
    rest = [c for c in units.columns if c not in (*by, text, *order)]
    first = units.groupBy(*by, text).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*by, text, *[F.col(f"first.{c}").alias(c) for c in (*order, *rest)])


def aligned(requests: DataFrame, replies: DataFrame, by: str, item: str, text: str = "text") -> DataFrame:
    """by, accepted, missing, extra: a chunk's reply counts only if its ids are those asked for and no text is blank."""
    asked = requests.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("asked"))
    got = replies.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("got"), F.bool_or(strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank"))
    both = asked.join(got, by, "left").withColumn("got", F.coalesce("got", F.expr("slice(asked, 1, 0)")))
    missing, extra = F.size(F.array_except("asked", "got")), F.size(F.array_except("got", "asked"))
    return both.select(by, ((missing == 0) & (extra == 0) & ~F.coalesce("blank", F.lit(False))).alias("accepted"), missing.alias("missing"), extra.alias("extra"))
