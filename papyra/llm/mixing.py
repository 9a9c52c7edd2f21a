"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words by water-filling: words are shared by weight, a source
stops at ``max_copies`` times its size, and what it can't take goes to the others by weight.
A document's expected copies are its source's target over its size, times the document's own
weight where documents have one, ``max_copies`` at most. The whole part is taken for certain. The fractional part p is sampled: documents are ranked in their source by
``(u / (1 - u)) / (p / (1 - p))``, u a uniform number fixed by the document's id and the seed, and
the lowest ranks are taken until the source's remaining words are used up, within half a document.

Only aggregates of ``(source, rank bin)`` are shuffled to find where each source's ranking is cut:
two histogram levels bring the cut down to one bin of 2**-24 of the ranks, and only that bin's
documents are sorted. A source with a third of all rows therefore costs no task more than another.

Defined results: null text has 0 words; a null source is a source of its own and sorts last;
an empty table gives no rows; repeated rows are taken alike or, at the cut, in the order of id and
size; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_side

#: ASCII white space splits words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a histogram level, as bits.
LEVEL_BITS = 12


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_copies: int) -> DataFrame:
    """source, source_size, target: water-filling in closed form, by running sums over the sources.

    In ascending order of ``max_copies * size / weight``, a source is full iff that level is at
    most what the words still to share would give it; full sources are a prefix of that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", (F.col("source_size") * max_copies).cast("double"))
    order = W.orderBy(F.col("room") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    every, before = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
        "room_before": F.coalesce(F.sum("room").over(before), F.lit(0.0)),
        "weight_from": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("full", F.col("room") * F.col("weight_from") <= F.col("weight") * (F.col("total") - F.col("room_before")))
    open_ = ~F.col("full")
    per = per.withColumns({
        "left": F.max("total").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(every), F.lit(0.0)),
        "open_weight": F.sum(F.when(open_, F.col("weight"))).over(every),
    })
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least(F.col("room"), F.col("left") / F.col("open_weight") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def uniform(key: str, seed: int):
    """A number in (0, 1) fixed by the key: 52 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def mix(docs: DataFrame, *, weights: list[int], share: float = 1.0, max_copies: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each row of ``docs``.

    With ``carry`` all columns of ``docs`` stay, but for ones named like those given here: texts are
    then read a second time instead of being kept, as what is taken hangs on id, source and size alone.
    ``weight`` names a column of documents' own weights: inclusion probabilities then differ within a
    source, in proportion to it. A null or negative weight counts as 0: such a document is not taken.
    """
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = [F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform(key, seed).alias("u"), own.alias("w")]
    sizes = cut(docs.select(*sized))  # what follows works on these five columns
    targets = source_targets(sizes, weights, share, max_copies)
    weighed = sizes.groupBy("source").agg(F.sum(F.col("w") * F.col("size")).alias("weighed")).withColumnRenamed("source", "w_source")
    targets = targets.join(weighed, targets["source"].eqNullSafe(weighed["w_source"])).drop("w_source")
    targets = small_side(cut(targets))
    expected = F.when(F.col("weighed") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("weighed") * F.col("w"))).otherwise(F.lit(0.0))

    def expect(frame: DataFrame) -> DataFrame:
        out = frame.join(targets, frame["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("expected", expected)
        return out.withColumn("sure", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.col("sure")).drop("expected", "weighed", "w")

    certain = expect(sizes).groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"), F.max("target").alias("t")).select(F.col("source").alias("l_source"), (F.col("t") - F.col("certain")).alias("left_words"))
    certain = small_side(cut(certain))
    # the key of a source's ranking, as a number in (0, 1) that keeps its order
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))

    def rank(frame: DataFrame) -> DataFrame:
        out = expect(frame)
        out = out.join(certain, out["source"].eqNullSafe(certain["l_source"])).drop("l_source")
        out = out.withColumn("rank", F.when(F.col("p") > 0, F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + odds)))
        return out.withColumn("bin", F.floor(F.col("rank") * float(2 ** (2 * LEVEL_BITS))).cast("long"))

    ranked = rank(sizes)

    crossing = None
    for shift in (LEVEL_BITS, 0):
        level = ranked.withColumn("b", F.shiftright("bin", shift))
        if crossing is not None:
            level = level.join(crossing, level["source"].eqNullSafe(crossing["c_source"])).where(F.col("bin").between(F.col("c_from"), F.col("c_to")))
        used = F.lit(0.0) if crossing is None else F.first("c_before")
        per_bin = level.where("p > 0").groupBy("source", "b").agg(F.sum("size").alias("words"), F.first("left_words").alias("left_words"), used.alias("used"))
        run = W.partitionBy("source").orderBy("b")
        per_bin = per_bin.withColumn("until", F.sum("words").over(run.rowsBetween(W.unboundedPreceding, 0)) + F.col("used"))
        first = F.min_by(F.struct("b", (F.col("until") - F.col("words")).alias("before")), "b").alias("c")
        found = per_bin.where("until > left_words").groupBy("source").agg(first)
        crossing = small_side(cut(found.select(F.col("source").alias("c_source"), F.shiftleft("c.b", shift).alias("c_from"), (F.shiftleft(F.col("c.b") + 1, shift) - 1).alias("c_to"), F.col("c.before").cast("double").alias("c_before"))))

    joined = ranked.join(crossing, ranked["source"].eqNullSafe(crossing["c_source"]), "left")
    # documents in the bin that the cut falls into are ranked one by one; a bin is 2**-24 of a source
    inside = (F.col("bin") == F.col("c_from")) & (F.col("p") > 0)
    at_cut = joined.where(inside).groupBy("source", "rank", "doc_id", "size").agg(F.count("*").alias("n"), F.first("left_words").alias("left_words"), F.first("c_before").alias("c_before"))
    line = W.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size")
    at_cut = at_cut.withColumn("before", F.col("c_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    taken = cut(at_cut.where("before + size * n - left_words <= left_words - before").select(F.col("source").alias("t_source"), F.col("rank").alias("t_rank"), F.col("doc_id").alias("t_id"), F.col("size").alias("t_size")))
    taken = small_side(taken)
    if carry:
        told = rank(docs.select(*sized, F.struct(*docs.columns).alias("carried")))
        joined = told.join(crossing, told["source"].eqNullSafe(crossing["c_source"]), "left")
    same = joined["source"].eqNullSafe(taken["t_source"]) & (joined["rank"] == taken["t_rank"]) & joined["doc_id"].eqNullSafe(taken["t_id"]) & (joined["size"] == taken["t_size"])
    out = joined.join(taken, same, "left")
    extra = F.when(F.col("p") <= 0, 0).when(F.col("c_from").isNull() | (F.col("bin") < F.col("c_from")), 1).when(F.col("t_rank").isNotNull(), 1).otherwise(0)
    copies = (F.col("sure") + extra).cast("int")
    mixed = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": (F.col("size") * copies).cast("long")}
    said = [c.alias(name) for name, c in mixed.items()]
    if carry:
        return out.select(*[F.col("carried")[c].alias(c) for c in docs.columns if c not in mixed], *said)
    return out.select("doc_id", said[0], joined["source"], *said[1:])
