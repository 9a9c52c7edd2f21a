"""Exact top-k search by distributed histogram selection.

Every stated query is scored against every row. The k-th best score of each query is located by
global histograms: each task counts its scores into bins, the counts are summed by (query, bin), and
the bin that holds the k-th score becomes the range of the next, finer round, with the bin's upper
edge kept, as finer bins may reach past it. Only that bin, one row a query, goes to the driver. Once
few scores are left in it, or it is one score wide, rows at or above its lower edge are kept, at most
k of them a task and query, and the final ranks come from those by (score descending, id ascending).
No score below the edge and no pair is ever stored.

``QUERIES`` queries travel with a job, so a round of all of them is one job up to that number, and
each further ``QUERIES`` take jobs of their own, whose answers are written before the next. A task
scores ``BLOCK`` queries with ``ROWS`` rows at a time.

Defined results: a vector that is null or has a null or non-finite component, before or after
scaling, takes no part, neither has a query an answer from vectors of another length; fewer than k candidates give all of them; ties
go to the smaller id; rows repeated under one id are each candidates of other ids; a null id takes no
part; an empty table gives no rows. Components are quantised to ``floor(scale * x)``. Arithmetic is
exact at any size: in doubles while all sums stay below 2**53, else in Python's integers. Scores
beyond 64 bits are ranked by their true value and given as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Queries of a job, and scored at a time; rows scored with them; bins of a histogram round; scores that may be left undecided.
QUERIES, BLOCK, ROWS, BINS, SLACK = 16_384, 1024, 2048, 256, 64
#: Sums below this are exact in doubles, and products of norms below that fit in 64 bits.
EXACT, LONG = 2**53, 2**62
#: What wide scores are moved by, so that their hexadecimal digits sort as they do (components are doubles).
SHIFT, DIGITS = 2**2200, 552


def _valid(vec: str):
    x = F.col(vec)
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrix of rows that have the same length, a few rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
            for n in np.unique(lengths):
                pick = np.flatnonzero(lengths == n)
                yield ids[pick], flat[starts[pick][:, None] + np.arange(n)]


def _integers(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x)


def _scores(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products as 64-bit integers, or as Python's if they may be wider."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        s = (q @ x.T).astype(np.int64)
        return s.astype(object) if wide else s
    s = _integers(q) @ _integers(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
    return s if wide else s.astype(np.int64)


class Queries:
    """The queries of a job by their length, and what is known of each one's k-th score."""

    def __init__(self, ids: list[int], vectors: list[list[float]], k: int, norm: float, wide: bool):
        order = sorted(range(len(ids)), key=lambda i: (len(vectors[i]), ids[i]))
        self.ids, self.wide, self.k = np.array([ids[i] for i in order], np.int64), wide, k
        self.parts: list[tuple[int, int, np.ndarray]] = []  # length, first number, matrix
        at = 0
        while at < len(order):
            n, stop = len(vectors[order[at]]), at
            while stop < len(order) and stop - at < BLOCK and len(vectors[order[stop]]) == n:
                stop += 1
            self.parts.append((n, at, np.array([vectors[i] for i in order[at:stop]], np.float64).reshape(stop - at, n)))
            at = stop
        # by Cauchy and Schwarz no score leaves this range
        reach = [_wide_reach(row, norm) if wide else int(np.sqrt((row * row).sum()) * norm * (1 + 1e-9)) + 1 for _, _, q in self.parts for row in q]
        kind = object if wide else np.int64
        self.low = np.array([-r for r in reach], kind)
        self.width = np.array([-(-(2 * r + 1) // BINS) for r in reach], kind)
        self.top = self.low + BINS * self.width  # scores from here on are already taken off ``need``
        self.need, self.open = np.full(len(ids), k, np.int64), np.ones(len(ids), bool)

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """q, b, n: how many of a task's scores lie in each bin of the open queries."""
        hist = np.zeros((len(self.ids), BINS), np.int64)
        for vid, x in _rows(batches):
            for n, first, q in self.parts:
                live = np.flatnonzero(self.open[first : first + len(q)])
                if n != x.shape[1] or not len(live):
                    continue
                at = first + live
                s = _scores(q[live], x, self.wide)
                bins = (s - self.low[at][:, None]) // self.width[at][:, None]
                ok = (bins >= 0) & (s < self.top[at][:, None]) & (vid[None, :] != self.ids[at][:, None])
                flat = (bins + np.arange(len(live))[:, None] * BINS)[ok].astype(np.int64)
                hist[at] += np.bincount(flat, minlength=len(live) * BINS).reshape(len(live), BINS)
        q_at, b_at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(q_at.astype(np.int32)), pa.array(b_at.astype(np.int32)), pa.array(hist[q_at, b_at])], names=["q", "b", "n"])

    def refine(self, found: list) -> None:
        """The bin of each open query that holds its k-th score; a query without one has fewer candidates, and all answer."""
        self.open &= np.isin(np.arange(len(self.ids)), [r["q"] for r in found])
        for r in found:
            i = r["q"]
            self.low[i] += r["b"] * self.width[i]
            self.top[i] = min(self.top[i], self.low[i] + self.width[i])
            self.need[i] -= r["above"]
            self.open[i] = bool(self.width[i] > 1 and r["n"] > SLACK)
            self.width[i] = max(1, -(-self.width[i] // BINS))

    def kept(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_id, vec_id, score and its order of a task's best rows at or above each query's edge."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for vid, x in _rows(batches):
            for n, first, q in self.parts:
                if n != x.shape[1]:
                    continue
                s = _scores(q, x, self.wide)
                at = slice(first, first + len(q))
                ok = (s >= self.low[at][:, None]) & (vid[None, :] != self.ids[at][:, None])
                for i in np.flatnonzero(ok.any(axis=1)):
                    score, vids = s[i][ok[i]], vid[ok[i]]
                    if first + i in held:
                        score, vids = np.concatenate((held[first + i][0], score)), np.concatenate((held[first + i][1], vids))
                    best = sorted(range(len(vids)), key=lambda j: (-score[j], vids[j]))[: self.k] if self.wide else np.lexsort((vids, -score))[: self.k]
                    held[first + i] = score[best], vids[best]
        if held:
            own = np.repeat(self.ids[list(held)], [len(s) for s, _ in held.values()])
            score, vids = (np.concatenate(z) for z in zip(*held.values(), strict=True))
            by = [f"{int(s) + SHIFT:0{DIGITS}x}" for s in score] if self.wide else score
            score = [max(-(2**63), min(2**63 - 1, int(s))) for s in score]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(vids), pa.array(score, pa.int64()), pa.array(by)], names=["query_id", "vec_id", "score", "by"])


def _wide_reach(row: np.ndarray, most: float) -> int:
    """A bound of the scores of one vector with others whose components are ``most`` at most."""
    return sum(abs(int(c)) for c in row) * int(most) + 1


def top_k(vectors: DataFrame, is_query, k: int = 10, *, key: str = "vec_id", vec: str = "embedding", scale: float = 1024.0, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its k best other rows."""
    spark = vectors.sparkSession
    whole = lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c)  # noqa: E731  beyond that doubles are whole
    grid = F.transform(F.col(vec), lambda c: whole(c.cast("double") * F.lit(scale)))
    quant = vectors.where(F.col(key).isNotNull() & _valid(vec)).select(F.col(key).cast("long").alias("id"), grid.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    quant = cut(quant.where(F.forall("v", lambda c: F.abs(c) < F.lit(float("inf")))))
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))))
    stats = quant.agg(F.sum(F.col("is_query").cast("long")).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm"), largest.alias("most")).first()
    n, norm = stats["n"] or 0, float(stats["norm"] or 0.0)
    wide = not norm < LONG  # the square of the largest norm bounds all scores
    parts = max(1, -(-n // (queries * 9 // 10)) if n > queries else 1)
    asked = quant.where("is_query").select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("part"))
    rows, out = quant.select("id", "v"), None
    for part in range(parts):
        own = asked.where(F.col("part") == part).select("id", "v").collect()  # about ``queries`` rows, by the hash
        found = _search(rows, Queries([r["id"] for r in own], [r["v"] for r in own], k, float(stats["most"] or 0.0) if wide else norm**0.5, wide))
        found = cut(found) if parts > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, asked: Queries) -> DataFrame:
    spark, by_query = rows.sparkSession, W.partitionBy("q").orderBy(F.desc("b"))
    while asked.open.any():
        counts = rows.mapInArrow(lambda batches: asked.counted(batches), "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        need = F.broadcast(spark.createDataFrame([(int(i), int(asked.need[i])) for i in np.flatnonzero(asked.open)], "q int, need long"))
        above = F.coalesce(F.sum("n").over(by_query.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        crossing = counts.withColumn("above", above).join(need, "q").where("above < need and need <= above + n")
        asked.refine(crossing.select("q", "b", "n", "above").collect())
    order = "string" if asked.wide else "long"
    kept = rows.mapInArrow(lambda batches: asked.kept(batches), f"query_id long, vec_id long, score long, by {order}")
    best = W.partitionBy("query_id").orderBy(F.desc("by"), F.asc("vec_id"))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= asked.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
