"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of its word shingles' hashes. Fingerprints within
``t`` bits are found without comparing all pairs: the code words of a perfect covering code are the
anchors. Bits are read as blocks of 23, each covered by the binary Golay code (covering radius 3),
so every fingerprint has exactly one home anchor a block. If x and y differ in at most t bits, y lies
within 3 + t of x's home, so each fingerprint also visits every anchor within that reach and is
compared, per anchor, with those at home there. A fingerprint visits only anchors above its own
home, as the pair is otherwise seen from the other side. No link is lost, whatever the data.

Rows of one fingerprint are one node. A bucket reports a star of each of its components, not its
pairs, and stars are joined by contraction on the executors. Buckets with more than ``HEAVY`` homes
are split into a grid of (homes, visitors) cells, so no task holds an unbounded bucket.

Defined results: null or blank text has fingerprint 0 and links like any other; repeated rows share
their component; a null id takes part but never names a component unless all its ids are null.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, release, small_side
from .graph import components

#: Fixed values of the binary Golay code: block length, covering radius, generator polynomial.
GOLAY_N, GOLAY_R, GOLAY_G = 23, 3, 0b101011100011
#: Homes of a bucket above which it is split; shingles hashed at a time; cells compared at a time.
HEAVY, SHINGLES, CELLS = 4096, 65_536, 4_000_000


def shingle_bits(text: str | None, words: int, seed: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit (most significant first), and how many there are."""
    tokens = (text or "").encode().lower().split()
    sums = np.zeros(64, np.int64)
    if not tokens:
        return sums, 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, n, SHINGLES):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=True)])
        sums += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return sums, n


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """Signed 64-bit value whose bit is 1 where over half the shingle hashes have it."""
    sums, n = shingle_bits(text, words, seed)
    return int(np.packbits(sums * 2 > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


class GolayBlock:
    """Home and reachable anchors of 23-bit words; an anchor is named by its 12 information bits."""

    def __init__(self, t: int):
        parity = np.zeros(4096, np.int64)
        for info in range(4096):
            rest = info << 11
            for bit in range(22, 10, -1):
                if rest >> bit & 1:
                    rest ^= GOLAY_G << (bit - 11)
            parity[info] = rest
        self._parity, self.words = parity, (np.arange(4096) << 11) | parity
        self._leader = np.zeros(2048, np.int64)
        ones = [0] + [1 << i for i in range(23)]
        for a in range(24):
            for b in range(a, 24):
                for c in range(b, 24):
                    if (e := ones[a] | ones[b] | ones[c]).bit_count() <= GOLAY_R:
                        self._leader[parity[e >> 11] ^ (e & 2047)] = e
        far = np.bitwise_count(self._leader[:, None] ^ self.words[None, :])
        #: for each excess i: offsets, by syndrome, into the anchors at distance 3 + i exactly (3 or less for 0)
        self.steps = []
        for i in range(t + 1):
            s, c = np.nonzero(far <= GOLAY_R if i == 0 else far == GOLAY_R + i)
            self.steps.append((np.searchsorted(s, np.arange(2049)), c))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home anchor and syndrome."""
        syndrome = self._parity[x >> 11] ^ (x & 2047)
        return (x ^ self._leader[syndrome]) >> 11, syndrome

    def reach(self, home: np.ndarray, syndrome: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors whose excess over the covering radius is i."""
        start, code = self.steps[i]
        n = start[syndrome + 1] - start[syndrome]
        row = np.repeat(np.arange(len(home)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[syndrome], n)
        return row, home[row] ^ code[at]


def cover(fp: np.ndarray, blocks: int, t: int, golay: GolayBlock, first_bit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; then rows and anchors of its visits above home."""
    bits = fp.astype(np.uint64)
    parts = [golay.home(((bits >> np.uint64(first_bit + GOLAY_N * b)) & np.uint64(2**GOLAY_N - 1)).astype(np.int64)) for b in range(blocks)]
    home = np.zeros(len(fp), np.int64)
    for h, _ in parts:
        home = home * 4096 + h
    rows, anchors = [], []
    states = [(np.arange(len(fp)), np.zeros(len(fp), np.int64), 0)]
    for h, s in parts:
        states = [(row[sub], name[sub] * 4096 + anchor, used + i) for row, name, used in states for i in range(t - used + 1) for sub, anchor in [golay.reach(h[row], s[row], i)]]
    for row, name, _ in states:
        above = name > home[row]
        rows.append(row[above])
        anchors.append(name[above])
    return home, np.concatenate(rows), np.concatenate(anchors)


def _stars(home_fp: np.ndarray, all_fp: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) among a bucket's fingerprints; homes come first in ``all_fp``."""
    label = np.arange(len(all_fp))
    step = max(1, CELLS // max(1, len(all_fp)))
    for at in range(0, len(home_fp), step):
        i, j = np.nonzero(np.bitwise_count(home_fp[at : at + step, None] ^ all_fp[None, :]) <= t)
        i += at
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return all_fp[moved], all_fp[label[moved]]


def _compare(t: int):
    """mapInArrow over rows (bucket, home, fp) sorted by bucket, homes first: links of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(bucket: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(bucket)) + 1
            start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(bucket)]))
            homes = np.add.reduceat(home.astype(np.int64), start) if len(bucket) else start
            a, b = [], []
            live = (homes > 0) & (end - start > 1)
            pair = live & (end - start == 2)  # most buckets hold two: no loop for those
            p = start[pair]
            near = np.bitwise_count(fp[p] ^ fp[p + 1]) <= t
            a.append(fp[p[near]])
            b.append(fp[p[near] + 1])
            for s, e, h in zip(start[live & ~pair].tolist(), end[live & ~pair].tolist(), homes[live & ~pair].tolist(), strict=True):
                x, y = _stars(fp[s : s + h], fp[s:e], t)
                if len(x):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if done:
                yield work(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        if len(held[0]):
            yield work(*held)

    return run


def links(nodes: DataFrame, t: int = 2, blocks: int = 2) -> DataFrame:
    """a, b: stars whose components are those of all pairs within ``t`` bits; ``nodes`` has distinct fp."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = GolayBlock(t)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                home, row, anchor = cover(fp, blocks, t, golay)
                out = [np.concatenate((home, anchor)), np.concatenate((np.ones(len(fp), bool), np.zeros(len(row), bool))), np.concatenate((fp, fp[row])).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", "home", "fp"])

    rows = nodes.select("fp").mapInArrow(emit, "bucket long, home boolean, fp long")
    heavy = cut(rows.where("home").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("bucket", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")))
    if not heavy.isEmpty():
        rows = rows.join(small_side(heavy), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        cell = F.xxhash64("bucket", "r", "c")
        whole = rows.where("parts = 1").select("bucket", "home", "fp")
        split = rows.where("parts > 1").withColumn("own", own.cast("int"))
        # each home stands at home in its row of the grid and visits its column; visitors only visit
        at_home = split.where("home").select("bucket", F.lit(True).alias("home"), "fp", F.col("own").alias("r"), F.explode(every).alias("c"))
        visits = split.select("bucket", F.lit(False).alias("home"), "fp", F.explode(every).alias("r"), F.col("own").alias("c"))
        rows = whole.unionByName(at_home.unionByName(visits).select(cell.alias("bucket"), "home", "fp"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("home"))
    return dealt.mapInArrow(_compare(t), "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 3, seed: int = 42, t: int = 2, blocks: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (least id of the fingerprints reachable by links of ``t`` bits) for each row."""
    prints = cut(fingerprints(docs, words, seed, key, text))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(links(nodes, t, blocks))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    groups = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    names = cut(join_hot(named, groups, "root", "members", nodes.count()).select("fp", "n", "component_id"))
    together = join_hot(prints, names, "fp", "n", prints.count())
    return together.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similar documents: long sketches, many covers of short parts of them, candidates told by the whole sketch, links
# confirmed by shingles; then all pairs that may still be links

#: Bits of a sketch, in lanes of 64; expected share of equal documents' pairs that meet in one table or more.
LANES, RECALL = 4, 0.95
#: Deviations above the bits expected at the threshold within which a pair's shingles are compared; deviations below
#: them from which a pair is taken to be confirmed when it is compared.
SPREAD, SURE = 3.5, 1.5
#: Tables that give a pair: other pairs join the two in further ones, or the second pass does.
MEETINGS = 3
#: Nodes whose digests are broadcast, 60 bytes each; more are met by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Tables whose rows are on disk at a time.
AT_ONCE = 5
#: Nodes that anchors of 23 bits alone tell apart well enough; beyond, tables add exact bits and grow in number.
PLAIN_NODES = 1 << 18


def differing_share(similarity: float) -> float:
    """Expected share of differing bits between sketches of sets with this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def plan_tables(n_nodes: int, similarity: float, t: int) -> tuple[int, int]:
    """Tables and exact bits so that a pair at the threshold meets with probability ``RECALL``, at any size."""
    exact = max(0, int(np.ceil(np.log2(max(1, n_nodes) / PLAIN_NODES))))
    p = differing_share(similarity)
    near = sum(float(np.prod([(GOLAY_N - j) / (j + 1) for j in range(i)])) * p**i * (1 - p) ** (GOLAY_N - i) for i in range(t + 1))
    meet = near * (1 - p) ** exact
    return max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))), exact


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """The 64-bit hash of each shingle, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last, digest = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]), np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Bitwise majority of the shingles' hashes in LANES * 64 bits, each lane mixed from the same hash."""
    sums = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), SHINGLES // LANES):
        h, lanes = hashes[at : at + SHINGLES // LANES], []
        for k in range(LANES):
            x = (h ^ np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            lanes.append(x ^ (x >> np.uint64(32)))
        bits = np.unpackbits(np.ascontiguousarray(np.stack(lanes, axis=1)).view(np.uint8).reshape(len(h), 8 * LANES), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > len(hashes)).tobytes()


def shingles(text: str | None, words: int) -> frozenset[bytes]:
    tokens = (text or "").encode().lower().split()
    return frozenset(b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (i, j) that make a least spanning forest by ``far``; ``label`` comes to name its trees."""
    order, taken = np.argsort(far, kind="stable"), []
    while True:
        order = order[label[i[order]] != label[j[order]]]
        if not len(order):
            return np.concatenate(taken) if taken else order
        best, rank = np.full(len(label), len(order)), np.arange(len(order))
        np.minimum.at(best, label[i[order]], rank)
        np.minimum.at(best, label[j[order]], rank)
        own = order[np.unique(best[best < len(order)])]
        taken.append(own)
        while (label[i[own]] != label[j[own]]).any():
            x, y = label[i[own]], label[j[own]]
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            label[:] = to[label]


class Tables:
    """The parts of sketches that anchors are chosen by: for each table 23 bits that are covered, and bits that must be equal."""

    def __init__(self, tables: int, exact: int, t: int, seed: int):
        rng = np.random.default_rng(seed)
        self.picks, self.exact, self.t = [rng.permutation(64 * LANES)[: GOLAY_N + exact] for _ in range(tables)], exact, t

    def words(self, bits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Covered and exact parts of sketches, given as rows of bits, in table k."""
        pick = self.picks[k]
        word = (bits[:, pick[:GOLAY_N]] << np.arange(GOLAY_N, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        more = (bits[:, pick[GOLAY_N:]] << np.arange(self.exact, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return word.astype(np.int64), more.astype(np.int64)

    @staticmethod
    def bits(raw: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * LANES), axis=1).astype(np.uint64)

    def met_before(self, a: np.ndarray, b: np.ndarray, table: np.ndarray, golay: GolayBlock) -> np.ndarray:
        """In how many tables before this one the two meet: the one with the lower home is at the other's too, or visits it."""
        x, y, out = self.bits(a.tobytes()), self.bits(b.tobytes()), np.zeros(len(a), np.int64)
        for k in range(len(self.picks) - 1):
            (v, p), (w, q) = self.words(x, k), self.words(y, k)
            h, g = golay.home(v)[0], golay.home(w)[0]
            out += (k < table) & (p == q) & (np.bitwise_count(golay.words[np.maximum(h, g)] ^ np.where(h < g, v, w)) <= GOLAY_R + self.t)
        return out


def _candidates(limit: int, sure: int, tables: Tables):
    """mapInArrow over rows (bucket, home, node, sketch, table) sorted by bucket, homes first.

    Of a bucket's pairs within ``limit`` bits, a least spanning forest. A pair is given by the first
    ``MEETINGS`` tables that it meets in, one within ``sure`` bits by the first alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(lanes: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
            step, kept = max(1, CELLS // (4 * len(lanes))), [np.zeros(0, np.int64)] * 3
            for at in range(0, homes, step):
                stop = min(at + step, homes)
                # two lanes turn nearly all pairs away: what they differ by alone is over the limit
                half = sum(np.bitwise_count(lanes[at:stop, None, k] ^ lanes[None, :, k]) for k in range(2))
                i, j = np.nonzero(half <= limit)
                i = i + at
                i, j = i[i != j], j[i != j]
                far = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64)
                near = far <= limit
                # the forest so far and the new pairs have a forest of all pairs
                i, j, far = (np.concatenate((x, y[near])) for x, y in zip(kept, (i, j, far), strict=True))
                own = _forest(np.arange(len(lanes)), i, j, far)
                kept = [i[own], j[own], far[own]]
            return kept[0], kept[1]

        golay = GolayBlock(tables.t)

        def work(bucket: np.ndarray, home: np.ndarray, node: np.ndarray, lanes: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(bucket)) + 1
            start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(bucket)]))
            homes = np.add.reduceat(home.astype(np.int64), start)
            two = (homes > 0) & (end - start == 2)  # most buckets: no loop for those
            p = start[two]
            near = np.bitwise_count(lanes[p] ^ lanes[p + 1]).sum(axis=1, dtype=np.int64) <= limit
            a, b = [p[near]], [p[near] + 1]
            more = (homes > 0) & (end - start > 2)
            for s, e, h in zip(start[more].tolist(), end[more].tolist(), homes[more].tolist(), strict=True):
                i, j = forest(lanes[s:e], h)
                if len(i):
                    a.append(s + i)
                    b.append(s + j)
            a, b = np.concatenate(a), np.concatenate(b)
            # close pairs meet in most tables; what joins them in the first one is as close, so there they are linked already
            far = np.bitwise_count(lanes[a] ^ lanes[b]).sum(axis=1, dtype=np.int64)
            met = [tables.met_before(lanes[a[k : k + 2048]], lanes[b[k : k + 2048]], table[a[k : k + 2048]], golay) for k in range(0, len(a), 2048)]
            own = np.concatenate([np.zeros(0, np.int64), *met]) < np.where(far <= sure, 1, MEETINGS)
            return pa.RecordBatch.from_arrays([pa.array(node[a[own]]), pa.array(node[b[own]])], names=["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64), np.zeros(0, np.int32)]
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, LANES)
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), raw, batch.column(4).to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield work(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        if len(held[0]):
            yield work(*held)
        release()

    return run


def _grid(rows: DataFrame, heavy: DataFrame, node: str) -> DataFrame:
    """``rows`` (bucket, home, node and more) with the buckets of ``heavy`` (bucket, parts) split into cells, as in ``links``."""
    if heavy.isEmpty():
        return rows
    columns = rows.columns
    rest = [F.col(c) for c in columns if c not in ("bucket", "home")]
    rows = rows.join(small_side(heavy), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(node), F.col("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = F.xxhash64("bucket", "r", "c")
    whole = rows.where("parts = 1").select(*columns)
    split = rows.where("parts > 1").withColumn("own", own.cast("int"))
    # each home stands at home in its row of the grid and visits its column; visitors only visit
    at_home = split.where("home").select("bucket", F.lit(True).alias("home"), *rest, F.col("own").alias("r"), F.explode(every).alias("c"))
    visits = split.select("bucket", F.lit(False).alias("home"), *rest, F.explode(every).alias("r"), F.col("own").alias("c"))
    return whole.unionByName(at_home.unionByName(visits).select(cell.alias("bucket"), "home", *rest))


# ---- the links that sketches miss: prefixes of the shingles in one order of all, and bounds that no link breaks

#: One text in this many tells which shingles are frequent; seen this often there, one comes late in the order; how many
#: are listed. These set the time that it takes, not the links that are found.
EVERY, OFTEN, MOST = 8, 8, 200_000
#: Parts of a set at most whose parities are kept.
PARTS = 1 << 16
#: Bytes of a shingle's hash that tell it from others until rows of shared ones are made; slots a partition that hashes are
#: dealt to; hashes dealt at a time.
LOW, SLOTS, DEALT = 5, 8, 1 << 19
#: Rows of a bucket up to which all buckets are compared together, row by row at a growing distance.
SMALL = 64


def least_overlap(sizes, similarity: float):
    """Common elements that two sets of ``sizes`` elements in all have at least, if their Jaccard similarity is ``similarity``."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-6).astype(np.int64)


class Order:
    """One order of all shingles: by their hash, frequent ones last, the rarest of these first."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        by_value = np.argsort(values)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        self.values, self.rank = values[by_value], rank[by_value]

    def late(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``some`` are frequent; the ranks of these."""
        if not len(self.values):
            return np.zeros(len(some), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, some), len(self.values) - 1)
        late = self.values[at] == some
        return late, self.rank[at[late]]

    def sort(self, some: np.ndarray) -> np.ndarray:
        """``some``, ascending by value, in this order."""
        late, rank = self.late(some)
        return np.concatenate((some[~late], some[late][np.argsort(rank)]))


def marks(hashes: np.ndarray, similarity: float, order: Order) -> tuple[bytes, bytes]:
    """Of a set of shingles: its size and the parities of parts of it, about as many as shingles; its first ones in the order.

    Of two sets with at least this similarity, each has a common element among its first
    ``size - ceil(similarity * size) + 1``, as fewer are left behind these than must be common.
    """
    own = np.unique(hashes)
    parts = min(max(64 * LANES, 1 << max(0, len(own) - 1).bit_length()), PARTS)
    parity = np.packbits(np.bincount((own & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).view(np.uint64)
    first = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1 if len(own) else 0
    return np.concatenate((np.array([len(own)], np.uint64), parity)).tobytes(), order.sort(own)[:first].tobytes()


def folded(parity: np.ndarray, lanes: int) -> np.ndarray:
    """The parities of fewer, larger parts."""
    return np.bitwise_xor.reduce(parity.reshape(-1, lanes), axis=0)


def _frequent(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """bucket, n: shingles that ``OFTEN`` or more of one in ``EVERY`` texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held = [np.unique(shingle_hashes(x, words, seed)) for x in batch.column(0).slice(at, 256).to_pylist()]
                value, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["bucket", "n"])

    some = texts.where(F.pmod(F.xxhash64("digest"), F.lit(EVERY)) == 0).select("text")
    counts = some.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return cut(counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "bucket").limit(MOST))


def _unlinked(similarity: float):
    """mapInArrow over rows (bucket, home, node, root, size, rest and parities) sorted by bucket, homes first.

    All pairs of nodes with different roots that may be as similar as that: behind the first element that
    they share there are enough others in both, and no more parts of odd difference than they may differ in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(bucket, home, node, root, size, rest, lanes) -> pa.RecordBatch:
            def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                own = root[i] != root[j]
                i, j = i[own], j[own]
                both = size[i] + size[j]
                least = least_overlap(both, similarity)
                own = np.minimum(rest[i], rest[j]) >= least
                i, j, most = i[own], j[own], (both - 2 * least)[own]
                own = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64) <= most
                return i[own], j[own]

            edge = np.flatnonzero(np.diff(bucket)) + 1
            start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(bucket)]))
            left = np.repeat(end, end - start) - np.arange(len(bucket))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            p, away = np.flatnonzero(home & np.repeat(end - start <= SMALL, end - start)), 0
            while len(p):
                away += 1
                p = p[left[p] > away]
                found.append(may(p, p + away))
            for s, e in zip(*(x[end - start > SMALL].tolist() for x in (start, end)), strict=True):
                names, name = np.unique(root[s:e], return_inverse=True)
                most = name == np.bincount(name).argmax()  # of the largest group no two are compared
                homes = np.flatnonzero(home[s:e])
                for a, b in ((homes[~most[homes]], np.arange(e - s)), (homes[most[homes]], np.flatnonzero(~most))):
                    step = max(1, CELLS // (8 * max(1, len(b))))
                    for at in range(0, len(a) if len(b) else 0, step):
                        i, j = (x.ravel() for x in np.broadcast_arrays(a[at : at + step, None], b[None, :]))
                        found.append(may(s + i, s + j))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            new = [*c[:4], c[4].astype(np.int64), c[5].astype(np.int64), np.stack(c[6:], axis=1).view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            done = int(np.searchsorted(held[0], held[0][-1]))
            if done:
                yield work(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        if held:
            yield work(*held)
        release()

    return run


def _pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows with at most ``most`` elements each, or one row with more."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, stop))
        at = stop
    return out


def _deal(slots: int, order: Order):
    """mapInArrow over rows (node, root, shingles): of each slot the low bytes of all but frequent shingles, their nodes, and the roots that are other nodes.

    One row holds those of many texts: first the shingles of nodes that are roots, then the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = (batch.column(k).to_numpy() for k in range(2))
            held = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            for low, high in _pieces(np.array([len(x) for x in held], np.int64), DEALT):
                own = np.concatenate(held[low:high])
                row = np.repeat(np.arange(low, high), [len(x) for x in held[low:high]])
                rare = ~order.late(own)[0]
                own, row = own[rare], row[rare]
                if not len(own):
                    continue
                slot, other = ((own >> np.uint64(8 * LOW)) % np.uint64(slots)).astype(np.int64), node[row] != root[row]
                by = np.argsort(2 * slot + other, kind="stable")
                own, row, slot, other = own[by], row[by], slot[by], other[by]
                start = np.concatenate(([0], np.flatnonzero(np.diff(slot)) + 1))
                end = np.concatenate((start[1:], [len(slot)]))
                some, first = row[other], np.concatenate(([0], np.cumsum(other)))
                short = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW])
                columns = [[x[s:e].tobytes() for s, e in zip(start, end, strict=True)] for x in (short, node[row])]
                columns.append([root[some[first[s] : first[e]]].tobytes() for s, e in zip(start, end, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(slot[start]), *(pa.array(x, pa.binary()) for x in columns)], names=["slot", "low", "nodes", "roots"])
        release()

    return run


def _common():
    """mapInArrow over the rows of ``_deal`` sorted by slot: node, low of what nodes of two roots or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            node = np.frombuffer(b"".join(x[1] for x in rows), np.int64)
            low = np.zeros((len(node), 8), np.uint8)
            low[:, :LOW] = np.frombuffer(b"".join(x[0] for x in rows), np.uint8).reshape(-1, LOW)
            low, root, at = low.view("<u8").ravel().astype(np.int64), node.copy(), 0
            for _, nodes, roots in rows:
                at += len(nodes) // 8
                root[at - len(roots) // 8 : at] = np.frombuffer(roots, np.int64)
            by = np.argsort(low, kind="stable")
            low, node, root = low[by], node[by], root[by]
            start = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1))
            many = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            own = np.repeat(many, np.diff(np.concatenate((start, [len(low)]))))
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(low[own])], names=["node", "low"])

        slot, held = None, []
        for batch in batches:
            for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != slot and held:
                    yield work(held)
                    held = []
                slot = now
                held.append(row)
        if held:
            yield work(held)
        release()

    return run


def _across(placed: DataFrame, frequent: DataFrame, order: Order, similarity: float, partitions: int) -> DataFrame:
    """a, b: every pair of nodes in different groups of ``placed`` (node, root, parity, shingles) that may be linked.

    Most shingles stand in one group alone. A few bytes of each tell which; only of the others are rows made.
    """
    names = ["bucket", "home", "node", "root", "size", "rest", *(f"lane{k}" for k in range(LANES))]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, held = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            for low, high in _pieces(np.array([len(x) for x in held], np.int64), DEALT):
                row, value, rest = [], [], []
                for k, also in zip(range(low, high), batch.column(4).slice(low, high - low), strict=True):
                    own = order.late(held[k])[0]
                    if also.is_valid:
                        own |= np.isin((held[k] & np.uint64((1 << 8 * LOW) - 1)).view(np.int64), also.values.to_numpy())
                    own = np.flatnonzero(own)
                    row.append(np.full(len(own), k))
                    value.append(held[k][own])
                    rest.append(int(seen[k][0]) - own)
                row = np.concatenate(row)
                size, lanes = np.array([x[0] for x in seen]).astype(np.int32)[row], np.stack([folded(x[1:], LANES) for x in seen]).view(np.int64)[row]
                take = pa.array(row)
                columns = [pa.array(np.concatenate(value).view(np.int64)), pa.array(np.ones(len(row), bool)), batch.column(0).take(take), batch.column(1).take(take), pa.array(size), pa.array(np.concatenate(rest).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(lanes[:, k].copy()) for k in range(LANES)], names=names)
        release()

    some = placed.select("node", "root", "shingles").mapInArrow(_deal(SLOTS * partitions, order), "slot long, low binary, nodes binary, roots binary")
    common = some.repartition(partitions, "slot").sortWithinPartitions("slot").mapInArrow(_common(), "node long, low long")
    common = cut(common.groupBy("node").agg(F.collect_list("low").alias("also")))
    _let_go(placed.sparkSession)
    schema = "bucket long, home boolean, node long, root long, size int, rest int, " + ", ".join(f"{x} long" for x in names[6:])
    parts = F.ceil(F.col("n") * EVERY / HEAVY).cast("int")
    heavy = cut(frequent.select("bucket", parts.alias("parts")).where("parts > 1"))
    placed = placed.join(small_side(common), "node", "left").select("node", "root", "parity", "shingles", "also")
    rows = _grid(placed.mapInArrow(emit, schema), heavy, "node")
    dealt = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.desc("home"))
    return cut(dealt.mapInArrow(_unlinked(similarity), "a long, b long").distinct())


def _with_ends(pairs: DataFrame, held: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``value`` of both as x and y; ``held`` has node, uses (in pairs) and it."""
    n = pairs.count()
    for end, name in (("b", "y"), ("a", "x")):
        pairs = join_hot(pairs, held.select(F.col("node").alias(end), "uses", F.col(value).alias(name)), end, "uses", n)
    return pairs.select("a", "b", "x", "y")


def _uses(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("uses"))


def _bounded(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets' parities don't show that they differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both, lanes = int(x[0]) + int(y[0]), min(len(x), len(y)) - 1
                odd = int(np.bitwise_count(folded(x[1:], lanes) ^ folded(y[1:], lanes)).sum(dtype=np.int64))
                good.append(odd <= both - 2 * int(least_overlap(both, similarity)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        release()

    held = cut(nodes.join(_uses(pairs), "node").select("node", "uses", "parity"))
    return cut(_with_ends(pairs, held, "parity").mapInArrow(run, "a long, b long"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, total: int, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' shingles have a Jaccard similarity of ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, frozenset] = {}
            good = []
            for at in range(0, batch.num_rows, 256):
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if a not in held:
                        held = {a: shingles(x, words)}  # rows of one hub mostly stand together
                    good.append(jaccard(held[a], shingles(y, words)) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        release()

    wanted = small_side(cut(nodes.join(_uses(pairs), "node").select("node", "digest", "uses")), BROADCAST_DIGESTS)
    # one text stands for a node: that of the digest that names it
    found = cut(docs.join(wanted, "digest").groupBy("node", "uses").agg(F.first("text").alias("text")))
    return cut(_with_ends(pairs, found, "text").mapInArrow(run, "a long, b long"))


def _let_go(spark) -> None:
    """Have the shuffles of jobs that are done deleted: the context does so when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _groups(docs: DataFrame, words: int, similarity: float, t: int, seed: int, key: str, text: str) -> DataFrame:
    """doc_id, digest (of the text), component_id, first (the row that stands for the group) for each row.

    Sketches link most of a group at little cost; every pair of what they leave in different groups that can
    be linked at all is compared then, so no link is lost.
    """
    texts = docs.select(F.col(key).alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    frequent = _frequent(texts, words, seed)
    listed = frequent.toArrow()
    order = Order(listed["bucket"].to_numpy().view(np.uint64), listed["n"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(2).to_pylist()
            both = [xxhash.xxh3_128_digest(b" ".join((x or "").encode().lower().split()), seed) for x in some]
            node, check = np.frombuffer(b"".join(both), ">i8").astype(np.int64).reshape(-1, 2).T
            columns = [batch.column(0), batch.column(1), pa.array(node.copy()), pa.array(check.copy())]
            if whole:
                seen = [(sketch(h), *marks(h, similarity, order)) for h in (shingle_hashes(x, words, seed) for x in some)]
                columns += [pa.array([x[k] for x in seen], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
        release()

    names = ["doc_id", "digest", "node", "check", "sketch", "parity", "shingles"]
    types = [docs.schema[key].dataType, T.StringType(), T.LongType(), T.LongType(), T.BinaryType(), T.BinaryType(), T.BinaryType()]
    fields = [T.StructField(name, kind) for name, kind in zip(names, types, strict=True)]
    prints = cut(texts.mapInArrow(run, T.StructType(fields[:4])))
    # rows of the same words are one node; should others share its number, by chance, they stay by themselves
    first = F.min(F.struct("check", F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    nodes = texts.mapInArrow(lambda batches: run(batches, True), T.StructType(fields)).groupBy("node").agg(F.min_by(F.struct(*names[4:]), "check").alias("seen"), first.alias("first"), F.count("*").alias("n"))
    nodes = cut(nodes.select("node", "seen.*", "first", "n", F.col("first.digest").alias("digest")))
    _let_go(docs.sparkSession)
    n_nodes, total = nodes.count(), prints.count()
    tables = Tables(*plan_tables(n_nodes, similarity, t), t, seed)
    p = differing_share(similarity)
    limit, sure = (round(64 * LANES * p + by * (64 * LANES * p * (1 - p)) ** 0.5) for by in (SPREAD, -SURE))

    def emit(batches: Iterator[pa.RecordBatch], some: range, visit: bool = True) -> Iterator[pa.RecordBatch]:
        golay, n = GolayBlock(t), len(tables.picks)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                node, raw = batch.column(0), batch.column(1)
                bits = tables.bits(b"".join(raw.to_pylist()))
                for k in some:
                    word, more = tables.words(bits, k)
                    if not visit:
                        yield pa.RecordBatch.from_arrays([pa.array(((more * 4096) + golay.home(word)[0]) * n + k)], names=["bucket"])
                        continue
                    home, row, anchor = cover(word, 1, t, golay)
                    rows = np.concatenate((np.arange(len(node)), row))
                    name = ((more[rows] * 4096) + np.concatenate((home, anchor))) * n + k
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.arange(len(rows)) < len(node)), node.take(take), raw.take(take), pa.array(np.full(len(rows), k, np.int32))], names=["bucket", "home", "node", "sketch", "table"])

    some, every = nodes.select("node", "sketch"), range(len(tables.picks))
    at_home = some.mapInArrow(lambda batches: emit(batches, every, False), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    heavy = cut(at_home.where(F.col("n") > HEAVY).select("bucket", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_nodes * len(tables.picks) // 100_000)

    def met(now: range) -> DataFrame:
        rows = _grid(some.mapInArrow(lambda batches: emit(batches, now), "bucket long, home boolean, node long, sketch binary, table int"), heavy, "node")
        dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("home"))
        pairs = dealt.mapInArrow(_candidates(limit, sure, tables), "a long, b long")
        return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    pairs = None
    for at in range(0, len(every), AT_ONCE):
        new = met(every[at : at + AT_ONCE])
        pairs = new if pairs is None else pairs.unionByName(new)
        _let_go(docs.sparkSession)
    roots = components(_confirmed(cut(pairs.distinct()), nodes, texts, total, words, similarity))
    _let_go(docs.sparkSession)
    placed = nodes.join(small_side(roots, BROADCAST_DIGESTS), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "parity", "shingles")
    across = _across(placed, frequent, order, similarity, n)
    _let_go(docs.sparkSession)
    missed = _confirmed(_bounded(across, nodes, similarity), nodes, texts, total, words, similarity)
    if not missed.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed))
    named = nodes.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    lowest = F.min(F.struct(F.col("first.no_id").alias("no_id"), F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest")))
    groups = named.groupBy("root").agg(lowest.alias("lowest"), F.count("*").alias("members"))
    known = cut(join_hot(cut(named), groups, "root", "members", n_nodes).select("node", "n", F.col("first.check").alias("of"), "lowest"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    out = join_hot(prints, known, "node", "n", total).withColumn("first", F.when(F.col("check") == F.col("of"), F.col("lowest")).otherwise(own))
    return out.select("doc_id", "digest", F.col("first.doc_id").alias("component_id"), "first")


def _digest(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def similar_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, t: int = 2, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id for each row: groups linked by shingles with a Jaccard similarity of ``similarity`` or more."""
    return _groups(docs, words, similarity, t, seed, key, text).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, t: int = 2, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``: the one of the least id (a null id comes last), then of the least digest.

    Rows are told by id and text together, so rows of other texts under the same id, or under none,
    are documents of their own; of rows with the same id and the same text one stays.
    """
    groups = cut(_groups(docs, words, similarity, t, seed, key, text))
    row = [F.col("doc_id").alias("row_id"), F.col("digest").alias("row_digest")]
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    gone = groups.where(~is_first).select(*row).distinct()
    again = cut(groups.where(is_first).groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select("row_id", "row_digest"))
    _let_go(docs.sparkSession)

    def same(some: DataFrame):
        return F.col(key).eqNullSafe(some["row_id"]) & (_digest(text) == some["row_digest"])

    kept = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same(again), "left_semi").withColumn("row_digest", _digest(text)).dropDuplicates([key, "row_digest"]).drop("row_digest")
    return kept.join(again, same(again), "left_anti").unionByName(repeated)
