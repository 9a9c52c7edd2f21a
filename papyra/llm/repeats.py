"""Repeated substrings by a sparse enhanced suffix array and its tree of common-prefix intervals.

A string of ``n`` bytes is repeated if it also starts earlier, in a smaller document or before in the
same one; each byte under a repeated string goes. Sorting all suffixes of a corpus is out of reach, so
suffixes are sorted at anchors only: every n-byte window has one anchor, the least-hashed q-gram in it
(leftmost of equals). Equal windows have equal anchors at equal offsets, so they are found among the
contexts of one anchor:

1. Batches of documents report the distinct q-grams of their anchors; buckets of q-grams answer which
   occur twice or more. Windows of all other anchors are unique.
2. Batches send the contexts of repeated anchors, each distinct one once, to the anchor's bucket.
   There the suffixes that start at the anchors are sorted with their common-prefix lengths, and a
   stack scan gives the intervals of that array, each a set of contexts with the bytes to the right in
   common. Left-extension diversity is tested inside each: contexts that share as many bytes to the
   left, and differ in the byte before those, are a maximal repeat group with all its contexts
   (``repeat_groups``). Of a group, all occurrences but the first go; what a group can't extend over
   is left to the groups of other anchors, so the repeats of all anchors together cover every window.
3. Batches learn which windows came first and keep them; other windows of repeated anchors go. Or, in
   ``maximal_repeats``, they learn the groups of their contexts and list all occurrences.

An anchor with more than ``HEAVY`` occurrences is not gathered in a bucket: each of its windows is a
group of its own, spread by a digest and compared by its bytes, and batches have already reduced each
to its least occurrence. So a passage in a third of all documents costs no task more than another.
Nothing is dropped for size, and both ways give the same windows.

Defined results: null text counts as empty; ids are integers; a null id comes after all others; rows
of one id, or of none, follow each other in the order of a digest of their texts; texts shorter than n
bytes stay whole and are not shuffled; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release

#: Bytes of an anchor's q-gram; text bytes of a batch, about; bytes looked at together; occurrences of an anchor that one bucket takes.
Q, BATCH_BYTES, PART, HEAVY = 24, 3_000_000, 1_000_000, 30_000
#: Bits of a position in the sliding minimum; longer texts are read in pieces.
PLACE = 24

MESSAGE = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in "abcdef")])
DISTINCT, CONTEXT, WINDOW, DEFAULT, REPEATED, FIRST, GROUP = range(7)
WHOLE_WINDOW = -1  # in place of the bytes to the left: the place is a window's start
#: Where a document stands among all: null ids last, then the id, then the digest of the text.
PLACE_KEY = np.dtype([("late", "<u1"), ("id", "<i8"), ("digest", "<i8"), ("doc", "<i4"), ("at", "<i8")])


def _words(buf: np.ndarray, at: np.ndarray | slice, offset: int) -> np.ndarray:
    view = np.ndarray((len(buf) - 7,), np.uint64, buf, 0, (1,))
    return view[offset : offset + at.stop] if isinstance(at, slice) else view[at + offset]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of the Q bytes at each of the first n places."""
    out = np.zeros(n, np.uint64)
    for k in range(0, Q, 8):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + _words(buf, slice(0, n), k))
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts in ``buf``: first and last window start of each anchor, its place, its hash; in the order of the text."""
    a, reach = 0, width - Q + 1
    while a < len(starts):
        b, size = a, 0
        while b < len(starts) and (b == a or size + lengths[b] <= PART):
            size += lengths[b]
            b += 1
        base, stop = int(starts[a]), int(starts[b - 1] + lengths[b - 1])
        for lo in range(base, max(base + 1, stop - width + 1), (1 << PLACE) - width):
            hi = min(stop, lo + (1 << PLACE) - 1)
            n = hi - lo - width + 1
            if n <= 0:
                continue
            piece = np.concatenate((buf[lo:hi], np.zeros(8, np.uint8)))
            h = _grams(piece, hi - lo - Q + 1)
            low = ((h >> np.uint64(PLACE)) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= reach:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
            place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)[:n]
            # windows that would leave their text have none
            inside = np.zeros(n + 1, np.int64)
            s, e = np.maximum(starts[a:b] - lo, 0), np.minimum(starts[a:b] + lengths[a:b] - width + 1 - lo, n)
            ok = e > s
            np.add.at(inside, s[ok], 1)
            np.add.at(inside, e[ok], -1)
            text = np.zeros(n, np.int64)
            np.add.at(text, s[ok], 1)
            live, text = np.cumsum(inside[:-1]) > 0, np.cumsum(text)
            at = np.flatnonzero(live)
            if not len(at):
                continue
            p = place[at]
            cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(at) != 1) | (np.diff(text[at]) != 0)) + 1
            first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
            q = place[first]
            yield first + lo, last + lo, q + lo, (h[q] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
        a = b


def interval_tree(lcp: np.ndarray, zero: bool = False) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a suffix array, by one stack scan.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1. Inner intervals come before outer ones;
    the one of depth 0 only with ``zero``.
    """
    out, stack = [], [(0, 0)]
    for i, depth in enumerate([*lcp.tolist(), -1]):
        left = i
        while stack and stack[-1][0] > depth:
            top, left = stack.pop()
            out.append((top, left, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return [x for x in out if x[2] > x[1] and (x[0] > 0 or zero and not lcp.all())]


def _common(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Common prefix of each two rows, ``n`` at most."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 16384):
        differ = x[at : at + 16384] != y[at : at + 16384]
        out[at : at + 16384] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(out, n)


def _sorted(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows, and the common prefix of each with the next in that order."""
    order = np.lexsort((size, np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()))
    i, j = order[:-1], order[1:]
    return order, _common(rows[i], rows[j], np.minimum(size[i], size[j]))


def repeat_groups(ctx: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Maximal repeat groups of contexts, which come in the order of their occurrence.

    ``left`` is the anchor's offset in its context. Returns, for each context, the first one equal to
    it, and groups (bytes shared to the left, to the right of the anchor, the different contexts that
    share them), ``width`` bytes long or more, each extended to both sides as far as all its members agree.
    """
    n, most = len(start), width - Q
    pad = np.concatenate((np.zeros(most, np.uint8), ctx, np.zeros(width, np.uint8)))
    at, room = start + left + most, size - left
    right = pad[at[:, None] + np.arange(width)]
    right[np.arange(width) >= room[:, None]] = 0
    back = pad[at[:, None] - 1 - np.arange(most)]
    back[np.arange(most) >= left[:, None]] = 0

    def neighbours(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order and common prefixes; the number of each row's class of equals; its longest common prefix with any other."""
        order, lcp = _sorted(rows, length)
        same = (lcp == length[order[:-1]]) & (lcp == length[order[1:]])
        number, best = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same)))
        best[order[:-1]] = lcp
        best[order[1:]] = np.maximum(best[order[1:]], lcp)
        return order, lcp, number, best

    _, _, same_r, _ = neighbours(right, room)
    _, _, same_l, _ = neighbours(back, left)
    _, one, inverse = np.unique(same_r * n + same_l, return_index=True, return_inverse=True)
    first, own = one[inverse.ravel()], np.sort(one)
    # most anchors meet by a common phrase alone: leave out contexts that share too little with any other
    for _ in range(2):
        if len(own) < 2:
            break
        _, _, _, best_r = neighbours(right[own], room[own])
        _, _, _, best_l = neighbours(back[own], left[own])
        near = best_r + best_l >= width
        if near.all():
            break
        own = own[near]
    if len(own) < 2:
        return first, []
    order, lcp = _sorted(right[own], room[own])
    order, groups = own[order], []
    tree = [x for x in interval_tree(lcp) if x[0] + most >= width]
    pairs = [(b, lo) for b, lo, hi in tree if hi == lo + 1]
    if pairs:
        b, lo = np.array(pairs).T
        i, j = order[lo], order[lo + 1]
        a = _common(back[i], back[j], np.minimum(left[i], left[j]))
        for k in np.flatnonzero(a + b >= width):
            groups.append((int(a[k]), int(b[k]), np.sort(np.array((i[k], j[k])))))
    for b, lo, hi in tree:
        if hi == lo + 1:
            continue
        some = order[lo : hi + 1]
        # the parts of the interval that share more than ``b`` bytes: a group within one of them extends further to the right
        part = np.concatenate(([0], np.cumsum(lcp[lo:hi] <= b)))
        by_left, shared = _sorted(back[some], left[some])
        for a, low, high in interval_tree(shared, zero=True):
            if a + b >= width:
                inside = by_left[low : high + 1]
                if part[inside].min() != part[inside].max():
                    groups.append((a, b, np.sort(some[inside])))
    return first, groups


def first_windows(n: int, first: np.ndarray, groups: list[tuple[int, int, np.ndarray]], left: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Matrix (context, left reach): the window has no equal in an earlier context."""
    most = width - Q
    gone = np.zeros((n, most + 2), np.int32)
    if groups:
        row = np.concatenate([members[1:] for _, _, members in groups])  # all but the group's first
        many = [len(members) - 1 for _, _, members in groups]
        np.add.at(gone, (row, np.repeat([max(0, width - b) for _, b, _ in groups], many)), 1)
        np.add.at(gone, (row, np.repeat([a + 1 for a, _, _ in groups], many)), -1)
    reach = np.arange(most + 1)
    valid = (reach <= left[:, None]) & (width - reach <= (size - left)[:, None])
    return valid & (np.cumsum(gone, axis=1)[:, :-1] == 0) & (first == np.arange(n))[:, None]


def _message(bucket: int, batch: int, kind: int, *fields: np.ndarray | bytes) -> tuple:
    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in fields]
    return (bucket, batch, kind, *raw, *[b""] * (6 - len(raw)))


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=MESSAGE.names)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edge) if len(order) else []:
        yield int(bucket[part[0]]), part


class Batch:
    """A batch's documents in order, their texts as one buffer."""

    def __init__(self, docs: pa.Table):
        names = ["late", "doc_id", "digest"]
        if docs.num_rows:
            docs = docs.take(pc.sort_indices(docs.select(names), sort_keys=[(c, "ascending") for c in names]))
        self.ids, text = docs.column("doc_id").combine_chunks(), docs.column("text").cast(pa.large_string()).combine_chunks()
        text = text if not isinstance(text, pa.ChunkedArray) else pa.concat_arrays(text.chunks)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2] if len(text) else None
        self.buf = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.starts, self.lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        self.late = docs.column("late").to_numpy().astype(np.uint8)
        self.order = pc.fill_null(docs.column("doc_id"), 0).to_numpy(), docs.column("digest").to_numpy()

    def doc(self, at: np.ndarray) -> np.ndarray:
        """Document number of text places; documents without text hold none."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def places(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where text places stand among those of all batches."""
        out = np.empty(len(doc), PLACE_KEY)
        out["late"], out["id"], out["digest"], out["doc"], out["at"] = self.late[doc], self.order[0][doc], self.order[1][doc], doc, at
        return out


def _fields(sent: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in sent.column(column).to_pylist()])


def _senders(sent: pa.Table, column: str, kind) -> np.ndarray:
    return np.repeat(sent.column("batch").to_numpy(), [len(x) // np.dtype(kind).itemsize for x in sent.column(column).to_pylist()])


def _by_place(place: np.ndarray) -> np.ndarray:
    return np.lexsort([place[c] for c in reversed(PLACE_KEY.names)])


class Rounds:
    """The rounds that tell batches what their anchors' contexts share with those of all other batches."""

    def __init__(self, docs: DataFrame, width: int, key: str, text: str, heavy: int, batch_bytes: int):
        if width < Q + 8:
            raise ValueError(f"width is {Q + 8} at least")
        if not isinstance(docs.schema[key].dataType, T.IntegralType):
            raise ValueError(f"{key} is no column of integers")
        content = F.coalesce(F.col(text), F.lit(""))
        every = docs.select(F.col(key).cast("long").alias("doc_id"), content.alias("text"))
        self.short = every.where(F.octet_length("text") < width)
        long = every.where(F.octet_length("text") >= width)
        size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.width, self.heavy, self.n = width, heavy, max(1, -(-size // batch_bytes))
        # documents are dealt by id and text, so that no id that many rows have makes a batch
        self.own = long.withColumns({"late": F.col("doc_id").isNull().cast("byte"), "digest": F.xxhash64("text"), "batch": F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n))})
        reported = self.own.groupBy("batch").applyInArrow(lambda key, docs: self.report(key, docs), MESSAGE)
        self.answered = reported.groupBy("bucket").applyInArrow(lambda key, sent: self.answer(key, sent), MESSAGE)
        self.sent = self.own.groupBy("batch").cogroup(self.answered.groupBy("batch")).applyInArrow(lambda key, docs, told: self.send(key, docs, told), MESSAGE)

    def __getstate__(self) -> dict:
        return {"width": self.width, "heavy": self.heavy, "n": self.n}  # tables stay with the driver

    def report(self, key: tuple, docs: pa.Table) -> pa.Table:
        release()
        b, batch = Batch(docs), key[0].as_py()
        found = [h for _, _, _, h in anchors(b.buf, b.starts, b.lengths, self.width)]
        if not found:
            return _table([])
        names, count = np.unique(np.concatenate(found), return_counts=True)
        bucket = (names % np.uint64(self.n)).astype(np.int64)
        return _table([_message(k, batch, DISTINCT, names[i], np.minimum(count[i], 2**31 - 1).astype(np.uint32)) for k, i in _by_bucket(bucket)])

    def answer(self, key: tuple, sent: pa.Table) -> pa.Table:
        release()
        lists = [np.frombuffer(x, np.uint64) for x in sent.column("a").to_pylist()]
        counts = _fields(sent, "b", np.uint32).astype(np.int64)
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        out, at = [], 0
        for batch, names in zip(sent.column("batch").to_pylist(), lists, strict=True):
            t = total[at : at + len(names)]
            at += len(names)
            if (t > 1).any():
                out.append(_message(0, batch, REPEATED, names[(t > 1) & (t <= self.heavy)], names[t > self.heavy]))
        return _table(out)

    def contexts(self, b: Batch, told: pa.Table) -> tuple[dict, list[np.ndarray], list[np.ndarray]]:
        """Contexts of repeated anchors, (bytes, anchor's offset) to places (hash, first, last, anchor); windows of heavy ones; runs of both."""
        light, dense = (np.sort(_fields(told, c, np.uint64)) for c in "ab")
        raw, seen, spread, runs = b.buf.tobytes(), {}, [], []
        for first, last, place, name in anchors(b.buf, b.starts, b.lengths, self.width):
            is_light, is_dense = np.isin(name, light), np.isin(name, dense)
            either = is_light | is_dense
            runs.append(np.stack((first[either], last[either])))
            for f, e, p, h in zip(first[is_light].tolist(), last[is_light].tolist(), place[is_light].tolist(), name[is_light].tolist(), strict=True):
                seen.setdefault((raw[f : e + self.width], p - f), []).append((h, f, e, p))
            n = last[is_dense] - first[is_dense] + 1
            spread.append(np.repeat(first[is_dense], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return seen, spread, runs

    def send(self, key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        release()
        if not docs.num_rows or not told.num_rows:
            return _table([])
        b, batch, width, out = Batch(docs), key[0].as_py(), self.width, []
        seen, spread, runs = self.contexts(b, told)
        if seen:
            h, f, e, p = (np.array(x) for x in zip(*(places[0] for places in seen.values()), strict=True))
            texts = [t for t, _ in seen]
            del seen
            doc = b.doc(f)
            place = b.places(doc, p - b.starts[doc])
            for k, i in _by_bucket((h.astype(np.uint64) % np.uint64(self.n)).astype(np.int64)):
                out.append(_message(k, batch, CONTEXT, place[i], (p[i] - f[i]).astype(np.int32), (e[i] - f[i] + width).astype(np.int32), b"".join([texts[x] for x in i.tolist()])))
            del texts
        s = np.concatenate(spread)
        if len(s):
            raw = b.buf.tobytes()
            firsts: dict[bytes, int] = {}
            for at in s.tolist():
                firsts.setdefault(raw[at : at + width], at)
            s = np.fromiter(firsts.values(), np.int64, len(firsts))
            doc = b.doc(s)
            place, content = b.places(doc, s - b.starts[doc]), list(firsts)
            for k, i in _by_bucket(np.array([xxhash.xxh64_intdigest(w) % self.n for w in content], np.int64)):
                out.append(_message(k, batch, WINDOW, place[i], b"".join([content[x] for x in i.tolist()])))
        r = np.concatenate(runs, axis=1)
        if r.shape[1]:
            joined = np.concatenate(([True], (r[0, 1:] != r[1, :-1] + 1) | (b.doc(r[0, 1:]) != b.doc(r[0, :-1]))))
            at = np.flatnonzero(joined)
            lo, hi = r[0, at], r[1, np.append(at[1:] - 1, r.shape[1] - 1)]
            doc = b.doc(lo)
            out.append(_message(batch % self.n, batch, DEFAULT, doc.astype(np.int32), lo - b.starts[doc], hi - b.starts[doc]))
        return _table(out)

    def grouped(self, sent: pa.Table) -> tuple:
        """Contexts of a bucket in the order of their occurrence, and the groups they make."""
        place, left, size = _fields(sent, "a", PLACE_KEY), _fields(sent, "b", np.int32).astype(np.int64), _fields(sent, "c", np.int32).astype(np.int64)
        batch = _senders(sent, "a", PLACE_KEY)
        text, start = np.frombuffer(b"".join(sent.column("d").to_pylist()), np.uint8), np.cumsum(size) - size
        order = _by_place(place)
        place, left, size, batch, start = place[order], left[order], size[order], batch[order], start[order]
        return (place, left, size, batch, start, text, *repeat_groups(text, start, size, left, self.width))

    @staticmethod
    def window_classes(sent: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, batches and texts of heavy anchors' windows by text, then place; and where a new text begins."""
        place, batch = _fields(sent, "a", PLACE_KEY), _senders(sent, "a", PLACE_KEY)
        text = np.frombuffer(b"".join(sent.column("b").to_pylist()), np.uint8).reshape(-1, width)
        order = _by_place(place)
        order = order[np.argsort(text[order].view(f"S{width}").ravel(), kind="stable")]
        text = text[order]
        return place[order], batch[order], text, np.concatenate(([True], (text[1:] != text[:-1]).any(axis=1)))

    def decide(self, key: tuple, sent: pa.Table) -> pa.Table:
        release()
        kinds, out = sent.column("kind").to_numpy(), []
        own = sent.filter(pa.array(kinds == DEFAULT))
        out += [(0, *r[1:]) for r in zip(*(own.column(c).to_pylist() for c in MESSAGE.names), strict=True)]
        ctx = sent.filter(pa.array(kinds == CONTEXT))
        if ctx.num_rows:
            place, left, size, batch, _, _, first, groups = self.grouped(ctx)
            kept = first_windows(len(place), first, groups, left, size, self.width)
            edge = np.diff(np.pad(kept, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, a_from = np.nonzero(edge == 1)
            _, a_to = np.nonzero(edge == -1)
            doc, at = place["doc"][row], place["at"][row]  # window starts at - a, for a from a_from to a_to - 1
            for k, i in _by_bucket(batch[row]):
                out.append(_message(0, k, FIRST, doc[i], at[i] - a_to[i] + 1, at[i] - a_from[i]))
        win = sent.filter(pa.array(kinds == WINDOW))
        if win.num_rows:
            place, batch, _, new = self.window_classes(win, self.width)
            place, batch = place[new], batch[new]
            for k, i in _by_bucket(batch):
                doc, at = place["doc"][i], place["at"][i].copy()
                out.append(_message(0, k, FIRST, doc, at, at))
        return _table(out)

    def list_groups(self, key: tuple, sent: pa.Table) -> pa.Table:
        """To the batch of each context: the groups it is in, as digest, bytes to the left and length."""
        release()
        kinds, out = sent.column("kind").to_numpy(), []
        ctx = sent.filter(pa.array(kinds == CONTEXT))
        if ctx.num_rows:
            place, left, size, batch, start, text, first, groups = self.grouped(ctx)
            equal: dict[int, list[int]] = {}
            for i, f in enumerate(first.tolist()):
                equal.setdefault(f, []).append(i)
            rows, names, lefts, sizes = [], [], [], []
            # occurrences of one context are a group too; one that occurs once is left out when occurrences are counted
            alone = [(int(left[f]), int(size[f] - left[f]), np.array([f])) for f in equal]
            for a, b, members in [*alone, *groups]:
                f = members[0]
                at = start[f] + left[f]
                digest = hashlib.blake2b(text[at - a : at + b].tobytes(), digest_size=16).digest()
                for m in members.tolist():
                    for i in equal[m]:
                        rows.append(i)
                        names.append(digest)
                        lefts.append(a)
                        sizes.append(a + b)
            rows, lefts, sizes, names = np.array(rows), np.array(lefts, np.int64), np.array(sizes, np.int64), np.frombuffer(b"".join(names), "V16")
            for k, i in _by_bucket(batch[rows]):
                out.append(_message(0, k, GROUP, place["doc"][rows[i]], place["at"][rows[i]].copy(), names[i], lefts[i], sizes[i]))
        win = sent.filter(pa.array(kinds == WINDOW))
        if win.num_rows:
            place, batch, text, _ = self.window_classes(win, self.width)
            names = np.frombuffer(b"".join(hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in text), "V16")
            for k, i in _by_bucket(batch):
                n = len(i)
                out.append(_message(0, k, GROUP, place["doc"][i], place["at"][i].copy(), names[i], np.full(n, WHOLE_WINDOW), np.full(n, self.width)))
        return _table(out)


def maximal_repeats(docs: DataFrame, *, width: int = 100, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """repeat, length, doc_id, start: a row for each occurrence of each maximal repeat group; ``repeat`` digests its bytes.

    Groups are maximal within the reach of an anchor, ``width`` bytes to either side at most: a longer
    repeat is a chain of groups that overlap. Those of heavy anchors have ``width`` bytes. Every
    occurrence is listed, so the rows grow with the repeats; no task holds more than its own documents'.
    """
    rounds = Rounds(docs, width, key, text, heavy, batch_bytes)
    schema = "repeat string, length long, doc_id long, start long"

    def occurrences(key: tuple, docs: pa.Table, told: pa.Table, sent: pa.Table) -> list[tuple]:
        b = Batch(docs)
        seen, spread, _ = rounds.contexts(b, told)
        places = {v[0][3]: [p for _, _, _, p in v] for v in seen.values()}
        raw = b.buf.tobytes()
        for s in np.concatenate(spread).tolist() if spread else ():
            places.setdefault(("window", raw[s : s + width]), []).append(s)
        out = []
        for r in sent.to_pylist():
            doc, at = np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int64)
            names, left, size = np.frombuffer(r["c"], "V16"), np.frombuffer(r["d"], np.int64), np.frombuffer(r["e"], np.int64)
            for j in range(len(doc)):
                p = int(b.starts[doc[j]] + at[j])
                own, back = (places["window", raw[p : p + width]], 0) if left[j] == WHOLE_WINDOW else (places[p], int(left[j]))
                out += [(names[j].tobytes().hex(), int(size[j]), x - back) for x in own]
        return [(n, size, b.ids[int(b.doc(np.array([s]))[0])].as_py(), s - int(b.starts[int(b.doc(np.array([s]))[0])])) for n, size, s in out]

    def expand(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        release()
        kinds = sent.column("kind").to_numpy() if sent.num_rows else np.zeros(0)
        rows = occurrences(key, docs, sent.filter(pa.array(kinds == REPEATED)), sent.filter(pa.array(kinds == GROUP))) if docs.num_rows and len(kinds) else []
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["repeat", "length", "doc_id", "start"])

    listed = rounds.sent.groupBy("bucket").applyInArrow(lambda key, sent: rounds.list_groups(key, sent), MESSAGE).unionByName(rounds.answered)
    found = rounds.own.groupBy("batch").cogroup(listed.groupBy("batch")).applyInArrow(expand, schema).distinct()
    uses = found.groupBy("repeat").agg(F.count("*").alias("uses")).where("uses > 1").select("repeat")
    return found.join(uses, "repeat", "left_semi")


def remove_repeats(docs: DataFrame, *, width: int = 100, key: str = "doc_id", text: str = "text", keep_text: bool = False, heavy: int = HEAVY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes.

    One plan: texts are dealt to batches once, and the three rounds read that same exchange.
    """
    rounds = Rounds(docs, width, key, text, heavy, batch_bytes)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] if keep_text else []

    def remove(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        release()
        b = Batch(docs)
        go = np.zeros(len(b.buf) + 1, np.int32)
        for kind, *raw in zip(*(told.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True):
            doc, lo, hi = np.frombuffer(raw[0], np.int32), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.int64)
            sign = 1 if kind == DEFAULT else -1
            np.add.at(go, b.starts[doc] + lo, sign)
            np.add.at(go, b.starts[doc] + hi + 1, -sign)
        go = np.cumsum(go[:-1], dtype=np.int32) > 0
        cover = np.zeros(len(go) + width + 1, np.int32)
        edge = np.diff(np.concatenate(([0], go.astype(np.int8), [0])))
        np.add.at(cover, np.flatnonzero(edge == 1), 1)
        np.add.at(cover, np.flatnonzero(edge == -1) - 1 + width, -1)
        gone = np.cumsum(cover, dtype=np.int32)[: len(go)] > 0
        n_removed, n_spans, digests, kept = [], [], [], []
        for s, n in zip(b.starts.tolist(), b.lengths.tolist(), strict=True):
            g = gone[s : s + n]
            rest = b.buf[s : s + n][~g].tobytes()
            n_removed.append(n - len(rest))
            n_spans.append(int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        cols = [b.ids.cast(pa.int64()), pa.array(b.lengths, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept, pa.binary())] if keep_text else [])
        return pa.table(cols, names=[f.name for f in fields])

    decided = rounds.sent.groupBy("bucket").applyInArrow(lambda key, sent: rounds.decide(key, sent), MESSAGE)
    out = rounds.own.groupBy("batch").cogroup(decided.groupBy("batch")).applyInArrow(remove, T.StructType(fields))
    raw, zero = F.col("text").cast("binary"), F.lit(0).cast("long")
    whole = [F.col("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")]
    return out.unionByName(rounds.short.select(*whole, *([raw.alias("kept")] if keep_text else [])))
