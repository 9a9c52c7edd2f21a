"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of ``window`` characters (an item shorter than that
is one window) that may differ from a document's text by ``rate`` of their length in edits. By the
q-gram lemma a window of length L met with at most e edits shares at least ``L - q + 1 - q * e``
q-grams with the text, all within e diagonals of each other. Documents are scanned once: positions
whose q-gram occurs in the benchmark are kept where enough of them stand close together, counted for
each window in overlapping bands of diagonals, and bands that reach the bound are verified by a
banded alignment of the window against the text. What the lemma keeps is exact: no match within the
edit budget is lost, and nothing is reported that the alignment does not confirm.

Those windows start ``stride`` characters apart. Where a document meets none of an item's, the
windows of every other start are tried the same way, so a quote of ``window`` characters or more is
found wherever it starts. Items under ``MIN_CHARS`` are looked for whole and exact, between words:
anywhere if they have ``SHORT_CHARS`` and ``SHORT_WORDS`` or more, else as all of a document's text.

Texts are compared with A-Z lower-cased and anything that is not a letter, digit or non-ASCII
character turned into single blanks. The benchmark is taken in blocks of bounded size, so it may be
as large as it likes; documents are never shuffled.

Defined results: null texts, items without compared characters and empty tables give no rows; items with the same compared text are reported once, under the least item_id; repeated
documents each get their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a q-gram; characters of benchmark windows and their stride; edits allowed, as a share of a window.
Q, WINDOW, STRIDE, RATE = 8, 96, 48, 0.08
#: Items shorter than this are looked for whole; those of fewer characters or words than the others only as whole documents.
MIN_CHARS, SHORT_CHARS, SHORT_WORDS = 48, 16, 3
#: Benchmark characters taken at once; document bytes scanned at once; alignments done at once.
BLOCK_CHARS, SCAN, ALIGN = 4_000_000, 1_000_000, 4096
BITS = 20

COMPARED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def compared(text: str | None) -> bytes:
    return b" ".join(text.encode().translate(COMPARED).split()) if text else b""


def positions(text: str) -> list[int]:
    """For each byte of ``compared(text)``, the character of ``text`` that it comes from."""
    out, gap, at = [], -1, []
    for i, c in enumerate(text):
        for b in c.encode():
            b = COMPARED[b]
            if b in b" \t\n\r\x0b\x0c":
                gap = i if gap < 0 else gap
            else:
                if gap >= 0 and out:
                    out.append(gap)
                gap = -1
                out.append(i)
                at.append(b)
    return out


def _sliding(buf: bytes | np.ndarray) -> np.ndarray:
    """The Q bytes from each position, as one number each."""
    n = len(buf) - Q + 1
    return np.ndarray((max(0, n),), np.uint64, buf, 0, (1,)).copy() if n > 0 else np.zeros(0, np.uint64)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


@dataclass
class Index:
    """Windows of some benchmark items and the places of their q-grams."""

    items: list
    window: np.ndarray  # windows as rows of bytes, padded with 0
    owner: np.ndarray  # item number of each window
    length: np.ndarray
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that the lemma asks for
    grams: np.ndarray
    start: np.ndarray  # of each gram's places
    places: np.ndarray  # window * 2**16 + offset
    bitmap: np.ndarray
    text: np.ndarray  # of all items that are longer than a window
    head: np.ndarray  # where each item starts there
    size: np.ndarray  # length of each item there, 0 for others
    text_grams: np.ndarray
    text_start: np.ndarray
    text_places: np.ndarray  # item * 2**32 + position

    @classmethod
    def build(cls, items: list[tuple[object, bytes]], window: int = WINDOW, stride: int = STRIDE, rate: float = RATE) -> Index | None:
        texts, owner = [], []
        for i, (_, t) in enumerate(items):
            starts = [*range(0, max(1, len(t) - window), stride), max(0, len(t) - window)]
            for s in sorted(set(starts)):
                texts.append(t[s : s + window])
                owner.append(i)
        if not texts:
            return None
        length = np.array([len(t) for t in texts])
        edits = np.minimum((length * rate).astype(int), (length - Q) // Q)
        g = [_sliding(t) for t in texts]
        grams = np.concatenate(g)
        place = np.concatenate([np.arange(len(x)) + (i << 16) for i, x in enumerate(g)])
        order = np.argsort(grams, kind="stable")
        names, start = np.unique(grams[order], return_index=True)
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[_slot(names)] = True
        rows = np.zeros((len(texts), length.max()), np.uint8)
        for i, t in enumerate(texts):
            rows[i, : len(t)] = np.frombuffer(t, np.uint8)
        size = np.array([len(t) if len(t) > window else 0 for _, t in items])
        head = np.cumsum(size) - size
        long = [(i, t) for i, (_, t) in enumerate(items) if len(t) > window]
        whole = [_sliding(t) for _, t in long]
        all_grams = np.concatenate([np.zeros(0, np.uint64), *whole])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) + (i << 32) for (i, _), x in zip(long, whole, strict=True))])
        by = np.argsort(all_grams, kind="stable")
        _, first = np.unique(all_grams[by], return_index=True)
        return cls([i for i, _ in items], rows, np.array(owner), length, edits, length - Q + 1 - Q * edits, names, np.append(start, len(order)), place[order], bitmap, np.frombuffer(b"".join(t for _, t in long), np.uint8), head, size, all_grams[by][first], np.append(first, len(by)), at[by])

    def candidates(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows, and lowest diagonals of the bands, that share enough q-grams with ``buf``."""
        grams = _sliding(buf)
        at = np.flatnonzero(self.bitmap[_slot(grams)])
        name = np.searchsorted(self.grams, grams[at]).clip(0, len(self.grams) - 1)
        real = self.grams[name] == grams[at]
        at, name = at[real], name[real]
        # a region holds its shared q-grams within one window's length and edits: drop positions in no such crowd
        reach, least = int((self.length + self.edits).max()) - Q + 1, int(self.least.min())
        n = np.searchsorted(at, at + reach) - np.arange(len(at))
        crowd = np.flatnonzero(n >= least)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, crowd, 1)
        np.add.at(mark, crowd + n[crowd], -1)
        live = np.cumsum(mark[:-1]) > 0
        at, name = at[live], name[live]
        width = 2 * (int(self.edits.max()) + 1)
        shift_all = width * -(-(self.window.shape[1] + width) // width)  # keeps all diagonals above 0
        names = len(buf) + 2 * shift_all
        found = []
        uses = self.start[name + 1] - self.start[name]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(at) > reach) + 1, [len(at)]))  # crowds are counted apart
        total = np.concatenate(([0], np.cumsum(uses)))
        a = 0
        while a < len(edge) - 1:
            b = a + 1
            while b < len(edge) - 1 and total[edge[b + 1]] - total[edge[a]] < 2_000_000:
                b += 1
            lo, hi = edge[a], edge[b]
            u = uses[lo:hi]
            k = np.repeat(self.start[name[lo:hi]], u) + np.arange(u.sum()) - np.repeat(np.cumsum(u) - u, u)
            place = self.places[k]
            win, diagonal = place >> 16, np.repeat(at[lo:hi], u) - (place & 0xFFFF) + shift_all
            for shift in (0, width // 2):
                band = (diagonal + shift) // width
                key, count = np.unique(win * names + band, return_counts=True)
                w, band = key // names, key % names
                good = count >= self.least[w]
                found.append(np.stack((w[good], band[good] * width - shift - shift_all)))
            a = b
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def align(self, buf: np.ndarray, win: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window within its band of diagonals, and where in ``buf`` that match ends."""
        e = int(self.edits.max())
        pad, k = 4 * (e + 1), 4 * (e + 1)
        text = np.concatenate((np.zeros(pad, np.uint8), buf, np.zeros(pad + k + self.window.shape[1], np.uint8)))
        first = (low - e + pad).clip(0)
        row, step = np.zeros((len(win), k), np.int16), np.arange(k, dtype=np.int16)
        best, end = np.full(len(win), 32767, np.int64), np.zeros(len(win), np.int64)
        done = self.length[win]
        for i in range(int(done.max(initial=0))):
            miss = text[first[:, None] + (i + np.arange(k))] != self.window[win, i][:, None]
            new = row + miss
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a letter of the window left out
            row = np.minimum.accumulate(new - step, axis=1) + step  # letters of the text put in
            for j in np.flatnonzero(done == i + 1):
                c = int(row[j].argmin())
                best[j], end[j] = row[j, c], first[j] + i + c + 1 - pad
        return best, end


    def between(self, buf: np.ndarray, heads: np.ndarray, met: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """doc, item, edits, end of windows of any start, for those documents and items that are not ``met``."""
        if not len(self.text):
            return
        n = self.window.shape[1]
        edits = int(self.edits[self.length == n][0])
        least, reach, width = n - Q + 1 - Q * edits, n + edits - Q + 1, 2 * (edits + 1)
        grams = _sliding(buf)
        at = np.flatnonzero(self.bitmap[_slot(grams)])
        name = np.searchsorted(self.text_grams, grams[at]).clip(0, len(self.text_grams) - 1)
        real = self.text_grams[name] == grams[at]
        at, name = at[real], name[real]
        k = np.searchsorted(at, at + reach) - np.arange(len(at))
        crowd = np.flatnonzero(k >= least)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, crowd, 1)
        np.add.at(mark, crowd + k[crowd], -1)
        live = np.cumsum(mark[:-1]) > 0
        at, name = at[live], name[live]
        uses = self.text_start[name + 1] - self.text_start[name]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(at) > reach) + 1, [len(at)]))
        total = np.concatenate(([0], np.cumsum(uses)))
        far = int(self.size.max()) + n
        shift_all = width * -(-far // width)
        bands = (len(buf) + 2 * shift_all) // width + 2
        known = np.array(sorted(d * len(self.size) + i for d, i in met), np.int64)
        a = 0
        while a < len(edge) - 1:
            b = a + 1
            while b < len(edge) - 1 and total[edge[b + 1]] - total[edge[a]] < 2_000_000:
                b += 1
            lo, hi = edge[a], edge[b]
            a = b
            u = uses[lo:hi]
            place = self.text_places[np.repeat(self.text_start[name[lo:hi]], u) + np.arange(u.sum()) - np.repeat(np.cumsum(u) - u, u)]
            item, pos, here = place >> 32, place & 0xFFFFFFFF, np.repeat(at[lo:hi], u)
            doc = np.searchsorted(heads, here, side="right") - 1
            new = ~np.isin(doc * len(self.size) + item, known)
            item, pos, here = item[new], pos[new], here[new]
            for shift in (0, width // 2):
                key = np.sort((item * bands + (here - pos + shift_all + shift) // width) * far + pos)
                first = np.arange(len(key) - least + 1) if len(key) >= least else np.zeros(0, np.int64)
                first = first[key[first + least - 1] - key[first] <= n - Q]  # so many q-grams in the reach of one window
                group, p, last = key[first] // far, key[first] % far, key[first + least - 1] % far
                low = np.maximum(0, last - (n - Q))
                count = np.minimum(p, self.size[group // bands] - n) - low + 1
                for part in np.split(np.arange(len(first)), np.searchsorted(np.cumsum(count.clip(0)), np.arange(1_000_000, count.clip(0).sum(), 1_000_000))):
                    c = count[part].clip(0)
                    start = np.repeat(low[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    tried = np.unique(np.repeat(group[part], c) * far + start)
                    for j in range(0, len(tried), ALIGN):
                        g, s = tried[j : j + ALIGN] // far, tried[j : j + ALIGN] % far
                        it = g // bands
                        rows = self.text[(self.head[it] + s)[:, None] + np.arange(n)]
                        some = replace(self, window=rows, length=np.full(len(s), n), edits=np.full(len(s), edits))
                        best, end = some.align(buf, np.arange(len(s)), g % bands * width - shift - shift_all + s)
                        for x in np.flatnonzero(best <= edits):
                            yield int(np.searchsorted(heads, end[x] - 1, side="right")) - 1, int(it[x]), int(best[x]), int(end[x])


class Short:
    """Items under MIN_CHARS, met whole and exact between words."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.whole = {t: i for i, t in items}
        free = [t for _, t in items if len(t) >= SHORT_CHARS and t.count(b" ") + 1 >= SHORT_WORDS]
        self.by: dict[int, list[bytes]] = {}
        for t in free:
            self.by.setdefault(int(_sliding(t)[0]), []).append(t)
        self.bitmap = np.zeros(1 << BITS, bool)
        if self.by:
            self.bitmap[_slot(np.array(list(self.by), np.uint64))] = True

    def find(self, text: bytes) -> dict[bytes, tuple[int, int]]:
        """Items met, with the first start and last end of each."""
        out = {text: (0, len(text))} if text in self.whole else {}
        if self.by:
            grams = _sliding(text)
            for s in np.flatnonzero(self.bitmap[_slot(grams)]).tolist():
                if s == 0 or text[s - 1] == 32:
                    for t in self.by.get(int(grams[s]), ()):
                        e = s + len(t)
                        if text.startswith(t, s) and (e == len(text) or text[e] == 32):
                            out[t] = min(out.get(t, (s, e))[0], s), e
        return out


def _joined(index: Index, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one buffer with gaps between them, and where each starts."""
    gap = bytes(2 * (int(index.edits.max()) + 2))
    return np.frombuffer(gap + gap.join(docs) + gap, np.uint8), np.cumsum([len(gap)] + [len(d) + len(gap) for d in docs])[:-1]


def _regions(index: Index, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """doc, window, edits, start, end (bytes of the compared text) of confirmed matches."""
    buf, heads = _joined(index, docs)
    win, low = index.candidates(buf)
    for at in range(0, len(win), ALIGN):
        w = win[at : at + ALIGN]
        best, end = index.align(buf, w, low[at : at + ALIGN])
        for j in np.flatnonzero(best <= index.edits[w]):
            doc = int(np.searchsorted(heads, end[j] - 1, side="right")) - 1
            stop = int(end[j] - heads[doc])
            yield doc, int(w[j]), int(best[j]), max(0, stop - int(index.length[w[j]])), min(stop, len(docs[doc]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, stride: int = STRIDE, rate: float = RATE) -> DataFrame:
    """A row for each document and benchmark item that it holds windows of.

    doc_id, item_id, n_windows (met), windows (of the item), edits (least), start, end: characters of
    the document's text from the first to the last region. n_windows is 0 where only windows between
    those of the stride are met.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("n_windows", T.LongType()), T.StructField("windows", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow_item = pa.array([], _arrow_type(schema["item_id"].dataType)).type
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        least: dict[bytes, object] = {}
        for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect():  # about BLOCK_CHARS characters
            t = compared(r["t"])
            if t:
                least[t] = r["i"] if t not in least or least[t] is None else least[t] if r["i"] is None else min(least[t], r["i"])
        named = sorted(((i, t) for t, i in least.items()), key=lambda x: x[1])
        index = Index.build([x for x in named if len(x[1]) >= MIN_CHARS], window, stride, rate)
        short = Short([x for x in named if len(x[1]) < MIN_CHARS])
        if not named:
            continue

        def scan(batches: Iterator[pa.RecordBatch], index: Index | None = index, short: Short = short) -> Iterator[pa.RecordBatch]:
            per_item = np.bincount(index.owner, minlength=len(index.items)) if index else np.zeros(0, np.int64)
            for batch in batches:
                texts, n, group, size = batch.column(1), batch.num_rows, [], 0
                for i in range(n + 1):
                    if group and (i == n or size > SCAN):
                        yield from emit(batch, group, index, short, per_item)
                        group, size = [], 0
                    if i < n and (t := compared(texts[i].as_py())):
                        group.append((i, t))
                        size += len(t)

        def emit(batch: pa.RecordBatch, group: list, index: Index | None, short: Short, per_item: np.ndarray) -> Iterator[pa.RecordBatch]:
            met: dict[tuple[int, int], list] = {}
            texts = [t for _, t in group]

            def add(doc: int, it: int, w: int | None, edits: int, start: int, end: int) -> None:
                m = met.setdefault((doc, it), [set(), edits, start, end])
                m[0].update(() if w is None else (w,))
                m[1:] = min(m[1], edits), min(m[2], start), max(m[3], end)

            if index:
                for doc, w, edits, start, end in _regions(index, texts):
                    add(doc, int(index.owner[w]), w, edits, start, end)
                buf, heads = _joined(index, texts)
                for doc, it, edits, end in list(index.between(buf, heads, set(met))):
                    stop = end - int(heads[doc])
                    add(doc, it, None, edits, max(0, stop - window), min(stop, len(texts[doc])))
            whole = [(doc, short.whole[t], s, e) for doc, text in enumerate(texts) for t, (s, e) in short.find(text).items()] if short.whole else []
            if met or whole:
                rows, spans = [], {}
                for doc, name, s, e in whole:
                    at = positions(batch.column(1)[group[doc][0]].as_py())
                    rows.append((group[doc][0], name, 1, 1, 0, at[s], at[e - 1] + 1))
                for (doc, it), (ws, edits, start, end) in sorted(met.items()):
                    i = group[doc][0]
                    if doc not in spans:
                        spans = {doc: positions(batch.column(1)[i].as_py())}
                    rows.append((i, index.items[it], len(ws), int(per_item[it]), edits, spans[doc][start], spans[doc][end - 1] + 1))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], arrow_item), *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.names)

        found = docs.select(key, text).mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
