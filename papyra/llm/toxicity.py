"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

An instance is a stretch of a word: up to ``STARTS`` consecutive letters and what follows them
closely. The kernel counts common subsequences of three letters, each discounted by the length it
spans (``DECAY`` a letter, ``SPAN`` at most), so letters left out or put in lower a match and do not
end it, and a stretch that comes near is tried without each of its letters; characters that are no letters are read over, and letters set one by one are read as one
word. Landmarks are insults found so far and clean stretches. With K their kernel matrix, an
instance's features are its kernels with the landmarks times K**(-1/2), and a linear machine on
those is the support vector machine restricted to the landmarks' span. Its decision is a sum over
subsequences, so the trained machine is one table of subsequence weights, read once for each letter.

Labels belong to whole texts; which stretch earned one is learned by the rounds of ``train``: each
takes a toxic text's best stretches as positive and clean texts' best, and random ones, as negative.
A text's score is the calibrated decision of its best stretch. Training uses a bounded sample.

Defined results: a text that is null, empty or without a word of two letters gets the score of the
lowest decision; with no labels of both kinds every score is the share of toxic labels, 0 if there
are none; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample

#: Labelled documents of each class that the machine is fitted on, and characters of each at most; landmarks; rounds of
#: choosing stretches; words of a text that a round looks at.
FIT_DOCS, FIT_CHARS, LANDMARKS, ROUNDS, WORDS = 1000, 200_000, 320, 4, 4
#: Kernel: letters that a subsequence spans after its first, discount for each, first letters in a stretch.
SPAN, DECAY, STARTS = 5, 0.75, 6
#: Decisions above this are worked out with the stretch's exact length; others stay below it, far under any threshold.
EXACT_FROM = 0.0
#: Characters worked on together.
CHARS = 1_000_000

#: A stretch whose decision lies above ``NEAR`` is read again without each of its letters; if the rest is as sure as the
#: insults of the training, whose margin is 1, the text's decision is that one less ``DISCOUNT``.
NEAR, SURE, DISCOUNT = -0.3, 0.985, 0.5

SYMBOLS, START, SPACE = 64, 27, 255
PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def _symbol_table() -> np.ndarray:
    """Letter codes below U+0250: a-z, Latin-1 letters, digits that stand for letters; 0 is read over."""
    t = np.zeros(0x250, np.uint8)
    for cp in range(0x250):
        c = chr(cp).lower()[:1]
        if "a" <= c <= "z":
            t[cp] = ord(c) - 96
        elif 0xDF <= ord(c) <= 0xFF and c.isalpha():
            t[cp] = 28 + ord(c) - 0xDF
        elif c.isalpha():
            t[cp] = 61
        elif c.isspace():
            t[cp] = SPACE
    for digit, letter in zip("01345", "oieas", strict=True):
        t[ord(digit)] = ord(letter) - 96
    return t


TABLE = _symbol_table()


@dataclass
class Letters:
    """Symbols of some texts: START before each word, then its letters; ``room`` symbols are left in the word."""

    code: np.ndarray
    room: np.ndarray
    first: np.ndarray  # where each text starts; a text has one symbol at least


def read(texts: list[str | None]) -> Letters:
    parts = [" " + (t or "").lower() for t in texts]
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = cp >= len(TABLE)
    code = TABLE[np.where(far, 0, cp)]
    if far.any():
        code[far] = np.where((cp[far] >= 0x2000) & (cp[far] < 0x2070) | (cp[far] >= 0x3000) & (cp[far] < 0x3004), SPACE, 62 + (cp[far] & 1))
    head = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
    is_head = np.zeros(len(code), bool)
    is_head[head] = True
    kept = np.flatnonzero(code)
    code, is_head = code[kept], is_head[kept]
    space = code == SPACE
    last = space & ~np.concatenate((space[1:], [False]))  # the space just before a word
    take = ~space | last | is_head
    code, is_head, space = code[take], is_head[take], space[take]
    starts = np.flatnonzero(space)
    n = np.diff(np.concatenate((starts, [len(code)]))) - 1
    single = np.concatenate(([False], (n[1:] == 1) & (n[:-1] == 1))) & ~is_head[starts]
    if single.any():
        stay = np.ones(len(code), bool)
        stay[starts[single]] = False
        code, is_head, space = code[stay], is_head[stay], space[stay]
        starts = np.flatnonzero(space)
    code[starts] = START
    ends = np.concatenate((starts[1:], [len(code)]))
    room = (np.repeat(ends, ends - starts) - np.arange(len(code))).astype(np.int32)
    return Letters(code.astype(np.int32), room, np.flatnonzero(is_head))


def subsequences(x: Letters, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of the subsequences in the stretches that start at ``at``; weight 0 where a word ends."""
    pos = at[:, None] + np.arange(STARTS)
    inside = np.arange(STARTS) < x.room[at][:, None]
    pos = np.where(inside, pos, at[:, None])
    c, room = np.concatenate((x.code, np.zeros(SPAN, np.int32))), x.room[pos]
    ids = np.stack([(c[pos] * SYMBOLS + c[pos + a]) * SYMBOLS + c[pos + b] for a, b in PAIRS], axis=2)
    w = np.stack([np.where(inside & (room > b), DECAY**b, 0.0) for _, b in PAIRS], axis=2)
    return ids.reshape(len(at), -1), w.reshape(len(at), -1).astype(np.float32)


def norms(ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Length of each stretch's subsequence vector; one that occurs several times in a stretch counts together."""
    key = (np.arange(len(ids))[:, None] * SYMBOLS**3 + ids).ravel()
    names, place = np.unique(key, return_inverse=True)
    total = np.bincount(place.ravel(), w.ravel().astype(float), minlength=len(names))
    return np.sqrt(np.bincount(names // SYMBOLS**3, total * total, minlength=len(ids)))


def _squares() -> np.ndarray:
    return np.array([sum(DECAY ** (2 * b) for _, b in PAIRS if b < room) for room in range(SPAN + 2)])


SQUARES = _squares()


@dataclass
class Machine:
    """Weights of subsequences, the offset, and the calibration from decisions to probabilities."""

    table: np.ndarray
    offset: float
    slope: float
    bias: float
    prior: float | None = None
    letters_out: bool = True  # whether stretches are tried without each of their letters

    def decisions(self, x: Letters) -> np.ndarray:
        """Decision of the stretch at each symbol; -2 where it has no subsequence."""
        n = len(x.code)
        c, room = np.concatenate((x.code, np.zeros(SPAN, np.int32))), x.room
        total, high = np.zeros(n, np.float32), c * (SYMBOLS * SYMBOLS)
        for a, b in PAIRS:
            ids = high[:n] + c[a : n + a] * SYMBOLS + c[b : n + b]
            total += np.where(room > b, self.table[ids] * np.float32(DECAY**b), np.float32(0))
        square = SQUARES[np.minimum(room, SPAN + 1)]
        run, norm = np.concatenate(([0.0], np.cumsum(total, dtype=np.float64))), np.concatenate(([0.0], np.cumsum(square)))
        end = np.arange(n) + np.minimum(room, STARTS)
        size = norm[end] - norm[:n]
        plain = np.sqrt(np.maximum(size, 1e-6))
        out = np.where(size > 1e-6, (run[end] - run[:n]) / plain + self.offset, -2.0)
        # the length above takes every subsequence as another one; where that matters it is worked out
        near = np.flatnonzero((out > EXACT_FROM) | (size > 1e-6) & (self.offset > EXACT_FROM))
        for at in range(0, len(near), 20_000):
            i = near[at : at + 20_000]
            out[i] = (out[i] - self.offset) * plain[i] / np.maximum(norms(*subsequences(x, i)), plain[i]) + self.offset
        return out

    def decisions_by_part(self, x: Letters) -> np.ndarray:
        """``decisions``, worked out for some texts at a time."""
        cuts, out = [0], []
        for f in [*x.first[1:].tolist(), len(x.code)]:
            if f - cuts[-1] >= CHARS or f == len(x.code):
                out.append(self.decisions(Letters(x.code[cuts[-1] : f], x.room[cuts[-1] : f], x.first[:0])).astype(np.float32))
                cuts.append(f)
        return np.concatenate(out)

    def without_a_letter(self, x: Letters, decision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of stretches that come near an insult, and their best decision with one letter left out.

        A letter put into an insult takes the kernel's matches apart and lengthens the stretch. Leaving
        each letter out of the few stretches that still come near gives the insult back, if it is one.
        """
        reach = STARTS + SPAN
        near = np.flatnonzero((decision > NEAR) & (decision < SURE) & (x.room >= 5))
        if not len(near):
            return near, np.zeros(0)
        room = np.minimum(x.room[near], reach + 1)
        code = np.concatenate((x.code, np.zeros(reach + 1, np.int32)))
        # a row for each stretch and each letter that may go; the first one stays
        row, gone = np.nonzero(np.arange(reach + 1) < room[:, None])
        row, gone = row[gone > 0], gone[gone > 0]
        keep = np.arange(reach) + (np.arange(reach) >= gone[:, None])
        live = np.arange(reach) < (room[row] - 1)[:, None]
        sub = Letters(code[near[row, None] + keep][live], (room[row] - 1)[:, None].repeat(reach, axis=1)[live] - np.broadcast_to(np.arange(reach), live.shape)[live], np.zeros(0, np.int64))
        first = np.cumsum(room[row] - 1) - (room[row] - 1)
        best = np.full(len(near), -2.0)
        np.maximum.at(best, row, np.maximum.reduceat(self.decisions(sub), first))
        return near, best

    def best(self, x: Letters) -> np.ndarray:
        """The decision of each text: that of its best stretch, whole or with a letter left out."""
        decision = self.decisions(x)
        out = np.maximum.reduceat(decision, x.first)
        if not self.letters_out:
            return out
        near, again = self.without_a_letter(x, decision)
        sure = again >= SURE
        np.maximum.at(out, np.searchsorted(x.first, near[sure], side="right") - 1, again[sure] - DISCOUNT)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out, at, some, size = np.empty(len(texts)), 0, [], 0
        for i, t in enumerate([*texts, None]):
            if some and (i == len(texts) or size + len(t or "") > CHARS):
                out[at:i] = self.best(read(some))
                at, some, size = i, [], 0
            if i < len(texts):
                some.append(t)
                size += len(t or "")
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.bias, -30, 30)))


def _best(score: np.ndarray, x: Letters, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The best stretch of each of the ``count`` best words of each text: positions and texts."""
    ends, picks = np.append(x.first[1:], len(x.code)), []
    for s, e in zip(x.first, ends, strict=True):
        order = np.argsort(-score[s:e], kind="stable")
        word = np.cumsum(x.code[s:e] == START)[order]
        _, first = np.unique(word, return_index=True)
        picks.append(s + order[np.sort(first)[:count]])
    return np.concatenate(picks), np.repeat(np.arange(len(picks)), [len(p) for p in picks])


def _guess(gram: np.ndarray, x: Letters, label: np.ndarray) -> np.ndarray:
    """A first score of each stretch: how much commoner its first five symbols are in toxic texts than in clean ones."""
    ends = np.append(x.first[1:], len(x.code))
    own = [np.unique(gram[s:e]) for s, e in zip(x.first, ends, strict=True)]
    names, toxic = np.unique(np.concatenate([g for g, y in zip(own, label, strict=True) if y]), return_counts=True)
    clean = np.zeros(len(names), np.int64)
    for g, y in zip(own, label, strict=True):
        if not y:
            at = np.searchsorted(names, g).clip(0, len(names) - 1)
            clean[at[names[at] == g]] += 1
    p, q = (toxic + 0.1) / (label.sum() + 1), (clean + 0.5) / ((label == 0).sum() + 1)
    worth = np.where(toxic > 1, np.sqrt(p) * np.log(p / q), -9).astype(np.float32)
    out = np.empty(len(gram), np.float32)
    for s, e in zip(x.first, ends, strict=True):
        at = np.searchsorted(names, gram[s:e]).clip(0, len(names) - 1)
        out[s:e] = np.where((names[at] == gram[s:e]) & (x.room[s:e] >= 4), worth[at], -9)
    return out


def _fit(phi: tuple[np.ndarray, np.ndarray], y: np.ndarray, marks: tuple[np.ndarray, np.ndarray], cost: float = 3.0) -> tuple[np.ndarray, float]:
    """Weight table and offset of the machine on Nystrom features of the instances ``phi``."""
    ids, w = marks
    used, column = np.unique(ids[w > 0], return_inverse=True)
    dense = np.zeros((len(ids), len(used)))
    np.add.at(dense, (np.nonzero(w > 0)[0], column), w[w > 0])
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    where = np.full(SYMBOLS**3, -1)
    where[used] = np.arange(len(used))
    columns, kernel = np.vstack((dense.T, np.zeros(len(ids)))), np.empty((len(y), len(ids)))
    for at in range(0, len(y), 256):
        i, v = phi[0][at : at + 256], phi[1][at : at + 256]
        kernel[at : at + 256] = np.einsum("nf,nfm->nm", v, columns[where[i]]) / np.maximum(norms(i, v)[:, None], 1e-9)
    value, vector = np.linalg.eigh(dense @ dense.T)
    good = value > 1e-4 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = np.hstack((kernel @ root, np.ones((len(y), 1))))
    share = cost * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    weight, ridge = np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):  # Newton steps on the squared hinge loss
        live = y * (z @ weight) < 1
        new = np.linalg.solve(ridge + (z[live].T * share[live]) @ z[live], (z[live].T * share[live]) @ y[live])
        if np.abs(new - weight).max() < 1e-6:
            break
        weight = new
    table = np.zeros(SYMBOLS**3, np.float32)
    table[used] = dense.T @ (root @ weight[:-1])
    return table, float(weight[-1])


def train(texts: list[str], toxic: list[int], share: float | None = None, seed: int = 5) -> Machine:
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(1, np.float32), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    fold = rng.random(len(y)) < 0.25  # decisions are calibrated on texts that the machine has not seen
    if len(y) < 40 or len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), bool)
    own = np.flatnonzero(~fold)
    x, label = read([texts[i] for i in own]), y[own]
    text = np.zeros(len(x.code), np.int32)
    text[x.first[1:]] = 1
    text = np.cumsum(text, dtype=np.int32)

    c = np.concatenate((x.code, np.zeros(4, np.int32)))
    gram = np.zeros(len(x.code), np.int32)
    for k in range(5):
        gram = gram * SYMBOLS + np.where(x.room > k, c[k : len(x.code) + k], 0)
    score, machine = _guess(gram, x, label), None
    usable = np.flatnonzero(x.room >= 3)
    clean_places = usable[label[text[usable]] == 0]
    for turn in range(ROUNDS):
        best, owner = _best(score, x, WORDS)
        top = np.full(len(own), -np.inf)
        np.maximum.at(top, owner, score[best])
        sure = score[best] >= (0.7 * top[owner] if turn == 0 else np.minimum(top[owner], 0.5))
        positive = best[(label[owner] == 1) & sure & (score[best] > (0 if turn == 0 else -1)) & (x.room[best] >= 3)]
        hard = best[(label[owner] == 0) & (x.room[best] >= 3)]
        easy = rng.choice(clean_places, min(len(clean_places), 3000), replace=False) if len(clean_places) else hard
        if not len(positive) or not len(hard) + len(easy):
            break
        negative = np.concatenate((hard, easy))
        names, count = np.unique(gram[positive], return_counts=True)
        first = {n: p for p, n in zip(positive[::-1], gram[positive[::-1]], strict=True)}
        marks = np.array([first[n] for n in names[np.argsort(-count, kind="stable")][: LANDMARKS * 5 // 8]] + list(rng.choice(hard, min(len(hard), LANDMARKS * 3 // 16), replace=False)) + list(rng.choice(easy, min(len(easy), LANDMARKS * 3 // 16), replace=False)))
        at = np.concatenate((positive, negative))
        sign = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        machine = Machine(*_fit(subsequences(x, at), sign, subsequences(x, marks)), 1.0, 0.0)
        score = machine.decisions_by_part(x)
    if machine is None:
        return Machine(np.zeros(1, np.float32), 0.0, 1.0, 0.0, float(y.mean()))
    held = np.flatnonzero(fold) if fold.any() else own
    z = read([texts[i] for i in held])
    d, target = np.maximum.reduceat(machine.decisions(z), z.first), y[held]
    # texts count so that the classes have their shares in the whole corpus, not in the sample
    base = min(max(share if share is not None else y.mean(), 0.01), 0.99)
    weight = np.where(target == 1, base / max(1, target.sum()), (1 - base) / max(1, (1 - target).sum())) * len(target)
    up, down = (target.sum() + 1) / (target.sum() + 2), 1 / (len(target) - target.sum() + 2)
    soft, design, ab = np.where(target == 1, up, down), np.stack((d, np.ones(len(d))), axis=1), np.array([1.0, 0.0])
    for _ in range(100):  # Newton steps, damped by a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        step = np.linalg.solve((design.T * (weight * p * (1 - p))) @ design + 0.05 * np.eye(2), design.T @ (weight * (p - soft)) + 0.05 * ab)
        ab = ab - np.clip(step, -1, 1)
    done = Machine(machine.table, machine.offset, float(max(0.1, ab[0])), float(ab[1]))
    # a machine that knows its insults badly would take clean words for them: those texts tell
    done.letters_out = not ((done.slope * d + done.bias < 0) & (done.slope * done.best(z) + done.bias >= 0) & (target == 0)).any()
    return done


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = FIT_DOCS, chars: int = FIT_CHARS) -> Machine:
    """Machine fitted on about ``per_class`` labelled documents of each class for which ``learn`` holds.

    The sample is drawn from the labels; only its ids, of bounded number, meet the texts. Of rows with
    one id the text of the least digest is taken; texts of over ``chars`` characters are not learned from.
    """
    drawn = bounded_sample(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn).select(key, label).distinct(), label, per_class, key, values=2)
    drawn = F.broadcast(drawn.orderBy(F.xxhash64(F.col(key).cast("string")), key, label).limit(4 * per_class))
    found = docs.where(F.col(text).isNotNull() & (F.length(text) <= chars)).select(key, F.col(text).alias("t")).join(drawn, key)
    rows = found.groupBy(key, label).agg(F.min(F.struct(F.md5("t"), "t")).alias("m")).select(key, label, "m.t").collect()
    rows.sort(key=lambda r: (r[key], r[label], r["t"]))
    share = labels.where(F.col(label).isin(0, 1) & learn).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train([r["t"] for r in rows], [r[label] for r in rows], share)


def score(docs: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of ``text`` and of columns of those names."""
    fields = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                s = machine.scores(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    out = docs.select(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(fields)], F.col(text).alias("t")).mapInArrow(run, schema)
    return out.toDF(*[f.name for f in fields], "score", "predicted")
