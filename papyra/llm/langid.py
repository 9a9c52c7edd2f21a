"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes from both sides, letters, digits, punctuation and blanks alike; at
each byte the two states give a probability of each language, and a document's probabilities are the
mean over all its bytes. It is trained here, in numpy, by backpropagation through time on a bounded
sample of labelled documents. Letters A-Z are read in lower case.

Many stretches are read at a time, a byte of each at a step. A text is one sequence; one of over
``STRETCH`` bytes is cut into stretches of equal length, and each is read with ``LEAD`` bytes of what
stands before and after it, whose own probabilities don't count, so that its states know their
surroundings as those of a short text do.

Defined results: a text that is null, empty or without any letter is ``und`` with score 0, as is
every text if there is nothing to learn from; repeated rows each get a row; ties go to the language
that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample

#: Labelled documents of each language that the network is fitted on, characters of each that are looked at, languages at most.
FIT_DOCS, FIT_CHARS, LANGUAGES = 250, 2000, 1000
#: Hidden units a direction; bytes of a stretch, and of its surroundings on either side; bytes of a training window.
HIDDEN, STRETCH, LEAD, WINDOW = 10, 448, 32, 48
#: Rows of a batch at a time; numbers that the positions of stretches read together may take.
ROWS, CELLS = 512, 4_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class ByteGru:
    """Bidirectional GRU with a softmax at each byte; parameters are a dict of float32 arrays, the direction in front.

    With s the state and v = x[byte] + u @ s: z = (1 + tanh v_z) / 2 is what stays of s, 1 + tanh v_r
    what of it enters the new content n = tanh(x_n[byte] + (1 + tanh v_r) * (u_n @ s + c)).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        p = {"x": rng.normal(0, 0.2, (2, 3 * hidden, 256)), "u": rng.normal(0, 0.5 / hidden**0.5, (2, 3 * hidden, hidden)), "c": np.zeros((2, hidden, 1)), "o": rng.normal(0, 1 / hidden**0.5, (2, len(labels), hidden)), "ob": np.zeros((len(labels), 1))}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, seq: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits (step, direction, label, sequence) of bytes (direction, step, sequence), each direction in its own order."""
        h, (x, u, c, o) = self.h, (self.p[k] for k in "xuco")
        n = seq.shape[2]
        state, out = np.zeros((2, h, n), x.dtype), np.empty((seq.shape[1], 2, len(self.labels), n), x.dtype)
        g = np.empty((2, 3 * h, n), x.dtype)
        for t in range(seq.shape[1]):
            for d in range(2):
                np.take(x[d], seq[d, t], axis=1, out=g[d], mode="clip")
            a = u @ state
            gates = np.tanh(g[:, : 2 * h] + a[:, : 2 * h])
            inner = a[:, 2 * h :] + c
            new = np.tanh(g[:, 2 * h :] + inner + gates[:, h:] * inner)
            if trace is not None:
                trace.append((state, gates, inner, new))
            state = new + (0.5 + 0.5 * gates[:, :h]) * (state - new)
            out[t] = o @ state
        if trace is not None:
            trace.append(state)
        return out

    def positions(self, fore: np.ndarray, back: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities (position, label, sequence); ``fore`` and ``back`` (step, sequence) are sequences of ``length`` bytes and their reverse."""
        logit = self._run(np.stack((fore, back)))
        step = np.arange(len(fore))[:, None]
        mirror = np.where(step < length, length - 1 - step, step)
        logit = logit[:, 0] + np.take_along_axis(logit[:, 1], mirror[:, None, :], axis=0) + self.p["ob"]
        np.exp(logit - logit.max(axis=1, keepdims=True), out=logit)
        return logit / logit.sum(axis=1, keepdims=True)

    def gradients(self, seq: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all bytes (step, sequence), by backpropagation through time."""
        h, (x, u, _, o) = self.h, (self.p[k] for k in "xuco")
        both, trace = np.stack((seq, seq[::-1])), []
        logit = self._run(both, trace)
        states = np.stack([s for s, *_ in trace[1:-1]] + [trace[-1]])
        logit = logit[:, 0] + logit[::-1, 1] + self.p["ob"]
        delta = np.exp(logit - logit.max(axis=1, keepdims=True))
        delta /= delta.sum(axis=1, keepdims=True)
        delta[:, target, np.arange(len(target))] -= 1
        delta /= delta.shape[0] * delta.shape[2]
        own = np.stack((delta, delta[::-1]), axis=1)  # (step, direction, label, sequence)
        grad = {"o": np.einsum("tdln,tdhn->dlh", own, states, optimize=True), "ob": delta.sum(axis=(0, 2))[:, None]}
        into = np.einsum("dlh,tdln->tdhn", o, own, optimize=True)
        later, gu, gc = np.zeros_like(into[0]), np.zeros_like(u), np.zeros_like(self.p["c"])
        into_x = np.empty((2, len(seq), len(target), 3 * h), x.dtype)
        for t in range(len(seq) - 1, -1, -1):
            state, gates, inner, new = trace[t]
            dh, z = into[t] + later, 0.5 + 0.5 * gates[:, :h]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (state - new) * 0.5 * (1 - gates[:, :h] ** 2)
            dr = dn * inner * (1 - gates[:, h:] ** 2)
            di = dn * (1 + gates[:, h:])
            da = np.concatenate((dz, dr, di), axis=1)
            gu += da @ state.transpose(0, 2, 1)
            gc += di.sum(axis=2, keepdims=True)
            into_x[:, t] = np.concatenate((dz, dr, dn), axis=1).transpose(0, 2, 1)
            later = dh * z + u.transpose(0, 2, 1) @ da
        gx = np.zeros_like(x)
        for d in range(2):
            flat = both[d].ravel()
            order = np.argsort(flat, kind="stable")
            names, first = np.unique(flat[order], return_index=True)
            gx[d][:, names] = np.add.reduceat(into_x[d].reshape(len(flat), -1)[order], first).T
        return grad | {"x": gx, "u": gu, "c": gc}


def _bytes(text: str | None) -> np.ndarray:
    return LOWER[np.frombuffer((text or "").encode(), np.uint8)]


def train(samples: list[tuple[str, str]], steps: int = 300, batch: int = 256, rate: float = 0.03, seed: int = 11) -> ByteGru | None:
    """Network fitted by Adam on windows drawn evenly from the languages of (text, language) samples."""
    texts: dict[str, list[np.ndarray]] = {}
    for text, lang in samples:
        if any(map(str.isalpha, text or "")):
            texts.setdefault(lang, []).append(_bytes(text))
    labels = sorted(texts)
    if not labels:
        return None
    rng, net = np.random.default_rng(seed), ByteGru(labels)
    gap = np.full(WINDOW, 32, np.uint8)
    pool = [np.concatenate([x for t in texts[k] for x in (t, [np.uint8(32)])] + [gap]) for k in labels]
    each = -(-batch // len(pool)) if len(pool) <= batch else 1
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = rng.permutation(len(pool))[:batch]  # all of them, unless there are more than a batch holds
        at = [rng.integers(0, len(pool[i]) - WINDOW + 1, each) for i in some]
        seq = np.concatenate([pool[i][a[:, None] + np.arange(WINDOW)] for i, a in zip(some, at, strict=True)]).T
        total = net.gradients(np.ascontiguousarray(seq), np.repeat(some, each))
        now = rate * min(1.0, step / 30) * (1 - step / (steps + 1)) ** 0.5
        for k, g in total.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def pool(net: ByteGru, texts: list[str | None]) -> np.ndarray:
    """A row of label probabilities for each text, the mean over its bytes; all zero if it has no letter."""
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    out = np.zeros((len(texts), len(net.labels)))
    if not some:
        return out
    raw = [texts[i].encode() for i in some]
    size = np.array([len(r) for r in raw])
    buf, head = LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum(size) - size
    parts = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(raw)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = head[owner] + size[owner] * k // parts[owner], head[owner] + size[owner] * (k + 1) // parts[owner]
    start, end = np.maximum(low - LEAD, head[owner]), np.minimum(high + LEAD, head[owner] + size[owner])
    sums, length = np.zeros((len(raw), len(net.labels))), end - start
    order, at = np.argsort(length, kind="stable"), 0
    width = max(16, CELLS // ((STRETCH + 2 * LEAD) * len(net.labels)))
    while at < len(order):
        own = order[at : at + width]
        at += width
        n, step = length[own], np.arange(length[own].max())[:, None]
        fore, back = buf[np.minimum(start[own] + step, len(buf) - 1)], buf[np.maximum(end[own] - 1 - step, 0)]
        p = net.positions(fore, back, n)
        counts = (step >= low[own] - start[own]) & (step < high[own] - start[own])
        np.add.at(sums, owner[own], np.einsum("tln,tn->nl", p, counts, dtype=np.float64))
    out[some] = sums / size[:, None]
    return out


def fit(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = FIT_DOCS, chars: int = FIT_CHARS, languages: int = LANGUAGES) -> ByteGru | None:
    """Network fitted on about ``per_language`` documents of each of the ``languages`` most frequent languages, ``chars`` characters of each.

    Those characters start at a place that the text's own digest gives.
    """
    rows = bounded_sample(docs.where(learn & F.col(text).isNotNull()), lang, per_language, key, languages)
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1
    rows = rows.select(F.col(key).cast("string").alias("k"), F.substring(F.col(text), place.cast("int"), F.lit(chars)).alias("t"), F.col(lang).alias("l")).collect()
    rows.sort(key=lambda r: (str(r["k"]), r["t"], r["l"]))
    return train([(r["t"], r["l"]) for r in rows])


def identify(docs: DataFrame, net: ByteGru | None, *, text: str = "text", keep_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, under ``names``, which replace columns of those names; ``text`` goes unless ``keep_text``."""
    at_text = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if (keep_text or i != at_text) and c not in names]
    fields = [docs.schema.fields[i] for i in kept]
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                p = pool(net, batch.column(at_text).to_pylist()) if net else np.zeros((batch.num_rows, 1))
                best = p.argmax(axis=1)
                score = p[np.arange(len(p)), best]
                pred = [net.labels[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)] if net else ["und"] * len(p)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(score.clip(0, 1), pa.float64())], names=schema.names)

    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)
    return out.toDF(*[f.name for f in fields], *names)
