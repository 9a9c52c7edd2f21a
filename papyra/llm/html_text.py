"""Main text of web pages by a recurrent block labeller.

A page is cut into leaves, the stretches of text between block tags, each with the path of tags,
classes and ids above it. A bidirectional LSTM reads the page's leaves in order, each as a hashed
vector of its path and one of its words with a few counts, and calls every leaf article or not in
the light of all the others. It is trained here, in numpy, on pages drawn from a grammar of layouts
(``html_pages``), whose labels are known. The article's leaves, decoded and with white space made
single, joined by one space in page order, are the text.

Defined results: null html counts as empty and gives an empty text, as does a page without article
text; tags that are never closed end with the page; repeated rows each get a row. Scripts, styles,
comments and the like are no leaves. Time is linear in a page's length, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_pages import Pages

#: Hashed sizes of paths and words, counts beside them, hidden units a direction, leaves read at once.
PATHS, WORDS, COUNTS, HIDDEN, CELLS = 96, 64, 8, 16, 40_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
RAW_END = re.compile(r"</[a-zA-Z]+\s*>\Z")
NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that end a leaf (fixed values); those that hold no content; those whose start closes an open one of a kind.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul video audio".split())
VOID = frozenset("hr input img meta link area base col embed source track wbr".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}
CONTAINERS = frozenset("ul ol table article section div main nav aside header footer form dl blockquote td body".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Hashed places of path elements and words, kept by a worker.
_PLACES: dict[str, int] = {}


def _place(word: str, size: int, salt: str) -> int:
    key = salt + word
    got = _PLACES.get(key)
    if got is None:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        got = _PLACES[key] = zlib.crc32(key.encode()) % size
    return got


class Element:
    """An open element: its own steps, the elements above it, and the hashed steps of all of them as bits."""

    __slots__ = ("above", "bits", "depth", "name", "steps")

    def __init__(self, name: str, steps: tuple[str, ...], above: Element | None):
        self.name, self.steps, self.above = name, steps, above
        self.depth, self.bits = len(steps) + (above.depth if above else 0), above.bits if above else 0
        for step in steps:
            self.bits |= 1 << _place(step, PATHS, "p")


class Stack:
    """Open elements, and where those of each name, and those that hold others, stand among them."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.holders: list[int] = []

    def push(self, name: str, steps: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if name in CONTAINERS:
            self.holders.append(len(self.open))
        self.open.append(Element(name, steps, self.open[-1] if self.open else None))

    def close(self, names: list[str], inside: bool) -> None:
        """Close the innermost element of these names and all in it; ``inside`` the innermost container only."""
        found = max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)
        if found < 0 or (inside and self.holders and self.holders[-1] > found):
            return
        for e in self.open[found:]:
            self.at[e.name].pop()
        del self.open[found:]
        while self.holders and self.holders[-1] >= found:
            self.holders.pop()


@dataclass
class Leaf:
    text: str
    element: Element | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        steps, e = [], self.element
        while e:
            steps[:0], e = e.steps, e.above
        return tuple(steps)


def _open_end(m: re.Match) -> bool:
    """A comment or raw element that its match ends without its closing mark."""
    if m[1]:
        return not RAW_END.search(m[0]) or not m[0].lower().rstrip(" \t\n\r\f\v>").endswith(m[1].lower())
    return m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) > 6)


def leaves(page: str) -> list[Leaf]:
    out: list[Leaf] = []
    stack, parts = Stack(), []
    linked, in_link, at = 0, 0, 0
    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(text, stack.open[-1] if stack.open else None, linked))
            parts.clear()
        linked = 0

    for m in TAG.finditer(page, 0, last):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        if at == last and _open_end(m):
            at = len(page)
        closing, name, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                stack.close([name], name not in CONTAINERS)
            else:
                if name in CLOSES:
                    stack.close(CLOSES[name].split(), True)
                if name in PARAGRAPH_ENDS:
                    stack.close(["p"], True)
                if name not in VOID:
                    said = [w for g in NAME.findall(attrs) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w] if attrs and "=" in attrs else []
                    stack.push(name, (name, *(f".{w}" for w in said)))
    if at < len(page):
        rest = page[at:]
        parts.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def vectors(page: list[Leaf]) -> np.ndarray:
    """A row for each leaf: hashed path, mean of its hashed words, counts."""
    x = np.zeros((len(page), PATHS + WORDS + COUNTS), np.float32)
    for i, leaf in enumerate(page):
        e = leaf.element
        if e:
            x[i, :PATHS] = np.unpackbits(np.frombuffer(e.bits.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little")
            x[i, _place(e.steps[-1], PATHS, "last")] = 1
        words = leaf.text.lower().split()
        x[i, PATHS : PATHS + WORDS] = np.bincount([_place(w, WORDS, "w") for w in words], minlength=WORDS) / len(words)
        stops = leaf.text.count(".") + leaf.text.count(",")
        n = len(leaf.text)
        x[i, PATHS + WORDS :] = (np.log1p(len(words)) / 4, np.log1p(stops) / 3, min(1.0, leaf.linked / n), len(words) > 12, "©" in leaf.text, i / len(page), min(e.depth if e else 0, 12) / 12, 1)
    return x


class BlockLstm:
    """Bidirectional LSTM with one logistic output a leaf; parameters are a dict of float32 arrays."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng, size = np.random.default_rng(seed), PATHS + WORDS + COUNTS
        self.h = hidden
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.15, (size, 4 * hidden))
            p[f"u{d}"] = rng.normal(0, 0.5 / hidden**0.5, (hidden, 4 * hidden))
            p[f"c{d}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        p["o"], p["ob"] = rng.normal(0, 0.3, 2 * hidden), np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at each step of x (step, page, feature)."""
        h, u = self.h, self.p[f"u{d}"]
        into = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        s = c = np.zeros((x.shape[1], h), np.float32)
        out, trace = np.empty((len(x), x.shape[1], h), np.float32), []
        for t in range(len(x)):
            a = into[t] + s @ u
            gate = 0.5 + 0.5 * np.tanh(0.5 * a[:, : 3 * h])
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(a[:, 3 * h :])
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                trace.append((s, c, i, f, o, g, tc))
            c, s = new, o * tc
            out[t] = s
        return out, trace

    @staticmethod
    def _flip(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse order, its padding staying behind."""
        t = np.arange(len(x))[:, None]
        return np.take_along_axis(x, np.where(t < n, n - 1 - t, t)[:, :, None], axis=0)

    def forward(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        f, tf = self._run(x, "f", keep)
        b, tb = self._run(self._flip(x, n), "b", keep)
        both = np.concatenate((f, self._flip(b, n)), axis=2)
        logit = both @ self.p["o"] + self.p["ob"]
        return (logit, both, tf, tb) if keep else logit

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the leaves of the batch."""
        h, p, grad = self.h, self.p, {}
        logit, both, tf, tb = self.forward(x, n, True)
        live = np.arange(len(x))[:, None] < n
        delta = np.where(live, 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y, 0).astype(np.float32) / max(1, live.sum())
        grad["o"], grad["ob"] = np.einsum("tn,tnh->h", delta, both), np.array([delta.sum()], np.float32)
        back = delta[:, :, None] * p["o"]
        for d, trace, into, seq in (("f", tf, back[:, :, :h], x), ("b", tb, self._flip(back[:, :, h:], n), self._flip(x, n))):
            u, ds_next, dc_next = p[f"u{d}"], 0.0, 0.0
            das, gu = np.empty((len(x), x.shape[1], 4 * h), np.float32), np.zeros_like(u)
            for t in range(len(x) - 1, -1, -1):
                s, c, i, f, o, g, tc = trace[t]
                ds = into[t] + ds_next
                dc = ds * o * (1 - tc * tc) + dc_next
                da = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                das[t] = da
                gu += s.T @ da
                ds_next, dc_next = da @ u.T, dc * f
            grad[f"u{d}"], grad[f"c{d}"] = gu, das.sum(axis=(0, 1))
            grad[f"x{d}"] = seq.reshape(-1, seq.shape[2]).T @ das.reshape(-1, 4 * h)
        return grad


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in pages])
    x = np.zeros((n.max(), len(pages), pages[0].shape[1]), np.float32)
    for i, v in enumerate(pages):
        x[: len(v), i] = v
    return x, n


def drawn_page(pages: Pages) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a page of the grammar; a private-use mark tells article leaves, and is taken out."""
    markup = "".join(("\ue000" + t if label == 1 else t) for t, label in pages.page())
    found = leaves(markup)
    y = np.array(["\ue000" in f.text for f in found], np.float32)
    return vectors([Leaf(f.text.replace("\ue000", "") or "x", f.element, f.linked) for f in found]), y


def train(n_pages: int = 2400, rounds: int = 5, batch: int = 16, rate: float = 0.01, seed: int = 3) -> BlockLstm:
    """Labeller fitted by Adam on ``n_pages`` drawn pages; the same parameters on every run."""
    source, net, rng = Pages(seed), BlockLstm(seed=seed), np.random.default_rng(seed)
    data = [p for p in (drawn_page(source) for _ in range(n_pages)) if len(p[1])]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step, total = 0, rounds * -(-len(data) // batch)
    for _ in range(rounds):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]) // 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(groups)):
            some = [data[i] for i in groups[k]]
            x, n = _batch([s[0] for s in some])
            y = np.zeros(x.shape[:2], np.float32)
            for i, s in enumerate(some):
                y[: len(s[1]), i] = s[1]
            step += 1
            now = rate * (1 - step / (total + 1))
            for name, g in net.gradients(x, n, y).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label(net: BlockLstm, pages: list[list[Leaf]]) -> list[np.ndarray]:
    """Probability of each leaf of each page; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end - at + 1) <= CELLS and len(pages[order[end]]) <= len(pages[order[at]]) * 1.3 + 4:
            end += 1
        x, n = _batch([vectors(pages[i]) for i in order[at:end]])
        p = 1 / (1 + np.exp(-np.clip(net.forward(x, n), -30, 30)))
        for j, i in enumerate(order[at:end]):
            out[i] = p[: n[j], j]
        at = end
    return out


def extract(pages: DataFrame, net: BlockLstm, *, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (of the article) for each row of ``pages``."""
    schema = T.StructType([T.StructField("page_id", pages.schema[key].dataType), T.StructField("url", pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [leaves(h) if h else [] for h in batch.column(2).to_pylist()]
                main = [[f.text for f, p in zip(page, prob, strict=True) if p >= 0.5] for page, prob in zip(found, label(net, found), strict=True)]
                text = [" ".join(m) for m in main]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(m) for m in main], pa.int64())], names=schema.names)

    return pages.select(F.col(key), F.col(url), F.col(markup)).mapInArrow(run, schema)
