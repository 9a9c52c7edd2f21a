"""Token counts by prefix dynamic programming over a word-wise byte-pair vocabulary.

A text is normalised and cut into pieces by the vocabulary's own rules; tokens never leave a piece.
A sequence of tokens is what byte-pair merging makes of its bytes if and only if every two neighbours
in it stay apart when they are merged alone. So for each prefix of a piece there is one last token
that fits behind the last token of what stands before it, and the count obeys

    N(prefix) = N(prefix without its last token) + 1

``Run`` fills that table byte by byte: the token that ends at each place inside a piece, and the count
of the piece if it ended there. Counts at every prefix of a text are sums of such tables, so questions
of truncation and budget are read off and nothing is encoded again. The tokenizer library is not used;
tests hold the counts against it at every prefix. Tables of repeated pieces are kept by a worker.

Defined results: null text counts as empty; empty text has 0 tokens; repeated rows each get a row.
Strings of special tokens inside a text are one token each, as in the library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Chunks, and pieces, that a worker keeps; token pairs whose meeting it remembers.
CACHE_LIMIT, PAIR_LIMIT = 600_000, 2_000_000
#: Rows of a batch that are worked on together.
ROWS = 512


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies, by their published rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by their bytes, inside a piece and at its end, and which pairs of them stay apart."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0].get("invert"):
            raise ValueError("a byte-pair vocabulary with word ends, cut by a pattern into pieces of bytes, is needed")
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        if not kinds <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalisers that are not known here: {sorted(kinds)}")
        self.composes, self.lowers = "NFC" in kinds, "Lowercase" in kinds
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        end, byte = model["end_of_word_suffix"], byte_symbols()
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(end))
        vocab, self.made, self.parts, self.merged = model["vocab"], {}, {}, {}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t in (*byte, *(c + end for c in byte)):
            if t in vocab:
                self.made[vocab[t]] = -1
                (self.final if t.endswith(end) else self.inner)[raw(t)] = vocab[t]
        for time, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = (time, token)
            if token not in self.made:
                self.made[token], self.parts[token] = time, (vocab[a], vocab[b])
                (self.final if b.endswith(end) else self.inner)[raw(a + b)] = token
        #: by a token's bytes: the token inside a piece, and the one at its end
        self.named = {t: (self.inner.get(t), self.final.get(t)) for t in {**self.inner, **self.final}}
        self.longest = max(map(len, self.named))
        self.automaton = ahocorasick.Automaton()
        for t, both in self.named.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), *both))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Merging the bytes of both ends in these two tokens: no merge across their border comes before them."""
        if len(self.known) >= PAIR_LIMIT:
            self.known.clear()
        got = self.known[left, right] = self._stay(left, right)
        return got

    def _stay(self, left: int, right: int) -> bool:
        before = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across[0] < before:
                return False
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            # take the later of the two merges back; of the same merge the left place comes first
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]


class Run:
    """The table of a growing piece: last tokens and counts of its inner prefixes, counts of it ending at each byte."""

    __slots__ = ("counts", "last", "raw", "totals", "words")

    def __init__(self, words: Vocabulary, raw: bytes = b""):
        self.words, self.raw, self.last, self.counts, self.totals = words, b"", [None], [0], [0]
        if raw:
            self.fill(raw)

    def fill(self, raw: bytes) -> None:
        """The table of a whole piece; the automaton names only the stretches that are tokens, those with one end after another."""
        apart, known, n = self.words.apart, self.words.known, len(raw)
        self.raw, self.last, self.counts, self.totals = raw, [None] * (n + 1), [0] + [None] * n, [0] + [None] * n
        last, counts, totals = self.last, self.counts, self.totals
        for end, (size, inner, final) in self.words.automaton.iter(raw.decode("latin-1")):
            end += 1
            start = end - size
            if not start:
                if inner is not None:
                    last[end], counts[end] = inner, 1
                if final is not None:
                    totals[end] = 1
                continue
            before = last[start]
            if before is None:
                continue  # no token ends here
            if inner is not None and last[end] is None:
                fits = known.get((before, inner))
                if fits or (fits is None and apart(before, inner)):
                    last[end], counts[end] = inner, counts[start] + 1
            if final is not None and totals[end] is None:
                fits = known.get((before, final))
                if fits or (fits is None and apart(before, final)):
                    totals[end] = counts[start] + 1

    def extend(self, more: bytes) -> None:
        raw = self.raw = self.raw + more
        named, apart, known, longest = self.words.named, self.words.apart, self.words.known, self.words.longest
        last, counts, totals = self.last, self.counts, self.totals
        for end in range(len(last), len(raw) + 1):
            token = count = total = None
            for start in range(max(0, end - longest), end):
                both = named.get(raw[start:end])
                if both is None:
                    continue
                inner, final = both
                before = last[start]
                if start and before is None:
                    continue  # no token ends here
                if count is None and inner is not None:
                    fits = True if not start else known.get((before, inner))
                    if fits or (fits is None and apart(before, inner)):
                        token, count = inner, counts[start] + 1
                if total is None and final is not None:
                    fits = True if not start else known.get((before, final))
                    if fits or (fits is None and apart(before, final)):
                        total = counts[start] + 1
                if count is not None and total is not None:
                    break
            last.append(token)
            counts.append(count)
            totals.append(total)

    def cut(self, n: int) -> None:
        self.raw = self.raw[:n]
        del self.last[n + 1 :], self.counts[n + 1 :], self.totals[n + 1 :]


class Kept(dict):
    """Values worked out when they are first asked for, at most ``limit`` of them at a time."""

    def __init__(self, work: Callable[[str], object], limit: int):
        self.work, self.limit = work, limit

    def __missing__(self, key: str) -> object:
        value = self.work(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Exact token counts at all prefixes of a text."""

    def __init__(self, tokenizer_json: str, cache_limit: int = CACHE_LIMIT):
        self.words = Vocabulary(tokenizer_json)
        self._chunks, self._pieces = Kept(self._chunk_total, cache_limit), Kept(self._counts, cache_limit)
        self.chunk_total, self.counts = self._chunks.__getitem__, self._pieces.__getitem__
        self._stable = lambda s: s.isascii() or not self.words.composes or unicodedata.is_normalized("NFC", s)

    # ---- pieces

    def normal(self, text: str) -> str:
        if not text.isascii() and self.words.composes:
            text = unicodedata.normalize("NFC", text)
        if not self.words.lowers:
            return text
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # letter by letter: no final sigma

    def _counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, from the empty one on, if it is a piece of its own."""
        totals = Run(self.words, piece.encode()).totals
        return totals if piece.isascii() else [totals[i] for i in np.cumsum([0, *(len(c.encode()) for c in piece)]).tolist()]

    def _within(self, piece: str, n: int) -> int:
        """Tokens of ``piece[:n]``; a piece's prefix may fall into several pieces, as a contraction's does."""
        head = piece[:n]
        m = self.words.pattern.match(head)
        if n == len(piece) or (m and m.end() == n):
            return self.counts(piece)[n]
        return sum(self.counts(p)[-1] for p in self.words.pattern.findall(head))

    # ---- chunks: what stands between blanks

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Stretches between blanks, line feeds, tabs and carriage returns; no piece reaches over one."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _plain(self, text: str) -> int:
        return sum([n[-1] for n in map(self.counts, self.words.pattern.findall(self.normal(text)))])

    def _chunk_total(self, chunk: str) -> int:
        if self.words.special and "<" in chunk:
            plain = self.words.special.split(chunk)
            return sum(map(self._plain, plain)) + len(plain) - 1
        return self._plain(chunk)

    def _plain_prefixes(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special tokens, the empty one included."""
        if self._stable(text):
            lowered = [self.normal(c) for c in text]
            ends, z = np.cumsum([0, *map(len, lowered)]).tolist(), "".join(lowered)
            at = [0] * (len(z) + 1)
            done = before = 0
            for m in self.words.pattern.finditer(z):
                for k in range(before + 1, m.start() + 1):
                    at[k] = done
                piece = m[0]
                whole, single = self.counts(piece), self.words.pattern.fullmatch(piece[:1]) is not None and not piece.startswith("'")
                for n in range(1, len(piece) + 1):
                    at[m.start() + n] = done + (whole[n] if single else self._within(piece, n))
                done, before = done + whole[-1], m.end()
            for k in range(before + 1, len(z) + 1):
                at[k] = done
            return [at[e] for e in ends]
        # composition may change what stands before: a stretch from one sure start of a character to the next is normalised anew for each prefix
        out, done, run, kept = [0], 0, Run(self.words), ""  # ``kept`` is the open last piece, ``run`` its table
        sure = [0, *(i for i in range(1, len(text)) if _starts(text[i])), len(text)]
        for a, b in zip(sure, sure[1:], strict=False):
            for i in range(a + 1, b + 1):
                tail = self.normal(text[a:i])
                pieces = self.words.pattern.findall(kept + tail)
                last = pieces[0] if pieces == [kept + tail] else None
                if last is not None:
                    size = len(run.raw)
                    run.extend(tail.encode())
                    total = run.totals[-1]
                    if i < b:
                        run.cut(size)
                else:
                    total = sum(self.counts(p)[-1] for p in pieces)
                out.append(done + total)
            if last is not None:
                kept = last
                continue
            # what may still grow: the last piece, and a quotation mark before it that a contraction may take back
            z, n = kept + tail, len(pieces)
            while n and z.endswith("".join(pieces[n - 1 :])) and (n == len(pieces) or pieces[n - 1] == "'" and len(pieces) - n < 2):
                n -= 1
            kept = "".join(pieces[n:])
            done += sum(self.counts(p)[-1] for p in pieces[:n])
            run = Run(self.words, kept.encode())
        return out

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, the empty one included."""
        out, done, at = [0], 0, 0
        for m in self.words.special.finditer(chunk) if self.words.special else ():
            # until its last character a special token is ordinary text
            before = self._plain_prefixes(chunk[at : m.end() - 1])
            out += [done + n for n in before[1:]]
            done += before[m.start() - at] + 1
            out.append(done)
            at = m.end()
        return out + [done + n for n in self._plain_prefixes(chunk[at:])[1:]]

    # ---- texts

    def tables(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Chunks of each text, and N at the end of each."""
        for text in texts:
            chunks = self.chunks(text)
            yield chunks, np.cumsum(np.fromiter(map(self.chunk_total, chunks), np.int64, len(chunks)))

    def total(self, text: str) -> int:
        return sum(map(self.chunk_total, self.chunks(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """N of ``text[:n]`` for every n from 0 to its length."""
        out, done = [], 0
        for chunk in self.chunks(text):
            out += [done + n for n in self.chunk_prefixes(chunk)]
            done = out[-1]
        return np.array(out, np.int64)

    def count_at(self, text: str, n_chars: int) -> int:
        """Tokens of ``text[:n_chars]``."""
        start = 0
        for chunk, before in self._walk(text):
            if n_chars <= start + len(chunk):
                return before + self.chunk_prefixes(chunk)[max(0, n_chars - start)]
            start += len(chunk) + 1
        return self.total(text)

    def _walk(self, text: str) -> Iterator[tuple[str, int]]:
        before = 0
        for chunk in self.chunks(text):
            yield chunk, before
            before += self.chunk_total(chunk)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        (chunks, counts), = self.tables([text])
        return self.fit(chunks, counts, budget)

    def fit(self, chunks: list[str], counts: np.ndarray, budget: int) -> int:
        # N never falls from one chunk's end to the next; inside a chunk it may
        k = int(np.searchsorted(counts, budget, side="right"))
        whole = max(0, sum(map(len, chunks[:k])) + k - 1)
        if k == len(chunks) or budget < 0:
            return whole
        inside = np.array(self.chunk_prefixes(chunks[k])) + (int(counts[k - 1]) if k else 0)
        return (whole + 1 if k else 0) + int(np.flatnonzero(inside <= budget)[-1])


def _starts(c: str) -> bool:
    """A character that joins nothing before it."""
    return c.isascii() or unicodedata.category(c)[0] != "M" and not unicodedata.combining(c) and not 0x1160 <= ord(c) < 0x1200


#: The counter of the vocabulary in use, kept between the tasks of a worker.
_COUNTER: dict[str, PrefixCounter] = {}


def _counter(tokenizer_json: str) -> PrefixCounter:
    if tokenizer_json not in _COUNTER:
        _COUNTER.clear()
        _COUNTER[tokenizer_json] = PrefixCounter(tokenizer_json)
    return _COUNTER[tokenizer_json]


def load_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int, *, key: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_tokens, over_limit, fit_chars, and with ``prefixes`` the table itself.

    ``fit_chars`` is the length of the longest prefix that has at most ``limit`` tokens;
    ``prefix_tokens`` holds the count of each prefix, from the empty one on. The vocabulary (a few MB,
    whatever the corpus) travels with the task; texts are never shuffled.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())]
    if prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_json)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n, over, fit = [], [], []
                for text, (chunks, count) in zip(texts, counter.tables(texts), strict=True):
                    n.append(int(count[-1]))
                    over.append(n[-1] > limit)
                    fit.append(counter.fit(chunks, count, limit) if over[-1] else len(text))
                out = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(over), pa.array(fit, pa.int64())]
                if prefixes:
                    out.append(pa.array([counter.prefixes(t) for t in texts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
