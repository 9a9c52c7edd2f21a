"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

One pass over the texts finds candidate spans: matches of the strict patterns, matches they drop
(a part over 255, a failed check digit), and looser forms (written-out addresses, local telephone
numbers, credentials). Regex, gazetteer, context and shape labelers each vote on a candidate, for,
against, or not at all. Votes of the whole corpus are counted by pattern, of which there are few
whatever the corpus; expectation-maximisation on those counts estimates each labeler's reliability
and gives a pattern its probability. A logistic span classifier, trained on those probabilities over
a bounded sample of candidates, then decides on every candidate from its votes, shape and context.
Strict matches are always kept; the classifier adds others that overlap none of them.

Defined results: null text counts as empty; an empty text or table gives no spans; repeated rows
each get a row; positions are code points, ends exclusive. All patterns take linear time on long runs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
#: Candidates that the span classifier is fitted on, at most; hashed features; EM rounds; rows of a batch at a time.
FIT_ROWS, HASHED, EM_ROUNDS, ROWS = 20_000, 256, 60, 1024

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPELT = re.compile(r"(?<![^\s<(])([A-Za-z0-9][A-Za-z0-9._-]{0,63})\s?(?:\(at\)|\[at\]|\sat\s)\s?([A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]{1,63}){1,4})", re.I)
#: What every match of SPELT holds, and the most characters that stand before and after its start in one.
AT, BEFORE, AFTER = re.compile(r"\(at\)|\[at\]|\sat\s", re.I), 65, 400
NATIONAL = re.compile(r"(?<![\w.+@-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w@-])")
NAMED = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|xox[bp]-|sk-)[A-Za-z0-9_-]{12,}")

#: Gazetteers and context words (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at us ca jp cn".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "81", "82", "86", "90", "91")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "xox", "sk-")
NEAR = re.compile(r"\b(?:e-?mail|mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|iban|host|server|address|login|password|passwd|pwd|token|secret|key|credential)s?\b", re.I)
AGAINST = re.compile(r"\b(?:version|license|licence|page|pages|figure|chapter|section|isbn|issn|doi|release|build|table|vol|volume)\b[^\n]{0,12}$", re.I)
LABELERS = ["strict", "loose", "gazetteer", "near", "against", "shape"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def strict_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end, whether it passes; leftmost and non-overlapping in each kind, failing matches not tried again."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end, True
    if DIGIT.search(text):
        for m in IP.finditer(text):
            yield "ip", m.start(), m.end(), all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) >= 12:
                    yield "card", m.start(), m.end(), len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield "phone", m.start(), m.end(), 9 <= len(DIGIT.findall(m[0])) <= 15


def _loose_matches(text: str) -> Iterator[tuple[str, int, int]]:
    end = 0
    for at in AT.finditer(text):
        if at.start() >= end and (m := SPELT.search(text, max(end, at.start() - BEFORE), at.start() + AFTER)):
            end = m.end()
            yield "email", m.start(), end
    if DIGIT.search(text):
        for m in NATIONAL.finditer(text):
            yield "phone", m.start(), m.end()
    if "=" in text or ":" in text:
        for m in NAMED.finditer(text):
            yield "secret", m.start(1), m.end(1)
    if any(h in text for h in KEY_HEADS):
        for m in KEY.finditer(text):
            yield "secret", m.start(), m.end()


def _votes(kind: str, text: str, start: int, end: int, passes: bool | None) -> list[int]:
    span, before = text[start:end], text[max(0, start - 48) : start]
    digits = "".join(c for c in span if "0" <= c <= "9")
    strict = 0 if passes is None else 1 if passes else -1
    loose = 1 if passes is None or passes else 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\s\])]+", span.lower())[-1] in TOP_DOMAINS else -1
        shape = 1 if 5 <= len(span) <= 80 else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(CALLING_CODES) and span[0] == "+" else 0
        shape = 1 if 9 <= len(digits) <= 15 else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    elif kind == "ip":
        gazetteer = -1 if span.startswith(("0.", "255.")) else 0
        shape = 1 if all(len(x) <= 3 for x in span.split(".")) else -1
    else:
        gazetteer = 1 if span.startswith(KEY_HEADS) else 0
        shape = 1 if digits and len(set(span)) * 2 >= min(len(span), 16) else -1
    return [strict, loose, gazetteer, 1 if NEAR.search(before) else 0, -1 if AGAINST.search(before) else 0, shape]


def _features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Hashed shape trigrams of the span and words before it."""
    span = text[start : min(end, start + 64)]
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", f"^{span}$"))
    keys = {f"s{kind}{shape[i : i + 3]}" for i in range(len(shape) - 2)}
    keys |= {f"w{kind}{w.lower()}" for w in re.findall(r"\w+", text[max(0, start - 32) : start])[-2:]}
    keys.add(f"l{kind}{min(9, (end - start) // 4)}")
    return sorted({zlib.crc32(k.encode()) % HASHED for k in keys})


CANDIDATE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))])


def find_candidates(text: str) -> list[dict]:
    seen, out = set(), []
    found = [(k, s, e, p) for k, s, e, p in strict_matches(text)]
    found += [(k, s, e, None) for k, s, e in _loose_matches(text)]
    for kind, start, end, passes in found:
        if (start, end) not in seen or passes:
            seen.add((start, end))
            votes = "".join("-0+"[v + 1] for v in _votes(kind, text, start, end, passes))
            out.append({"kind": kind, "start": start, "end": end, "base": bool(passes), "votes": votes, "features": _features(kind, text, start, end)})
    return out


def estimate_reliability(patterns: list[tuple[str, str, int]], rounds: int = EM_ROUNDS) -> tuple[dict, np.ndarray]:
    """Posterior of each (kind, votes) and P(vote | truth) of each labeler, by EM over pattern counts."""
    if not patterns:
        return {}, np.full((2, len(LABELERS), 3), 1 / 3)
    votes = np.array([["-0+".index(c) for c in v] for _, v, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))  # the start: majority
    for _ in range(rounds):
        prior = np.clip(((n * post).sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
        table = np.ones((2, votes.shape[1], 3))
        for v in range(3):
            table[1, :, v] += (n * post) @ (votes == v)
            table[0, :, v] += (n * (1 - post)) @ (votes == v)
        table /= table.sum(axis=2, keepdims=True)
        at = np.arange(votes.shape[1])
        logit = np.log(prior / (1 - prior)) + (np.log(table[1, at, votes]) - np.log(table[0, at, votes])).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {(k, v): float(p) for (k, v, _), p in zip(patterns, post, strict=True)}, table


def _design(kinds: list[str], votes: list[str], features: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(kinds), 1 + len(KINDS) + 3 * len(LABELERS) + HASHED))
    x[:, 0] = 1
    for i, (k, v, f) in enumerate(zip(kinds, votes, features, strict=True)):
        x[i, 1 + KINDS.index(k)] = 1
        for j, c in enumerate(v):
            x[i, 1 + len(KINDS) + 3 * j + "-0+".index(c)] = 1
        x[i, 1 + len(KINDS) + 3 * len(LABELERS) + np.array(f, int)] = 1 / max(1, len(f)) ** 0.5
    return x


def fit_classifier(kinds: list[str], votes: list[str], features: list[list[int]], target: np.ndarray, rounds: int = 300, step: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    x = _design(kinds, votes, features)
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= step * (x.T @ (p - target) / len(x) + ridge * w)
    return w


class Judge:
    """The trained span classifier: strict matches stay, other candidates it believes in are added."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def spans(self, candidates: list[dict]) -> tuple[list[tuple], list[tuple]]:
        """Base spans, and all spans, as (start, kind number, end) in order."""
        base = sorted((c["start"], KINDS.index(c["kind"]), c["end"]) for c in candidates if c["base"])
        extra = [c for c in candidates if not c["base"]]
        # of the base spans that start before a place, the furthest end; spans added so far are disjoint
        starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
        added: list[tuple] = []
        for c in self.by_belief(extra):
            k, i = bisect_left(starts, c["end"]), bisect_left(added, (c["end"],))
            if not (k and reach[k - 1] > c["start"]) and not (i and added[i - 1][2] > c["start"]):
                added.insert(i, (c["start"], KINDS.index(c["kind"]), c["end"]))
        return base, sorted(base + added)

    def by_belief(self, extra: list[dict]) -> list[dict]:
        """The candidates that the classifier believes in, the surest first."""
        sure = []
        for at in range(0, len(extra), ROWS):
            some = extra[at : at + ROWS]
            belief = _design([c["kind"] for c in some], [c["votes"] for c in some], [c["features"] for c in some]) @ self.weights
            sure += [(-s, c["start"], c["end"], at + i) for i, (c, s) in enumerate(zip(some, belief.tolist(), strict=True)) if s > 0]
        return [extra[i] for *_, i in sorted(sure)]


ARROW_CANDIDATES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def candidate_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """c0 (the key) and the array of candidates of each row's text."""
    schema = T.StructType([T.StructField("c0", docs.schema[key].dataType), T.StructField("candidates", T.ArrayType(CANDIDATE))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [find_candidates(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_CANDIDATES)], names=schema.names)

    return docs.select(key, text).mapInArrow(look, schema)


def fit(looked: DataFrame) -> Judge:
    """Reliabilities from the votes of all candidates, then the classifier on a bounded sample of them."""
    each = looked.select("c0", F.explode("candidates").alias("c")).select("c0", "c.*")
    counts = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 5 * 3**6 patterns
    posterior, _ = estimate_reliability(sorted((r["kind"], r["votes"], r["n"]) for r in counts))
    sample = each.orderBy(F.xxhash64("c0", "start", "end"), "kind", "start").select("kind", "votes", "features").limit(FIT_ROWS).collect()
    target = np.array([posterior[r["kind"], r["votes"]] for r in sample])
    return Judge(fit_classifier([r["kind"] for r in sample], [r["votes"] for r in sample], [r["features"] for r in sample], target))


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    ``found`` is the array of (kind, start, end) that ``spans`` writes as text. Texts are read once;
    what the second step works on is the small table of candidates.
    """
    looked = cut(candidate_rows(docs, key, text))
    judge = fit(looked)
    out_fields = [T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    found_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, spans, founds = [], [], []
            for cands in batch.column(1).to_pylist():
                base, every = judge.spans(cands or [])
                for j in range(len(BASE_KINDS)):
                    counts[j].append(sum(k == j for _, k, _ in base))
                digests.append(hashlib.sha256(say(base).encode()).hexdigest())
                spans.append(say(every))
                founds.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(founds, found_kind)], names=[f.name for f in out_fields])

    return looked.mapInArrow(decide, T.StructType(out_fields))


def redact(text: str | None, found: list[tuple]) -> str | None:
    """``text`` with each (start, kind number, end) replaced by its kind in brackets; overlapping spans are replaced as one."""
    if text is None or not found:
        return text
    out, at = [], 0
    for start, kind, end in sorted(found, key=lambda x: (x[0], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all found spans in ``text`` replaced. Texts are scanned twice rather than stored or joined."""
    seen = candidate_rows(docs, key, text).where(F.size("candidates") > 0)
    judge, at_text = fit(cut(seen)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(at_text).to_pylist()
                new = [redact(t, judge.spans(find_candidates(t))[1]) if t else t for t in texts]
                cols = list(batch.columns)
                cols[at_text] = pa.array(new, cols[at_text].type)
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*docs.columns)
