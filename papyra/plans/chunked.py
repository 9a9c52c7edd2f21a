"""Translating documents chunk by chunk: memory, chunks, glossary, replies checked against requests, repairs.

A document's distinct paragraphs that have something to translate and that the memory lacks are cut
into chunks. Chunks go to the service in order, each with the terms agreed so far that it shows. A
reply counts only if it answers for exactly the segments asked for, none of them blank; a second try
is all there is, and a chunk that fails leaves its paragraphs to be translated one by one. A term
keeps its first rendering. At the end, renderings that lost are replaced in what this run has written.

Whose terms are agreed when a chunk is asked hangs on all chunks before it, so a document is one fold,
and documents are folded in parallel. Only the lookup in the memory and the way back to documents
shuffle. The stand-in service lives here too; a real one has the same ``ask``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import is_trivial
from papyra.operators import paragraphs as P
from papyra.operators.terms import Glossary

TRIES = 2
#: Facts that a document is described by, in their order, and what stands before them (fixed values).
DESCRIBED, HEAD = ("title", "field", "topic", "summary"), "This document:\n"
UNIT = "struct<i:int,text:string,cache_key:string,translation:string,chunk:int,source:string>"
RUN = f"units array<{UNIT}>, terms map<string,string>, forms map<string,string>, chunks int, asked int"


class ChunkService(Protocol):
    """Answers with JSON: {"segments": [{"id", "text"}], "terms": [{"source", "target", "forms"}]}."""

    def ask(self, preface: str, glossary: list[tuple[str, str]], segments: list[tuple[int, str]]) -> str: ...


def preface(facts: dict[str, str] | None) -> str:
    """What never changes while a document is translated, so that a service may keep it."""
    known = facts or {}
    said = "".join(f"{name.capitalize()}: {known[name]}\n" for name in DESCRIBED if known.get(name))
    return f"{HEAD}{said}\n" if said else ""


def chunk_numbers(sizes: list[int], limit: int) -> list[int]:
    out, used = [], 0
    for n in sizes:
        new = bool(out) and used + n > limit
        used = n if new else used + n
        out.append((out[-1] if out else 0) + new)
    return out


def terms_of(reply: dict) -> list[tuple[str, str, list[str]]]:
    """Proposed terms; a malformed one costs itself, never the translations that came with it."""
    said = reply.get("terms")
    out = []
    for t in said if isinstance(said, list) else ():
        if isinstance(t, dict) and isinstance(t.get("source"), str) and isinstance(t.get("target"), str):
            forms = t.get("forms")
            out.append((t["source"], t["target"], [f for f in forms if isinstance(f, str)] if isinstance(forms, list) else []))
    return out


def checked(raw: str, wanted: set[int]) -> tuple[dict[int, str], dict] | None:
    """Translations by id, and the whole reply, if it answers for exactly the ids wanted and no text is blank."""
    try:
        reply = json.loads(raw)
        said = [(int(s["id"]), str(s["text"])) for s in reply["segments"]]
    except (ValueError, TypeError, KeyError):
        return None
    answers = dict(said)
    blank = any(not t or t.isspace() for t in answers.values())
    return None if blank or answers.keys() ^ wanted else (answers, reply)


def fold(units: list[dict], facts: dict[str, str] | None, service: ChunkService, limit: int = P.CHUNK_CHARS, tries: int = TRIES, stop: Callable[[], bool] | None = None) -> dict:
    """A document's units (i, text, cache_key, and a translation where the memory has one) translated in order.

    ``stop`` is asked before each chunk; what is left then stays untranslated.
    """
    glossary, head, asked = Glossary(), preface(facts), 0
    todo = [u for u in units if u["translation"] is None]
    numbers = chunk_numbers([len(u["text"]) for u in todo], limit)
    out = [{**u, "chunk": None, "source": "memory"} for u in units if u["translation"] is not None]
    for n in dict.fromkeys(numbers):
        group = [u for u, k in zip(todo, numbers, strict=True) if k == n]
        known, good = glossary.matching(" ".join(u["text"] for u in group)), None
        for _ in range(0 if stop and stop() else tries):
            asked += 1
            try:
                good = checked(service.ask(head, known, [(u["i"], u["text"]) for u in group]), {u["i"] for u in group})
            except (OSError, RuntimeError):
                continue
            if good:
                break
        if good:
            glossary.add(terms_of(good[1]))
        out += [{**u, "translation": good[0][u["i"]] if good else None, "chunk": n, "source": "service" if good else "left"} for u in group]
    for u in out:
        if u["source"] == "service":
            for lost, kept in glossary.fixups().items() if u["translation"] else ():
                u["translation"] = u["translation"].replace(lost, kept)
    return {"units": sorted(out, key=lambda u: u["i"]), "terms": glossary.terms, "forms": glossary.forms, "chunks": len(set(numbers)), "asked": asked}


def translate_documents(docs: DataFrame, memory: DataFrame, make: Callable[[], ChunkService], *, key: str = "doc_id", limit: int = P.CHUNK_CHARS, tries: int = TRIES, profiles: DataFrame | None = None, stop: Callable[[], bool] | None = None) -> DataFrame:
    """key, units, terms, forms, chunks, asked for each document (key, paras) that has a unit.

    ``memory`` has cache_key and translation; ``profiles`` key and facts (a map). Write the result once
    before it is read twice: each reading asks the service.
    """
    keyed = P.keys(docs, key).where(~is_trivial(F.col("text")))
    found = keyed.join(memory.select("cache_key", "translation"), "cache_key", "left")
    one = F.struct("i", "text", "cache_key", "translation")
    jobs = found.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("units"))  # bounded by the document
    jobs = jobs.join(profiles.select(key, "facts"), key, "left") if profiles is not None else jobs.withColumn("facts", F.lit(None).cast("map<string,string>"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for batch in batches:
            done = [fold([dict(u) if isinstance(u, dict) else u.asDict() for u in units], dict(facts) if facts is not None else None, service, limit, tries, stop) for units, facts in zip(batch["units"], batch["facts"], strict=True)]
            yield pd.DataFrame({key: batch[key], **{c: [d[c] for d in done] for c in ("units", "terms", "forms", "chunks", "asked")}})

    return jobs.select(key, "units", "facts").mapInPandas(run, f"{key} {kind}, {RUN}")


def units(run: DataFrame, key: str = "doc_id") -> DataFrame:
    return run.select(key, F.inline("units"))


def written(run: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a run adds to the memory; units without an honest key are not remembered."""
    return units(run, key).where("source = 'service' AND cache_key IS NOT NULL").select("cache_key", "translation")


class ScriptedService:
    """A stand-in: segments behind a rendering of the chunk's first word, which every other chunk renders anew.

    Chunks whose first segment's number leaves 1 modulo 3 are answered wrongly at first, those that leave 2 modulo 7 always.
    """

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def ask(self, preface: str, glossary: list[tuple[str, str]], segments: list[tuple[int, str]]) -> str:
        first, words = segments[0][0], segments[0][1].split(" ")[0]
        again = json.dumps(segments) in self.seen
        self.seen.add(json.dumps(segments))
        wrong = first % 7 == 2 or (first % 3 == 1 and not again)
        target = f"<{words}{first % 2}>"
        said = [{"id": i, "text": f"{target} {t}"} for i, t in segments]
        return json.dumps({"segments": said[:-1] if wrong else said, "terms": [{"source": words, "target": target}, {"source": 3}, None]})
