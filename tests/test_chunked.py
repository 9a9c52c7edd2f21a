"""Chunks, replies, glossary, repairs, resuming and cancelling of document translation."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import paragraphs as P
from papyra.operators import regions, terms
from papyra.plans import chunked, runs
from papyra.sources import files


def units(*texts, known=None):
    return [{"i": i, "text": t, "cache_key": t, "translation": (known or {}).get(t)} for i, t in enumerate(texts)]


class Service:
    """Answers from a list, a reply for each call; keeps what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def ask(self, preface, glossary, segments):
        self.asked.append((preface, glossary, segments))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def reply(segments, terms=()):
    return json.dumps({"segments": [{"id": i, "text": t} for i, t in segments], "terms": list(terms)})


def test_chunks():
    assert chunked.chunk_numbers([700] * 5, 2000) == [0, 0, 1, 1, 2]
    assert chunked.chunk_numbers([5000], 1000) == [0] and chunked.chunk_numbers([10, 5000, 10], 1000) == [0, 1, 2]


def test_replies_must_answer_for_what_was_asked():
    assert chunked.checked(reply([(1, "a"), (2, "b")]), {1, 2})[0] == {1: "a", 2: "b"}
    for bad in ("no json", "[]", "{}", reply([(1, "a")]), reply([(1, "a"), (2, "b"), (3, "c")]), reply([(1, "a"), (2, "  ")]), '{"segments": [{"id": "x", "text": ""}]}'):
        assert chunked.checked(bad, {1, 2}) is None
    said = {"terms": [{"source": "a", "target": "b", "forms": "as"}, {"source": "c", "target": "d", "forms": ["cs", 3]}, {"source": "e"}, None, "x"]}
    assert chunked.terms_of(said) == [("a", "b", []), ("c", "d", ["cs"])] and chunked.terms_of({"terms": 5}) == [] == chunked.terms_of({})


def test_fold():
    service = Service(reply([(0, "X")]), reply([(0, "slice T1 text")], [{"source": "Slice", "target": "T1"}]), OSError("once"), reply([(2, "T2 again")], [{"source": "slice", "target": "T2"}]), reply([(9, "?")]), reply([(9, "?")]))
    some = units("slice of text", "known", "slice again", "never told", known={"known": "K"})
    service.replies[0] = reply([(0, "x"), (7, "y")])
    got = chunked.fold(some, {"title": "Paper", "field": ""}, service, limit=5)
    assert [(u["translation"], u["chunk"], u["source"]) for u in got["units"]] == [("slice T1 text", 0, "service"), ("K", None, "memory"), ("T1 again", 1, "service"), (None, 2, "left")]
    assert got["terms"] == {"Slice": "T1"} and (got["chunks"], got["asked"]) == (3, 6)
    assert {a[0] for a in service.asked} == {"This document:\nTitle: Paper\n\n"}
    assert [a[1] for a in service.asked] == [[], [], [("Slice", "T1")], [("Slice", "T1")], [], []]
    stopped = chunked.fold(units("abc", "def"), None, Service(), stop=lambda: True)
    assert [u["source"] for u in stopped["units"]] == ["left", "left"] and stopped["asked"] == 0


def test_agreed_terms():
    g = terms.Glossary()
    g.add([("fixed point", "F", ["fixpoints"]), ("TIP", "T", None), ("context-sensitivity", "C", None)])
    assert g.matching("Fixpoints in TIP, context sensitivity and tips") == [("context-sensitivity", "C"), ("fixed point", "F"), ("TIP", "T")]
    assert g.matching("tip") == [] and len(g.matching("fixed-point TIP", 1)) == 1


@pytest.fixture
def docs(spark):
    long = "a long paragraph that is remembered under itself " * 5
    rows = [(1, f"Title here\n{long}\nshort one\n12"), (2, f"Other title\n{long}\nshort two"), (3, "")]
    return P.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))


def test_resumed_runs_ask_for_what_is_missing(spark, docs, tmp_path):
    path = str(tmp_path / "memory")
    assert runs.read_translations(spark, path).count() == 0
    first = runs.translate_into(docs.where("doc_id = 1"), path, 1, chunked.ScriptedService).collect()
    again = runs.translate_into(docs, path, 2, chunked.ScriptedService, profiles=spark.createDataFrame([(2, {"title": "t"})], "doc_id long, facts map<string,string>")).collect()
    assert {r["cache_key"] for r in first} < {r["cache_key"] for r in again}
    memory = runs.read_translations(spark, path)
    rest = chunked.units(chunked.translate_documents(docs, memory, chunked.ScriptedService))
    told = rest.join(memory.select("cache_key"), "cache_key", "left_semi").collect()
    assert {r["source"] for r in told} == {"memory"} and len(told) >= len(again)
    # the same run again replaces its own rows: what it had told is asked for by the next one
    assert sorted(runs.translate_into(docs, path, 2, chunked.ScriptedService).collect()) == sorted(first)
    assert {r["cache_key"] for r in runs.translate_into(docs, path, 3, chunked.ScriptedService).collect()} == {r["cache_key"] for r in again}


def test_batches_overwrite_themselves(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for place in ("a", "b"):  # the second query starts anew and writes the same batch again
        query = runs.idempotent(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / place)).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_cancel(spark):
    slow = spark.range(4).repartition(4).mapInPandas(lambda batches: (time.sleep(30) or b for b in batches), "id long")
    failed = []

    def work():
        try:
            runs.cancellable(spark, "run-7", slow.count)
        except Exception as e:
            failed.append(str(e))

    thread = threading.Thread(target=work)
    thread.start()
    began = time.time()
    while thread.is_alive() and time.time() - began < 25:
        time.sleep(0.5)
        runs.cancel(spark, "run-7")
    thread.join(5)
    assert failed and "cancel" in failed[0].lower() and time.time() - began < 28


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    assert one(X.without_thinking_streamed(F.lit("<think>a\n</think>\n\n</think>\n b "))) == "b"
    assert one(X.without_thinking_streamed(F.lit("a <think>b</think>"))) == "a <think>b</think>"
    page = '<div class="t0">no</div><div class="result-container">a &amp; b&#8203;&eacute;</div>'
    assert one(X.found_translation(F.lit(page))) == "no"
    assert one(X.found_translation(F.lit(page[25:]))) == "a & bé" and one(X.found_translation(F.lit("nothing"))) is None
    agreed = F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target")), F.struct(F.lit("c").alias("source"), F.lit("d").alias("target")))
    said = one(X.prompt_preface({"field": F.lit("logic")}, agreed))
    assert said.endswith("Use these agreed translations where they apply: a -> b; c -> d\n\n") and "Field: logic" in said
    assert one(X.prompt_preface({"field": F.lit("")}, F.slice(agreed, 1, 0))) == "" and one(X.clipped(F.lit("añb"), 2)) == "añ"


def test_lookups(spark, tmp_path):
    files.save_regions(spark.createDataFrame([("k", 1, 0.0, 0.0, 1.0, 1.0), ("m", 2, 0.0, 0.0, 1.0, 1.0)], "doc_key string, page int, x0 double, y0 double, x1 double, y1 double"), str(tmp_path / "r"))
    assert [r["page"] for r in files.load_regions(spark, str(tmp_path / "r"), spark.createDataFrame([("m",)], "doc_key string")).collect()] == [2]
    assert files.load_regions(spark, str(tmp_path / "r")).count() == 2
    profiles = spark.createDataFrame([("k", {"field": "x"}, {"a": "b"})], "doc_key string, facts map<string,string>, terms map<string,string>")
    jobs = spark.createDataFrame([("j1", "k"), ("j2", "z")], "job string, doc_key string")
    assert {r["job"]: r["facts"] for r in files.with_profiles(jobs, profiles).collect()} == {"j1": {"field": "x"}, "j2": None}
    packs = spark.createDataFrame([("en", "de", 2, "late"), ("en", "de", 1, "early")], "source string, target string, i int, name string")
    assert [r["name"] for r in files.language_pack(packs, spark.createDataFrame([("en", "de"), ("en", "fr")], "source string, target string")).collect()] == ["early"]
    blocks = spark.createDataFrame([("d", 4, "x")], "doc string, page int, block string")
    wanted = spark.createDataFrame([("d", [7, 4])], "doc string, pages array<int>")
    assert [(r["ordinal"], r["block"]) for r in regions.by_ordinal(wanted, blocks).collect()] == [(1, "x")]
