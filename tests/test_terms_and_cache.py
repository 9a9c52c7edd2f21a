"""Glossary, vocabulary, translation memory and reply checks."""

import random

import pytest

from papyra.operators import cache, terms


def glossary(*batches):
    g = terms.Glossary()
    for b in batches:
        g.add(b)
    return g


def test_first_rendering_stays():
    g = glossary([("program slicing", "程序切片", None)], [("program slicing", "程序分片", None)])
    assert g.terms == {"program slicing": "程序切片"} and g.fixups() == {"程序分片": "程序切片"}


def test_nested_renderings_are_left():
    assert glossary([("slicing", "切片", None)], [("slicing", "程序切片", None)]).fixups() == {}


def test_case_and_forms():
    g = glossary([("Soundness", "可靠性", ["sound", "unsound", "soundly"]), ("TIP", "TIP", None)], [("sound", "健全", None), ("tip", "提示", None), ("Fixed point", "不动点", None), ("fixed-point", "定点", None)])
    assert g.terms == {"Soundness": "可靠性", "TIP": "TIP", "tip": "提示", "Fixed point": "不动点"}
    assert g.fixups() == {"健全": "可靠性", "定点": "不动点"}


def test_shorter_names_first():
    g = glossary([("context sensitivity", "b", ["context"]), ("context", "a", None)])
    assert g.terms == {"context": "a", "context sensitivity": "b"}


def test_fold_on_spark(spark):
    rows = [("d", 1, 0, "program slicing", "程序分片", None), ("d", 0, 0, "program slicing", "程序切片", ["slices"]), ("d", 0, 1, None, "x", None), ("d", 0, 2, "s" * 81, "y", None), ("e", 0, 0, " NSA ", "NSA", [])]
    df = spark.createDataFrame(rows, "doc_id string, chunk int, pos int, source string, target string, forms array<string>")
    got = {tuple(r) for r in terms.fold_glossary(df).collect()}
    assert got == {("d", "term", "program slicing", "程序切片"), ("d", "form", "program slicing", "program slicing"), ("d", "form", "slices", "program slicing"), ("d", "fixup", "程序分片", "程序切片"), ("e", "term", "NSA", "NSA"), ("e", "form", "NSA", "NSA")}


def test_matching(spark):
    forms = spark.createDataFrame([("sound", "Soundness"), ("TIP", "TIP"), ("fixed point", "fixed point"), ("absent", "absent")], "form string, term string")
    docs = spark.createDataFrame([(1, "An Unsound fixed-point, no tip."), (2, "The TIP language")], "doc_id int, text string")
    want = {(1, "fixed point", 1), (1, "Soundness", 2), (2, "TIP", 1)}
    assert {tuple(r) for r in terms.match_terms(docs, forms).collect()} == want
    assert {tuple(r) for r in terms.match_terms(docs, forms, block=1).collect()} == want
    assert terms.match_terms(docs, forms, limit=1).count() == 2


@pytest.mark.parametrize("block", [50_000, 7])
def test_matching_by_brute_force(spark, block):
    """Forms of every length, acronyms of one and two letters too, whatever the number of automata."""
    rng = random.Random(3)
    forms = [("AI", "Artificial"), ("x", "unknown"), ("", "nothing"), ("a-b", "pair"), ("Über", "over")]
    forms += [("".join(rng.choice("abAB -") for _ in range(rng.randrange(1, 7))), f"t{rng.randrange(20)}") for _ in range(60)]
    texts = [(i, "".join(rng.choice("abABx -IÜüber") for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, "the AI says"), (91, None)]
    flat = lambda t: " ".join(t.replace("-", " ").split())
    want = set()
    for i, t in texts:
        for form, term in forms:
            f, shown = flat(form), flat(t or "")
            if f and (f.lower() in shown.lower() if len(f) >= 4 else f in shown):
                want.add((i, term))
    got = terms.match_terms(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(forms, "form string, term string"), limit=1000, block=block).collect()
    assert {(r["doc_id"], r["term"]) for r in got} == want and len(got) == len(want) and (90, "Artificial") in want


def test_grounding(spark):
    proposed = spark.createDataFrame([(1, "soundness", []), (1, "Context sensitivity", []), (1, "call string", ["call-strings"]), (1, "lattice", ["lattices"]), (1, "widening", None)], "doc_id int, term string, forms array<string>")
    excerpt = spark.createDataFrame([(1, "Soundness and context-sensitivity by call-strings.")], "doc_id int, excerpt string")
    assert {r["term"] for r in terms.grounded(proposed, excerpt).collect()} == {"soundness", "Context sensitivity", "call string"}


def test_vocabulary(spark):
    paras = spark.createDataFrame([(1, ["slice slice the slice, data flow", "data flow data-flow data flow x"]), (2, [])], "doc_id int, paras array<string>")
    got = {r["term"]: r["n"] for r in terms.vocabulary(paras).collect()}
    assert got == {"slice": 3, "data": 3, "flow": 3}
    assert {r["term"]: r["n"] for r in terms.vocabulary(paras, pairs=True).collect()} == {"data flow": 3}
    assert [r["term"] for r in terms.vocabulary(paras, top=1).collect()] == ["slice"]


def test_upsert_and_lookup(spark):
    log = spark.createDataFrame([("g", "{}", "hello", "你好", 1), ("g", "{}", "hello", "您好", 2), ("o", "{}", "hello", "ola", 1), ("g", '{"t":1}', "hello", "x", 1)], "engine string, params string, original string, translation string, write_seq long")
    memory = cache.upsert(log, ["engine", "params", "original"], "write_seq")
    assert {(r["engine"], r["params"]): r["translation"] for r in memory.collect()} == {("g", "{}"): "您好", ("o", "{}"): "ola", ("g", '{"t":1}'): "x"}
    units = spark.createDataFrame([("g", "{}", "hello"), ("g", "{}", "miss"), ("g", "{}", None)], "engine string, params string, original string")
    assert sorted((str(r["original"]), r["translation"]) for r in cache.lookup(units, memory, ["engine", "params", "original"]).collect()) == [("None", None), ("hello", "您好"), ("miss", None)]


def test_canonical_params():
    assert cache.canonical_json('{"b": [{"y": 1, "x": 2}], "a": "2"}') == cache.canonical_json('{"a": "2", "b": [{"x": 2, "y": 1}]}')
    assert cache.canonical_json('{"a": [1, 2]}') != cache.canonical_json('{"a": [2, 1]}')


def test_first_occurrences(spark):
    df = spark.createDataFrame([(1, "a", "x"), (0, "a", "y"), (2, "b", "z")], "i int, text string, note string")
    assert {(r["text"], r["i"], r["note"]) for r in cache.first_occurrences(df, "text", ["i"]).collect()} == {("a", 0, "y"), ("b", 2, "z")}


def test_alignment(spark):
    asked = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)], "chunk int, id int")
    got = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 5, "c"), (3, 0, "  ")], "chunk int, id int, text string")
    assert {r["chunk"]: (r["accepted"], r["missing"], r["extra"]) for r in cache.aligned(asked, got, "chunk", "id").collect()} == {1: (True, 0, 0), 2: (False, 1, 1), 3: (False, 0, 0), 4: (False, 1, 0)}
