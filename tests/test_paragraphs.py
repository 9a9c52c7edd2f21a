"""Paragraph, chunk and key operators on literal texts, both outcomes of each predicate."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import paragraphs as P


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def results(spark, values, make, kind="string"):
    return [r["r"] for r in column(spark, values, kind).select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(("text", "trivial"), [("n", True), ("12", True), ("1.", True), ("  ", True), ("{v3}", True), ("{v1} {v2}", True), ("—", True), ("{v٣}", True), (" ab ", True), ("\x1cab\x1f", True), ("Abstract", False), ("The cat sat.", False), ("{v0} is a set", False), ("字字字", False), ("<b3>abc</b3>", False)])
def test_trivial(spark, text, trivial):
    assert results(spark, [text], X.is_trivial) == [trivial]


def test_trivial_agrees_with_python(spark):
    import re

    rng = random.Random(1)
    alphabet = ["a", "é", "字", " ", " ", " ", "\x1c", "\x85", "1", "٣", "{v1}", "<b2>", "</b2>", "-", "…"]
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(800)]

    def plain(t):
        bare = re.sub(r"\{v\d+\}|</?b\d+>", "", t).strip()
        return len(bare) < 3 or not any(c.isalpha() for c in bare)

    assert results(spark, values, X.is_trivial) == [plain(v) for v in values]


def test_skips(spark):
    assert results(spark, ["", " 　", "{v12}", "a {v1}", "{v1}{v2}"], X.skips_translation) == [True, True, True, False, False]


def test_reply_cleaning(spark):
    values = ["<think>a\nb</think>done", "x <think>y</think>", "plain", "<think>a</think>b</think>c"]
    assert results(spark, values, X.without_thinking) == ["done", "x <think>y</think>", "plain", "b</think>c"]


def test_flat_and_fold(spark):
    assert results(spark, ["context-sensitive", " fixed  point ", "a\n-b"], X.flat) == ["context sensitive", "fixed point", "a b"]
    assert results(spark, ["TIP", "Soundness"], X.fold) == ["TIP", "soundness"]


def test_leaders(spark):
    lines = ["Syntax . . . . . 9", "Syntax . . . . 9", "Syntax .\x1c.\x1c.\x1c.", "·····", "wait... what", "a . . b"]
    assert results(spark, lines, lambda c: F.rlike(c, F.lit(X.LEADER))) == [True, True, True, True, False, False]


def test_scripts(spark):
    values = ["漢字かなカナ", "한국어", "привет", "hello é", "Ω"]
    assert results(spark, values, lambda c: X.script_count(c, "ja")) == [6, 0, 0, 0, 0]
    assert results(spark, values, lambda c: X.script_count(c, "zh")) == [2, 0, 0, 0, 0]
    assert results(spark, values, lambda c: X.script_count(c, "ko")) == [0, 3, 0, 0, 0]
    assert results(spark, values, lambda c: X.script_count(c, "ru")) == [0, 0, 6, 0, 0]
    assert results(spark, values, X.latin_count) == [0, 0, 0, 6, 0]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("r")).first()["r"]
    assert get(X.font_base(F.lit("ABC+CMR10"))) == "CMR10" and get(X.font_base(F.lit("Times"))) == "Times"
    assert tuple(get(X.service_and_model(F.lit("ollama:gemma2:9b")))) == ("ollama", "gemma2:9b")
    assert tuple(get(X.service_and_model(F.lit("google")))) == ("google", None)
    assert get(X.stem(F.lit("/a/b.c/paper.v2.pdf"))) == "paper.v2" and get(X.suffix(F.lit("/a/X.PDF"))) == ".pdf"
    assert get(X.fill_template("$lang_in to ${lang_out}: ${text} $$5 $other", lang_in=F.lit("en"), lang_out=F.lit("zh"), text=F.lit("a$b"))) == "en to zh: a$b $5 $other"
    pairs = F.array(F.struct(F.lit("ab").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("b").alias("old"), F.lit("c").alias("new")))
    assert get(X.replace_chain(F.lit("abab"), pairs)) == "cc"
    assert get(X.hex_glyphs(F.lit("Aé"), True)) == "004100e9" and get(X.hex_glyphs(F.lit("A"), False)) == "41"
    assert get(X.colour_operator(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)))) == "1.000000 0.000000 0.500000 rg "
    assert get(X.colour_operator(F.array(F.lit(0.25)))) == "0.250000 g " and get(X.colour_operator(F.lit(None).cast("array<double>"))) == "0 g "
    assert get(X.facts({"field": F.lit("logic"), "topic": F.lit("")})) == "This document — Field: logic" and get(X.facts({"field": F.lit("")})) == ""


def chunks(items, limit):
    out, used, at = [], 0, 0
    for i, t in enumerate(items):
        if i and used + len(t) > limit:
            at, used = at + 1, 0
        used += len(t)
        out.append(at)
    return out


def test_greedy_chunks(spark):
    rng = random.Random(2)
    values = [["x" * 700] * 5, ["y" * 5000], ["a" * 5000, "b", "c" * 1999, "d"], []] + [["z" * rng.randint(1, 900) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    got = results(spark, values, lambda c: P.greedy_chunks(c, 2000), "array<string>")
    assert got == [chunks(v, 2000) for v in values]
    totals = results(spark, values, lambda c: P.chunk_totals(c, 2000), "array<string>")
    assert [t["chunks"] for t in totals] == [len(set(c)) for c in got]


def test_keys(spark):
    paras = ["2.1 Overview", "b" * 150, "a" * 300, "Conclusion", "b" * 150]
    df = spark.createDataFrame([(1, paras)], "doc_id int, paras array<string>")
    got = {r["text"]: r["cache_key"] for r in P.keys(df).collect()}
    assert got["a" * 300] == "a" * 300
    assert got["2.1 Overview"] == "\n".join(paras[:3]) and len(got["2.1 Overview"]) >= 200
    assert got["Conclusion"] == "Conclusion\n" + "b" * 150 and got["b" * 150] == "b" * 150 + "\n" + "a" * 300


def test_cacheable(spark):
    df = spark.createDataFrame([("short", None), ("short", "wide"), ("l" * 200, None)], "t string, k string")
    assert [r["r"] for r in df.select(P.cacheable(F.col("t"), F.col("k")).alias("r")).collect()] == [None, "wide", "l" * 200]


def test_opening_and_sizing(spark):
    values = [[], ["n"], ["w" * 40], ["word " * 300, "q" * 700, "more " * 300]]
    got = results(spark, values, P.opening, "array<string>")
    assert [len(g["parts"]) for g in got] == [0, 0, 1, 2] and got[3]["parts"][1] == "q" * 600
    assert results(spark, [["x" * 100], ["y" * 500_000]], lambda c: P.sizing(c)["excerpt"], "array<string>") == [3000, 20000]
    assert results(spark, [["x" * 100], ["y" * 500_000], ["z" * 160_000]], lambda c: P.sizing(c)["terms"], "array<string>") == [25, 80, 40]


def sample(paras, budget):
    usable = [p[:600] for p in paras if len(p.strip()) >= 3 and any(c.isalpha() for c in p)]
    total = sum(map(len, usable))
    if total <= budget:
        return list(range(len(usable)))
    stride, taken, used = max(2, round(total / budget)), set(), 0
    for turn in range(stride):
        for i in range(turn, len(usable), stride):
            if used + len(usable[i]) <= budget:
                taken.add(i)
                used += len(usable[i])
        if used >= budget * 0.98:
            break
    return sorted(taken)


def test_stride_sample(spark):
    rng = random.Random(3)
    values = [[]] + [["w" * rng.randint(1, 800) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    assert results(spark, values, lambda c: P.stride_sample(c, 3000), "array<string>") == [sample(v, 3000) for v in values]


def test_split_lines(spark):
    rng = random.Random(4)
    values = ["", "one", "a" * 30 + "\nb"] + ["\n".join("x" * rng.randint(0, 40) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    for v, parts in zip(values, results(spark, values, lambda c: P.split_lines(c, 50)), strict=True):
        assert "".join(parts) == v and all(len(p) <= 50 or p.count("\n") <= 1 and not p[:-1].count("\n") for p in parts)


def test_document_key(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "onetwo")], "doc_id string, page int, text string")
    want = hashlib.sha256(b"onetwo").hexdigest()[:16]
    assert {r["doc_id"]: r["doc_key"] for r in P.document_key(df).collect()} == {"a": want, "b": want}
