"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from papyra.llm import decontam, html_text, langid, mixing, pii, repeats, simhash, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, batch int, size string, score string, rank int, t string, c0 int, node long"
LONG = "lorem ipsum dolor " * 20_000


def rows():
    base = [(1, "the quick brown fox jumps"), (1, "the quick brown fox jumps"), (2, None), (None, "orphan text of some words"), (3, ""), (4, "   \n\t "), (5, LONG), (6, "x"), (None, None), (7, "mail a.b@c.org or +1 (555) 123-4567 now")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "b", 1, "s", "z", 2, "t", 3, 4) for k, (i, t) in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return tokens.load_vocabulary(public.path("word_bpe_49k.json"))


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=str)


EVERY = sorted((r[0] for r in rows()), key=str)


def test_mixing(docs, none):
    got = mixing.mix(docs, weights=[1, 2, 3])
    assert ids(got) == EVERY
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert mixing.mix(none, weights=[1, 2, 3]).count() == 0


def test_html(spark):
    net = html_text.train(n_pages=60, rounds=1)
    pages = spark.createDataFrame([(1, "u", None, 0), (1, "u", "", 0), (None, None, "plain", 0), (2, "u", "<p>" + "word " * 50_000, 0), (3, "u", "<<<>>><p", 0)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages, net).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"] == "" for r in got) >= 2
    assert html_text.extract(pages.limit(0), net).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 1), (7, None, 0), (None, 1, 1), (99, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, machine).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == EVERY
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    blank = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, blank).where("score <> 0").count() == 0
    assert toxicity.score(none, machine).count() == 0


def test_decontamination(spark, docs, none):
    item = "one passage that is long enough to be told from a coincidence, with several words of its own"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "short")], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(8, f"before {item.upper()} after"), (None, item)], "doc_id long, text string"))
    got = decontam.find_leaks(more, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(8, 1), (None, 1)}
    assert decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(more, bench.limit(0)).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (9, [1e19, 1e19])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=3).collect()}
    assert got[0, 1][0] == 9 and got[0, 2] == (1, 1024 * 512) and got[0, 3] == (2, 1024 * 512)
    assert all(q != v for (q, _), (v, _) in got.items())
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeats(docs, none):
    got = repeats.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == EVERY
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_spans"] == 1 and by[5]["n_removed"] == len(LONG) - 18
    assert by[2]["n_bytes"] == 0 and by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert repeats.remove_repeats(none).count() == 0


def test_language(docs, none):
    net = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, net)
    assert ids(got) == EVERY
    assert {r["lang_pred"] for r in got.where("doc_id in (2, 3, 4)").collect()} == {"und"}
    assert langid.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(none, net).count() == 0


def test_tokens(docs, none, vocabulary):
    got = tokens.count_tokens(docs, vocabulary, 2048)
    assert ids(got) == EVERY
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 0 and by[5]["over_limit"]
    assert tokens.count_tokens(none, vocabulary, 2048).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs)
    assert ids(got) == EVERY
    zero = [r for r in got.collect() if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {2} and len(zero) == 4
    assert simhash.near_duplicates(none).count() == 0


def test_similar(docs, none):
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1
    assert kept.where("text is null or trim(text) = ''").count() >= 1
    assert simhash.drop_similar(none).count() == 0


def test_pii(docs, none):
    got = pii.find_pii(docs)
    assert ids(got) == EVERY
    seven = got.where("doc_id = 7").first()
    assert (seven["n_email"], seven["n_phone"]) == (1, 1) and seven["spans"].startswith("email:5:")
    assert pii.find_pii(none).count() == 0
    masked = pii.redact_pii(docs)
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 7").first()["text"] == "mail [email] or [phone] now"
    assert masked.where("doc_id = 2").first()["text"] is None
