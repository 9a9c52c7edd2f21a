"""Counts at every prefix against the tokenizer library."""

import os
import random

import pytest
from pyspark.sql import functions as F

from papyra.llm import tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"
LETTERS = "abcdeIiSsTtLl'’.,!?<>|0123½²éÉßÅİΣσς中文한글한Ǻ̊ொ \t\n ​😀ǅﬁ"
PARTS = ["'ll", "'re", "'ve", "'s", "<|endoftext|>", "<|startoftext|>", "hello", "World", "don't", "strasse"]


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return tokens.load_vocabulary(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter(vocabulary):
    return tokens.PrefixCounter(vocabulary)


@pytest.fixture(scope="module")
def library(vocabulary):
    own = pytest.importorskip("tokenizers").Tokenizer.from_str(vocabulary)
    return lambda texts: [len(e) for e in own.encode_batch(texts, add_special_tokens=False)]


def drawn(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) if rng.random() < 0.6 else rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_every_prefix(counter, library):
    for text in drawn(1, 400):
        want = library([text[:n] for n in range(len(text) + 1)])
        assert counter.prefixes(text).tolist() == want, text
        assert counter.total(text) == want[-1]
        for n in range(len(text) + 1):
            assert counter.count_at(text, n) == want[n]
        for budget in range(max(want) + 1):
            assert counter.longest_prefix(text, budget) == max(n for n, c in enumerate(want) if c <= budget)


def test_texts_without_blanks(counter, library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    want = library([text[:n] for n in range(61)])
    assert counter.longest_prefix(text, 5) == max(n for n in range(61) if want[n] <= 5) >= 5
    long = text * 400
    assert counter.total(long) == library([long])[0]


def test_operator(spark, vocabulary, library):
    texts = [*drawn(3, 40), "word " * 3000, "x" * 5000, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, vocabulary, 50, prefixes=True).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        assert (r["n_tokens"], r["n_bytes"]) == (library([t])[0], len(t.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 50) and len(r["prefix_tokens"]) == len(t) + 1
        fits = [n for n, c in enumerate(r["prefix_tokens"]) if c <= 50]
        assert r["fit_chars"] == (fits[-1] if r["over_limit"] else len(t))


def test_query_equals_library(spark, library):
    from papyra.llm import queries

    data = os.environ.get("PAPYRA_TESTDATA", "/root/testdata") + "/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = dict(zip([d["doc_id"] for d in docs], library([d["text"] for d in docs]), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op8_tokens(spark, data).collect()} == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.PrefixCounter('{"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}')
