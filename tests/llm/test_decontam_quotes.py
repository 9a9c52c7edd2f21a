"""Quotes of any start, and items shorter than a window."""

import random

from papyra.llm import decontam


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_quotes_of_every_start(spark):
    rng = random.Random(6)
    item = words(rng, 90)
    starts = range(3, 200)
    docs = [(s, f"{words(rng, 20)} {item[s : s + 100].strip()} {words(rng, 20)}") for s in starts]
    docs += [(1000 + s, f"{words(rng, 9)} {item[s : s + 50]}{chr(97 + s % 26)}{item[s + 51 : s + 102].strip()} {words(rng, 9)}") for s in starts]
    docs += [(5000, words(rng, 60)), (5001, item[10:90])]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {*starts, *(1000 + s for s in starts)}
    texts = dict(docs)
    for r in got:
        assert r["doc_id"] >= 1000 or abs(r["end"] - r["start"] - 96) <= 24 and item[r["doc_id"] + 10 : r["doc_id"] + 80] in texts[r["doc_id"]][r["start"] : r["end"]]


def test_short_items(spark):
    items = [(1, "What is the capital of France?"), (2, "yes"), (3, "who?"), (4, "")]
    docs = [(1, "Q: what is the capital of france - Paris"), (2, "Yes!"), (3, "yes it is"), (4, "somewhat is the capital of France"), (5, "what is the capital of Francesca"), (6, ""), (7, "What is the capital of France")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (7, 1)}
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["n_windows"], first["windows"], first["edits"], first["start"], first["end"]) == (1, 1, 0, 3, 32)
