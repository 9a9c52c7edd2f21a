"""Leaks against edit distances of every window of every item with every document."""

import random

import numpy as np

from papyra.llm import decontam


def least_edits(item: bytes, text: bytes, width: int) -> int:
    """Least edits between any window of the item and any part of the text, all windows at a time."""
    n = max(1, len(item) - width + 1)
    windows = np.array([list(item[s : s + width]) for s in range(n)])
    before = np.zeros((n, len(text) + 1), int)
    for i in range(windows.shape[1]):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        for j, c in enumerate(text):
            now[:, j + 1] = np.minimum(np.minimum(before[:, j] + (windows[:, i] != c), before[:, j + 1] + 1), now[:, j] + 1)
        before = now
    return int(before.min())


def test_every_window_of_every_item(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (9, 12, 24, 40)]
    docs = []
    for k in range(28):
        item = rng.choice(items)
        start = rng.randrange(max(1, len(item) - 90))
        part = list(item[start : start + rng.randrange(60, 130)])
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        docs.append((k, f"{word()} {word()} {''.join(part)} {word()}"))
    assert all(len(decontam.compared(t)) >= decontam.MIN_CHARS for t in items)
    want = set()
    for k, text in docs:
        for i, item in enumerate(items):
            a, b = decontam.compared(item), decontam.compared(text)
            width = min(len(a), decontam.WINDOW)
            edits = min(int(width * decontam.RATE), (width - decontam.Q) // decontam.Q)
            if b and least_edits(a, b, width) <= edits:
                want.add((k, i))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert 5 < len(want) < len(docs)
