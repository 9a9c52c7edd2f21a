"""Rows of several megabytes take time in proportion to their length."""

import random
import time

import numpy as np
import pytest

from papyra.llm import html_text, pii


@pytest.mark.parametrize("junk", ["<script ", "<a ", "<!-- ", "<div>x ", "<p class='a b c'>x ", "</nav></p>", "<div><h2>y</p>", "<td><dt>z</li>", "&lt;", "<b>"])
def test_html(junk):
    began = time.time()
    page = html_text.leaves(junk * (2_000_000 // len(junk)))
    html_text.vectors(page)
    assert time.time() - began < 10


def test_what_is_left_open():
    said = lambda page: [(f.text, f.path) for f in html_text.leaves(page)]
    assert said("<p>a<script>var x = 1; var y") == [("a", ("p",))]
    assert said("<p>a<!-- <b> and so on") == [("a", ("p",))]
    assert said("<p>a<!-- gone -->b<") == [("ab<", ("p",))]
    assert said("<p>a <style>p{}</style >b") == [("a b", ("p",))]
    assert said("<div class='x y z u v w q r s t'>a") == [("a", ("div", *(f".{c}" for c in "xyzuvwqrst")))]


def test_long_paragraphs_have_words():
    x = html_text.vectors(html_text.leaves("<p>" + "one two three " * 100))
    assert abs(x[0, html_text.PATHS : html_text.PATHS + html_text.WORDS].sum() - 1) < 1e-5


def test_pii_of_many_candidates():
    rng = random.Random(1)
    some = []
    for i in range(200_000):
        s = rng.randrange(4_000_000)
        some.append({"kind": rng.choice(pii.KINDS), "start": s, "end": s + rng.randrange(1, 30), "base": i % 9 == 0, "votes": "0+0000", "features": [rng.randrange(pii.HASHED)]})
    weights = np.random.default_rng(2).normal(size=1 + len(pii.KINDS) + 3 * len(pii.LABELERS) + pii.HASHED)
    began = time.time()
    pii.Judge(weights).spans(some)
    assert time.time() - began < 20

    # the same spans as those found by comparing each with all others
    some = some[:400]
    for c in some:
        c["start"] %= 3000
        c["end"] = c["start"] + 9
    base, every = pii.Judge(weights).spans(some)
    extra = [c for c in some if not c["base"]]
    belief = pii._design([c["kind"] for c in extra], [c["votes"] for c in extra], [c["features"] for c in extra]) @ weights
    added = []
    for c, s in sorted(zip(extra, belief, strict=True), key=lambda x: (-x[1], x[0]["start"], x[0]["end"])):
        if s > 0 and all(c["end"] <= o[0] or c["start"] >= o[2] for o in base + added):
            added.append((c["start"], pii.KINDS.index(c["kind"]), c["end"]))
    assert every == sorted(base + added) and len(added) > 20
