"""The collapsed table of the toxicity machine against an explicit subsequence kernel."""

import random

import numpy as np

from papyra.llm import toxicity as X


def explicit(codes):
    """Weights of the three-letter subsequences of a stretch, letter by letter."""
    out = {}
    for i in range(min(X.STARTS, len(codes))):
        for j in range(i + 1, len(codes)):
            for k in range(j + 1, min(len(codes), i + X.SPAN + 1)):
                key = (codes[i], codes[j], codes[k])
                out[key] = out.get(key, 0) + X.DECAY ** (k - i)
    return out


def kernel(a, b):
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    return sum(w * b.get(s, 0) for s, w in a.items()) / (size(a) * size(b))


def stretches(rng, n):
    words = ["".join(rng.choice("abcdei") for _ in range(rng.randrange(3, 12))) for _ in range(n)]
    x = X.read(words)
    return x, [x.code[a : a + r].tolist() for a, r in zip(x.first, x.room[x.first], strict=True)]


def test_table_is_the_kernel_machine():
    rng = random.Random(3)
    x, codes = stretches(rng, 60)
    y = np.array([1.0 if 5 in c else -1.0 for c in codes])
    marks, mark_codes = stretches(rng, 25)
    table, offset = X._fit(X.subsequences(x, x.first), y, X.subsequences(marks, marks.first))
    machine = X.Machine(table, offset, 1.0, 0.0)
    # the machine is a sum of kernels with the landmarks: find their weights in the explicit feature space
    phi, names = [explicit(c) for c in mark_codes], {}
    for v in phi:
        for s in v:
            names.setdefault(s, len(names))
    dense = np.zeros((len(phi), len(names)))
    for i, v in enumerate(phi):
        for s, w in v.items():
            dense[i, names[s]] = w
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    own = np.array([table[(a * X.SYMBOLS + b) * X.SYMBOLS + c] for a, b, c in names])
    alpha, *_ = np.linalg.lstsq(dense.T, own, rcond=None)
    assert np.allclose(dense.T @ alpha, own, atol=1e-3) and np.count_nonzero(table) <= len(names)
    z, other = stretches(rng, 80)
    got = machine.decisions(z)[z.first]
    for d, c in zip(got, other, strict=True):
        want = sum(w * kernel(explicit(c), v) for w, v in zip(alpha, phi, strict=True)) + offset
        assert abs(d - want) < 1e-2 or max(d, want) <= X.EXACT_FROM


def test_gaps_lower_a_match_and_do_not_end_it():
    plain, gapped, other = (explicit(X.read([w]).code.tolist()) for w in ("idiot", "idxiot", "table"))
    assert 1 > kernel(plain, gapped) > 0.4 > kernel(plain, other)


def test_repeated_ids_give_one_row(spark):
    docs = spark.createDataFrame([(1, f"some text {i}") for i in range(50)] + [(2, "an awful idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    keep, X.train = X.train, lambda texts, toxic, share=None: seen.append((texts, toxic)) or keep(texts, toxic, share)
    try:
        from pyspark.sql import functions as F

        X.fit(docs, labels, F.lit(True))
    finally:
        X.train = keep
    assert [len(t) for t, _ in seen] == [2]
