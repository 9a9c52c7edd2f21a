"""Near copies in the pipeline: exact confirmation, rows without an id of their own, heavy buckets."""

import itertools
import random

import numpy as np
import pytest

from papyra.llm import simhash


def edited(rng, words, k):
    """``words`` with ``k`` of them, all over five apart, replaced by new ones."""
    out, step = list(words), len(words) // k
    for i in range(k):
        out[i * step + rng.randrange(5, step - 5)] = f"new{rng.random()}"
    return out


def text(rng, n=300):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def groups(spark, rows, **how):
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: r["component_id"] for r in got}


def roots(ids, edges):
    root = {i: i for i in ids}
    for a, b in sorted(edges):
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_links_are_those_of_shingles(spark):
    rng, rows = random.Random(1), []
    for i in range(100):
        one = text(rng)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(edited(rng, one, 6 if i < 50 else 8)))]
    sets = [simhash.shingles(t, 5) for _, t in rows]
    like = [simhash.jaccard(sets[2 * i], sets[2 * i + 1]) for i in range(100)]
    assert min(like[:50]) > 0.81 and max(like[50:]) < 0.78
    got = groups(spark, rows)
    linked = [got[2 * i] == got[2 * i + 1] for i in range(100)]
    assert sum(linked[:50]) >= 45 and not any(linked[50:])


@pytest.mark.parametrize("heavy", [4096, 3])
def test_groups_by_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "RECALL", 0.999999)
    monkeypatch.setattr(simhash, "SPREAD", 6)
    monkeypatch.setattr(simhash, "MEETINGS", 99)
    rng, rows = random.Random(2), []
    for family in range(6):
        one = text(rng, 200)
        for _ in range(12):
            rows.append((len(rows), " ".join(edited(rng, one, rng.choice((1, 2, 3, 4, 5))))))
    sets = [simhash.shingles(t, 5) for _, t in rows]
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    want = roots(range(len(rows)), edges)
    assert len(set(want.values())) > 6
    assert groups(spark, rows) == want


def test_recall_of_near_copies(spark):
    """Of the links at 0.8 or more that all pairs have, and of those at 0.9, at least nine in ten end in one group; no group joins what links don't."""
    rng, rows = random.Random(11), []
    for _ in range(40):
        one = text(rng, 300)
        for _ in range(8):
            rows.append((len(rows), " ".join(edited(rng, one, rng.choice((1, 2, 3, 4, 5))))))
    sets = [simhash.shingles(t, 5) for _, t in rows]
    like = {(a, b): simhash.jaccard(sets[a], sets[b]) for f in range(40) for a, b in itertools.combinations(range(8 * f, 8 * f + 8), 2)}
    edges = [p for p, j in like.items() if j >= 0.8]
    want, got = roots(range(len(rows)), edges), groups(spark, rows)
    for least in (0.8, 0.9):
        some = [p for p in edges if like[p] >= least]
        assert sum(got[a] == got[b] for a, b in some) >= 0.95 * len(some) > 50
    assert all(want[a] == want[i] for i, a in got.items())


def close_families(rng, families, members, n=200):
    """Rows of families whose pairs lie on both sides of 0.8, and the groups that all pairs by brute force give."""
    rows = []
    for _ in range(families):
        one = text(rng, n)
        for _ in range(members):
            rows.append((len(rows), " ".join(edited(rng, one, rng.choice((1, 2, 3, 4, 5))))))
    rows += [(len(rows) + i, t) for i, t in enumerate(("x x x x x", "X x x x x x  x x", "y", "y z", "", " ", "a b c d e f g h i j", "j a b c d e f g h i j"))]
    sets = [simhash.shingles(t, 5) for _, t in rows]
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    return rows, roots(range(len(rows)), edges)


@pytest.mark.parametrize("how", [{}, {"SMALL": 2}, {"SMALL": 2, "HEAVY": 3, "EVERY": 1, "OFTEN": 2}])
def test_no_link_hangs_on_sketches(spark, monkeypatch, how):
    """Where sketches name no candidate at all, the groups are those of brute force all the same."""
    monkeypatch.setattr(simhash, "SPREAD", -99)
    for name, value in how.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    rows, want = close_families(random.Random(5), 5, 10)
    assert 10 < len(set(want.values())) < len(rows) - 10
    assert groups(spark, rows) == want


def test_every_link_at_the_threshold(spark):
    """400 pairs of 0.8 to 0.82: each is one group."""
    rng, rows = random.Random(6), []
    while len(rows) < 800:
        one = text(rng, 95)
        two = edited(rng, one, 2)
        if 0.8 <= simhash.jaccard(*(simhash.shingles(" ".join(x), 5) for x in (one, two))) <= 0.82:
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    got = groups(spark, rows)
    assert [i for i in range(0, 800, 2) if not got[i] == got[i + 1] == i] == []


@pytest.mark.parametrize("how", [{"LOW": 1, "DEALT": 50}, {"SLOTS": 1, "AT_ONCE": 2, "SPREAD": 3.5}, {"SLOTS": 1, "EVERY": 1, "OFTEN": 2}])
def test_rows_are_made_of_shared_shingles_alone(spark, monkeypatch, how):
    """What is dealt by shingle are those that two groups have and frequent ones; sketches are dealt for a few tables at a time."""
    monkeypatch.setattr(simhash, "SPREAD", -99)
    for name, value in how.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng, plain, dealt, tables = random.Random(8), simhash._grid, [], []

    def grid(rows, heavy, node):
        if "rest" in rows.columns:
            dealt.append(rows.count())
        else:
            tables.append(rows.select("table").distinct().count())
        return plain(rows, heavy, node)

    monkeypatch.setattr(simhash, "_grid", grid)
    rows, want = close_families(rng, 2, 6)
    rows += [(len(rows) + i, " ".join(text(rng))) for i in range(100)]
    want |= {i: i for i, _ in rows[len(want) :]}
    assert groups(spark, rows) == want
    assert max(tables) <= 5 and sum(tables) == 9
    if "LOW" not in how:  # else one byte mostly doesn't tell shingles apart
        assert dealt[0] < sum(60 for _ in range(100)) / 4


def test_marks_hold_for_all_similar_sets():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        both = int(rng.choice((30, 300, 900)) * rng.random()) + 1
        a, b = rng.integers(0, both // 5 + 2, 2)
        own = rng.integers(0, 1 << 63, both + a + b).astype(np.uint64)
        x, y = own[: both + a], np.concatenate((own[:both], own[both + a :]))
        late = rng.permutation(own)[: rng.integers(0, len(own))]
        order = simhash.Order(late, rng.integers(1, 4, len(late)))
        if both / len(own) >= 0.8:
            (p, first), (q, second) = ([np.frombuffer(v, np.uint64) for v in simhash.marks(z, 0.8, order)] for z in (x, y))
            assert (p[0], q[0]) == (len(x), len(y))
            least, first, second = simhash.least_overlap(len(x) + len(y), 0.8), first.tolist(), second.tolist()
            shared = next(v for v in first if v in second)
            assert min(len(x) - first.index(shared), len(y) - second.index(shared)) >= least
            for lanes in (4, min(len(p), len(q)) - 1):
                assert np.bitwise_count(simhash.folded(p[1:], lanes) ^ simhash.folded(q[1:], lanes)).sum(dtype=int) <= len(x) + len(y) - 2 * least


def test_forest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        i, j = rng.integers(0, 20, (2, 25))
        far = rng.integers(0, 5, 25)
        label = np.arange(20)
        own = simhash._forest(label, i, j, far)
        pairs = list(zip(i.tolist(), j.tolist(), strict=True))
        want, got = roots(range(20), pairs), roots(range(20), [pairs[k] for k in own])
        assert want == got and len(own) == 20 - len(set(want.values()))
        assert all((label[a] == label[b]) == (want[a] == want[b]) for a in range(20) for b in range(20))


def test_drop_by_row_not_by_id(spark):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(text(rng)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, e), (2, e), (3, d), (None, None), (None, "")]
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept), key=repr) == sorted([(1, a), (None, b), (None, c), (2, d), (2, e), (None, "")], key=repr)


def test_decontaminate_rows_without_id(spark, tmp_path):
    C = pytest.importorskip("corpus_pipeline")
    leak = "a benchmark passage that no clean document holds, long enough to be called a leak by any measure of length"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"before {leak} after"), (None, "a clean text"), (None, None), (5, leak), (5, "another clean text")], "doc_id long, text string")
    kept = C.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["text"]) for r in kept)) == ["None", "a clean text", "another clean text"]
