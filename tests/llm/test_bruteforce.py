"""The operators against plain versions of what they compute, on small tables."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.llm import decontam, html_text, langid, pii, repeats, simhash, tokens, topk, toxicity
from papyra.llm.html_pages import Pages

DATA = os.environ.get("PAPYRA_TESTDATA", "/root/testdata")
needs_data = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables here")


def texts(seed, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        x = rng.random()
        if x < 0.1:
            t = rng.choice(said)
        elif x < 0.15:
            t = "ab" * rng.randint(10, 400)
        elif x < 0.2:
            t = rng.choice(["", None, "x" * rng.randint(90, 300)])
        else:
            t = " ".join(rng.choice(said)[rng.randint(0, 40) :] if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
        out.append((i, t))
    return out


@pytest.mark.parametrize(("heavy", "batch_bytes"), [(30_000, 3_000_000), (30_000, 4_000), (3, 4_000)])
def test_repeats(spark, heavy, batch_bytes):
    rows, seen, want = texts(1), set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), heavy=heavy, batch_bytes=batch_bytes)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[2] for w in want) > 10_000


def test_repeats_of_any_width(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abc") for _ in range(700)) for _ in range(3)]
    rows = [(1, long[0] + long[1]), (2, long[1][40:] + long[2]), (3, "b" + long[2][:400]), (4, long[0][:299]), (5, long[0][:300])]
    for width in (32, 300):
        seen, want = set(), {}
        for i, t in rows:
            gone = bytearray(len(t))
            for s in range(len(t) - width + 1):
                if t[s : s + width] in seen:
                    gone[s : s + width] = b"\1" * width
                seen.add(t[s : s + width])
            want[i] = sum(gone)
        for heavy in (30_000, 1):
            got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=width, heavy=heavy, batch_bytes=900)
            assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_repeats_without_ids(spark):
    """Rows without an id of their own have a fixed order too, and only first occurrences stay."""
    one, two = "a passage of some length that is " * 4 + "shared", "".join(map(str, range(80)))
    rows = [(None, one + " x"), (None, two + one), (7, "y" + one), (7, two), (None, None), (None, one + " x"), (2**63 - 1, "z" + one)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batch_bytes=300, keep_text=True).collect()
    again = repeats.remove_repeats(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(2), batch_bytes=300, keep_text=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    whole = b"|".join(r["kept"] for r in got)
    assert whole.count(one.encode()) == 1 and whole.count(two.encode()) == 1
    assert any(r["doc_id"] == 7 and r["n_removed"] == 0 and r["n_bytes"] == len(one) + 1 for r in got) or any(r["doc_id"] == 7 and one.encode() in r["kept"] for r in got)


@pytest.mark.parametrize("heavy", [30_000, 3])
def test_maximal_repeats(spark, heavy):
    """Groups hold all occurrences of their bytes, and every two equal windows lie in a group together."""
    rows = [(i, t) for i, t in texts(4, 40)]
    raw = {i: (t or "").encode() for i, t in rows}
    found = repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=heavy, batch_bytes=4_000).collect()
    groups, covered = {}, {}
    for r in found:
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    whole = {i: b for i, b in raw.items() if len(b) >= 100}
    for (_, n), places in groups.items():
        i, s = next(iter(places))
        said = raw[i][s : s + n]
        assert len(said) == n >= 100 and len(places) > 1
        assert places == {(j, k) for j, b in whole.items() for k in range(len(b) - n + 1) if b[k : k + n] == said}
        for j, k in places:
            for d in range(n - 99):
                covered.setdefault(said[d : d + 100], set()).add((j, k + d))
    windows = {}
    for i, b in whole.items():
        for s in range(len(b) - 99):
            windows.setdefault(b[s : s + 100], set()).add((i, s))
    assert {w: p for w, p in windows.items() if len(p) > 1} == covered
    assert len(groups) > 20


def test_interval_tree():
    """Groups of the tree are the maximal repeats of all suffixes, by brute force."""
    rng = random.Random(8)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(40))
        order = sorted(range(40), key=lambda i: text[i:])
        common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        lcp = np.array([common(text[i:], text[j:]) for i, j in zip(order, order[1:])])
        got = set()
        for depth, lo, hi in repeats.interval_tree(lcp):
            places = order[lo : hi + 1]
            if len({text[p - 1] if p else -1 for p in places}) > 1:
                got.add((text[places[0] : places[0] + depth], frozenset(places)))
        want = set()
        for n in range(1, 40):
            for s in {text[i : i + n] for i in range(41 - n)}:
                at = frozenset(i for i in range(41 - n) if text[i : i + n] == s)
                if len(at) > 1 and len({text[i - 1] if i else -1 for i in at}) > 1 and len({text[i + n] if i + n < 40 else -1 for i in at}) > 1:
                    want.add((s, at))
        assert got == want


def test_simhash(spark):
    rng = random.Random(3)
    rows = []
    for i, (_, t) in enumerate(texts(2, 60)):
        rows.append((3 * i, t))
        w = (t or "").split()
        for k in (1, 2):
            if len(w) > 5:
                w[rng.randrange(len(w))] = "new"
                rows.append((3 * i + k, " ".join(w)))

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum((sum(v >> b & 1 for v in h) * 2 > len(h)) << b for b in range(64))

    prints = {i: plain(t) for i, t in rows}
    part = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and part[j] > part[i]:
                    part[j], changed = part[i], True
    for blocks in (1, 2):
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), blocks=blocks).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", part[i]) for i in prints}
    assert len(set(part.values())) < len(part)


def test_simhash_heavy_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 2)
    rows = [(i, i ^ (1 << (i % 5))) for i in range(40)]
    nodes = spark.createDataFrame([(f,) for _, f in rows], "fp long").distinct()
    edges = {(r["a"], r["b"]) for r in simhash.links(nodes, 2, 1).collect()}
    from papyra.llm.graph import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, 2, 1)).collect()}
    assert edges and len({roots.get(f, f) for _, f in rows}) == 1


def test_anchors_cover_all_pairs():
    golay = simhash.GolayBlock(2)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 150, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    for blocks in (1, 2):
        (hx, rx, ax), (hy, ry, ay) = simhash.cover(x, blocks, 2, golay), simhash.cover(y, blocks, 2, golay)
        for i in range(len(x)):
            assert hx[i] in {hy[i], *ay[ry == i]} or hy[i] in {hx[i], *ax[rx == i]}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(400, 6)), 1)
    v[100:160] = v[100]
    got = topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).collect()
    q = np.floor(v.astype(np.float32).astype(float) * 1024).astype(int)
    for i in range(0, 400, 20):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(400) if j != i)[:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [(k + 1, j, -n) for k, (n, j) in enumerate(best)]


def test_top_k_scores_just_above_the_bin(spark):
    scores = [-99_999, *range(57_182, 57_191), *range(56_400, 56_500)]
    vectors = spark.createDataFrame([(0, [1.0]), *((i, [float(s)]) for i, s in enumerate(scores, 1))], "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") == 0, k=10, scale=1.0).orderBy("rank").collect()
    assert [r["score"] for r in got] == [*range(57_190, 57_181, -1), 56_499]


@pytest.mark.parametrize("queries", [16_384, 7])
def test_top_k_of_wide_scores(spark, queries):
    """Scores beyond 64 bits are ranked by their true value; jobs of few queries give the same."""
    rng = random.Random(9)
    rows = [(0, [1e17]), (1, [2e17]), (2, [1.0]), (3, [-3e17]), (4, [2.0000001e17]), (5, [1e300]), (6, [1e17]), (7, [1e308])]
    rows += [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(25) for _ in range(3)]) for i in range(8, 60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.lit(True), k=4, queries=queries).collect()
    exact = {i: [int(c * 1024) if abs(c * 1024) >= 2**53 else math.floor(c * 1024) for c in v] for i, v in rows if all(abs(c * 1024) < float("inf") for c in v)}
    want = set()
    for i, v in exact.items():
        score = {j: sum(a * b for a, b in zip(v, w, strict=True)) for j, w in exact.items() if j != i and len(v) == len(w)}
        for rank, (n, j) in enumerate(sorted((-n, j) for j, n in score.items())[:4], 1):
            want.add((i, rank, j, max(-(2**63), min(2**63 - 1, -n))))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.PrefixCounter(tokens.load_vocabulary(path))
    rows = [(i, t) for i, t in texts(4, 40) if t] + [(90, "It's <|endoftext|>done\x1c\x85 now    é İ !!! 12345"), (91, "a" * 5000), (92, "don't<|startoftext|>x<|endoftext|>")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokens.load_vocabulary(path), 50).collect()}
    for i, t in rows:
        assert got[i] == len(library.encode(t, add_special_tokens=False))
        for n in (0, 1, len(t) // 3, len(t) // 2, len(t)):
            assert own.count_at(t, n) == len(library.encode(t[:n], add_special_tokens=False))
        fit = own.longest_prefix(t, 50)
        assert len(library.encode(t[:fit], add_special_tokens=False)) <= 50


def _distance(w, t):
    before = [0] * (len(t) + 1)
    for i, c in enumerate(w, 1):
        now = [i]
        for j, x in enumerate(t, 1):
            now.append(min(before[j - 1] + (c != x), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_decontamination():
    rng = random.Random(5)
    items = [(i, decontam.compared(t)) for i, t in texts(6, 30) if t and len(decontam.compared(t)) >= decontam.MIN_CHARS][:6]
    index = decontam.Index.build(items)
    for _ in range(25):
        y = bytearray(rng.choice(items)[1][:300])
        for _ in range(rng.randint(0, len(y) // 9)):
            p, r = rng.randrange(len(y)), rng.random()
            if r < 0.4:
                y[p] = rng.randrange(97, 123)
            elif r < 0.7:
                y.insert(p, rng.randrange(97, 123))
            else:
                del y[p]
        doc = b"before it " + bytes(y) + b" after it"
        got = {w for _, w, *_ in decontam._regions(index, [doc, b"another"])}
        want = {w for w in range(len(index.length)) if _distance(bytes(index.window[w][: index.length[w]]), doc) <= index.edits[w]}
        assert got == want
    for t in ("a  B,c.é  d!", "...x y", "é\x1cq\n\nz "):
        assert len(decontam.compared(t)) == len(decontam.positions(t))


def test_pii_base():
    kinds = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b.c", "@", ".", "1", "22", "255", "256", "-", " ", "+", "(", ")", "4111111111111111", "é", "x@y.org"]) for _ in range(rng.randint(1, 14)))
        want = []
        for k, pattern in enumerate(kinds):
            for m in pattern.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                    want.append((m.start(), k, m.end()))
        assert sorted((s, pii.KINDS.index(k), e) for k, s, e, ok in pii.strict_matches(t) if ok) == sorted(want)


def test_pii_reliability():
    patterns = [("email", "++++0+", 80), ("email", "0+-0--", 60), ("card", "-0-0--", 40), ("card", "++++0+", 20)]
    belief, table = pii.estimate_reliability(patterns)
    assert belief["email", "++++0+"] > 0.9 and belief["card", "-0-0--"] < 0.1
    assert np.allclose(table.sum(axis=2), 1)


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.ByteGru(["a", "b", "c"])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    seq = rng.integers(97, 123, (6, 5)).astype(np.uint8)
    target, whole = rng.integers(0, 3, 5), np.full(5, 6)
    lstm = html_text.BlockLstm()
    lstm.p = {k: v.astype(float) for k, v in lstm.p.items()}
    some = [html_text.drawn_page(Pages(9)) for _ in range(2)]
    x, n = html_text._batch([s[0] for s in some])
    y = np.zeros(x.shape[:2])
    for i, s in enumerate(some):
        y[: len(s[1]), i] = s[1]
    live = np.arange(len(x))[:, None] < n
    cases = [(net, lambda: -np.log(net.positions(seq, seq[::-1], whole)[:, target, np.arange(5)]).mean(), net.gradients(seq, target)), (lstm, lambda: np.where(live, np.logaddexp(0, lstm.forward(x, n)) - y * lstm.forward(x, n), 0).sum() / live.sum(), lstm.gradients(x, n, y))]
    for model, loss, grad in cases:
        for k in model.p:
            at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
            model.p[k][at] += 1e-3
            up = loss()
            model.p[k][at] -= 2e-3
            down = loss()
            model.p[k][at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-3


def test_language_by_plain_recurrence():
    """Means over every byte of a text read whole, from both sides, a byte at a time."""
    net, h = langid.ByteGru(["a", "b", "c"]), langid.HIDDEN
    p = {k: v.astype(float) for k, v in net.p.items()}

    def states(raw, d):
        s, out = np.zeros((h, 1)), []
        for b in raw:
            v, e = p["u"][d] @ s, p["x"][d][:, [b]]
            z, r = (1 + np.tanh(e[:h] + v[:h])) / 2, 1 + np.tanh(e[h : 2 * h] + v[h : 2 * h])
            n = np.tanh(e[2 * h :] + r * (v[2 * h :] + p["c"][d]))
            s = z * s + (1 - z) * n
            out.append(s)
        return out

    def plain(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        total = np.zeros(3)
        for f, b in zip(states(raw, 0), states(raw[::-1], 1)[::-1], strict=True):
            e = np.exp(p["o"][0] @ f + p["o"][1] @ b + p["ob"]).ravel()
            total += e / e.sum()
        return total / len(raw)

    some = ["a", "Word, 12 more!", "é", "x" * 448, "Grüße aus Köln " * 20, "42 \n", "", None]
    got = langid.pool(net, some)
    for t, row in zip(some, got, strict=True):
        assert np.allclose(row, plain(t) if t and any(map(str.isalpha, t)) else 0, atol=1e-5)
    long = "The quick brown fox, 7 times. " * 200
    assert np.allclose(langid.pool(net, [long])[0], plain(long), atol=1e-3)  # stretches know their surroundings


def test_html_on_drawn_pages():
    net, pages, right, total = html_text.train(), Pages(77), 0, 0
    for _ in range(120):
        x, y = html_text.drawn_page(pages)
        if len(y):
            p = net.forward(*html_text._batch([x]))[:, 0] > 0
            right, total = right + (p == (y > 0.5)).sum(), total + len(y)
    assert right / total > 0.97


def test_html_leaves():
    got = html_text.leaves('<nav><a href="x">Home</a></nav><!-- no --><script>var t="</p>";</script><article><h1>A &amp; b</h1><p><b>one<br>two<p>three <i>f</i>our</article>')
    assert [(f.text, f.path) for f in got] == [("Home", ("nav",)), ("A & b", ("article", "h1")), ("one two", ("article", "p")), ("three four", ("article", "p"))]


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas().drop_duplicates("doc_id")
    fold = lambda d: d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).to_numpy()
    held = fold(docs)
    fit = docs[~held].groupby("lang").head(250)
    net = langid.train(list(zip(fit.text, fit.lang, strict=True)))
    test = docs[held].head(800)
    p = langid.pool(net, test.text.tolist())
    assert (np.array(net.labels)[p.argmax(axis=1)] == test.lang.to_numpy()).mean() > 0.99

    both = docs.merge(labels, on="doc_id")
    held = fold(both)
    fit = both[~held]
    machine = toxicity.train(fit.text.tolist(), fit.toxic.tolist(), float(fit.toxic.mean()))
    test = both[held]
    score = machine.scores(test.text.tolist())
    y = test.toxic.to_numpy()
    rank = np.argsort(np.argsort(score))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9
    insult = machine.scores(["and the idiot of", "and the id-iot of", "and the i d i o t of", "and the ation of"])
    assert min(insult[:3]) > 0.5 > insult[3]


def test_letters_put_in():
    """A letter put into an insult anywhere is read over, clean words stay clean."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "moron", "scumbag", "worthless", "imbecile"]
    clean = [" ".join(word() for _ in range(40)) for _ in range(300)]
    toxic = [" ".join([*(word() for _ in range(20)), rng.choice(insults), *(word() for _ in range(20))]) for _ in range(150)]
    machine = toxicity.train(clean + toxic, [0] * 300 + [1] * 150, 0.1)
    assert machine.letters_out
    put_in = [f"{word()} {w[:k]}{c}{w[k:]} {word()}" for w in insults for k in range(1, len(w)) for c in "xoe"]
    with_out = toxicity.Machine(machine.table, machine.offset, machine.slope, machine.bias, letters_out=False)
    assert (machine.scores(put_in) >= 0.5).mean() > max(0.9, (with_out.scores(put_in) >= 0.5).mean())
    fresh = [" ".join(word() for _ in range(40)) for _ in range(300)]
    assert (machine.scores(fresh) >= 0.5).mean() < 0.02


@needs_data
def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    base = [(i, t) for i, t in enumerate(x for _, x in texts(8, 40) if x and len(x) > 400)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in base]
    leak = "a benchmark passage that no clean document holds, long enough to be called a leak by any measure of length"
    docs += [(100, docs[0][1], "en", "s0", 1), (101, f"{docs[1][1]} {leak}", "en", "s1", 1), (102, "12345 !!! ???", "en", "s2", 1), (103, f"{docs[2][1][::-1]} write to jo.do@example.org", "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        rows = out.collect()
        kept.append({r["doc_id"] for r in rows})
        now = spark.createDataFrame(rows, now.schema)
    every = {d[0] for d in docs}
    assert kept[0] == every - {102}
    assert 100 not in kept[1] and 0 in kept[1]
    assert kept[1] - kept[2] == {101} & kept[1] and kept[3] == kept[2]
    masked = {r["doc_id"]: r["text"] for r in now.collect()}
    assert masked[103].endswith("write to [email]")
    mixed = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} <= kept[3] and all(1 <= r["copies"] <= 3 for r in mixed)
    words = {s: sum(r["taken"] for r in mixed if r["source"] == s) for s in ("s0", "s1", "s2")}
    target = {r["source"]: r["target"] for r in mixed}
    assert all(abs(words[s] - target[s]) < 0.2 * target[s] for s in target)
