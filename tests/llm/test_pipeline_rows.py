"""The whole pipeline against plain Python, with null and repeated ids, equal rows, ties and clashing columns."""

import hashlib
import random
import re

import pytest

from papyra.llm import pii, simhash

LEAK = "a benchmark passage that no clean document holds, long enough to be called a leak by any measure of length"


def fixture():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    text = lambda n=80: [word() for _ in range(n)]
    rows, k = [], 0
    for k in range(12):
        rows.append((k, " ".join(text()), f"s{k % 3}"))
    one, two = text(), text()
    near = list(one)
    near[40] = "changed"
    far = list(one)
    far[::9] = ["other"] * len(far[::9])
    rows += [(20, " ".join(one), "s0"), (21, " ".join(near), "s1"), (22, " ".join(far), "s1"), (None, " ".join(one).upper(), "s2")]
    rows += [(None, " ".join(two), "s0"), (None, " ".join(two), "s0"), (None, " ".join(text()), None), (30, " ".join(text()), "s1"), (30, " ".join(text()), "s1"), (30, " ".join(text()), "s1")]
    rows += [(31, f"{' '.join(text(40))} {LEAK}", "s0"), (None, f"{LEAK} {' '.join(text(40))}", "s0"), (32, f"{' '.join(text(30))} write to jo.do@example.org or +1 (555) 123-4567", "s2")]
    rows += [(33, "12345 --- !!!", "s0"), (34, "", "s1"), (35, None, "s1"), (36, "   ", "s1")]
    return [(i, t, "en", s, 7, f"extra{n}", n) for n, (i, t, s) in enumerate(rows)]


def survivors(rows):
    """Rows that the first three stages keep, by plain loops."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = [simhash.shingles(r[1], 5) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if simhash.jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    kept = [min((rows[i] for i in range(len(rows)) if group[i] == g), key=key) for g in sorted(set(group))]
    return [r for r in kept if LEAK.replace(",", "") not in re.sub(r"[^a-z0-9]+", " ", r[1].lower()).replace("  ", " ")]


def test_rows(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), survivors(rows)
    for _, stage in C.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    plain = lambda some: sorted(((r[0], r[1]) for r in some), key=repr)
    assert plain(docs.collect()) == plain(want) and len(want) > 15

    mixed = C.run(spark, str(tmp_path)).collect()
    fields = set(schema.replace(",", "").split()[::2])
    assert fields <= set(mixed[0].asDict()) and {"copies", "taken", "target"} <= set(mixed[0].asDict())
    masked = {t: pii.redact(t, [(s, pii.KINDS.index(k), e) for k, s, e, ok in pii.strict_matches(t) if ok]) for _, t in plain(want)}
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(i, masked[t]) for i, t in plain(want)}
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" and r["size"] == len(r["text"].split()) for r in mixed)
    for source in {r["source"] for r in mixed}:
        own = [r for r in mixed if r["source"] == source]
        words = [len(masked[w[1]].split()) for w in want if w[3] == source]
        assert own[0]["source_size"] == sum(words) and all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(words)
    assert sorted(map(repr, mixed)) == sorted(map(repr, C.run(spark, str(tmp_path)).collect()))
    left = [p for p in tmp_path.rglob("corpus-*")]
    assert not left  # stages stand in the shared folder, not beside the tables


def test_stage_folders_go(spark, tmp_path, monkeypatch):
    C = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(fixture()[:4], "doc_id long, text string, lang string, source string, n_chars long, extra string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(C, "shared_dir", lambda spark: str(shared))
    assert C.run(spark, str(tmp_path)).count() > 0
    (base,) = shared.iterdir()
    assert [p.name for p in base.iterdir()] == ["4-mix_sources"]
