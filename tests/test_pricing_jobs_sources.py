"""Prices, jobs, files, adapters, streams and the plan that ties them together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import jobs, pricing
from papyra.plans.translate import paragraphs_of, translate_paragraphs
from papyra.sources import adapters, files
from papyra.streaming import progress

PRICES = {"currency": "CNY", "regimes": [{"effective_from": "2026-01-02T00:00:00Z", "peak_hours_utc": [[1, 4], [6, 10]], "rates": {"m": {"off_peak": {"cache_hit": 1, "cache_miss": 2, "output": 4}, "peak": {"cache_hit": 2, "cache_miss": 4, "output": 8}}, "flat": {"off_peak": {"cache_hit": 1, "cache_miss": 1, "output": 1}}}}, {"effective_from": "1970-01-01T00:00:00Z", "peak_hours_utc": [], "rates": {"m": {"off_peak": {"cache_hit": 0.5, "cache_miss": 1, "output": 2}}}}]}


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("prices") / "pricing.json"
    path.write_text(json.dumps(PRICES, indent=2))
    return files.read_prices(spark, str(path))


def test_prices(spark, prices):
    assert [r["effective_from"].year for r in prices.collect()] == [1970, 2026]
    calls = [("j", "m", "2025-12-31 23:59:59", 0), ("j", "m", "2026-01-02 00:00:00", 0), ("j", "m", "2026-01-02 03:59:59", 0), ("j", "m", "2026-01-02 04:00:00", 0), ("j", "flat", "2026-01-02 07:00:00", 0), ("k", "unknown", "2026-01-02 07:00:00", 5), ("k", "m", "1960-01-01 00:00:00", 0)]
    c = spark.createDataFrame([(j, m, t, 1_000_000, 0, o) for j, m, t, o in calls], "job string, model string, t string, tokens_hit long, tokens_miss long, tokens_out long").withColumn("ts", F.to_timestamp("t"))
    for most in (10_000, 1):
        held = pricing.in_force(c, prices, most=most)
        peak = pricing.is_peak(F.col("ts"), F.col("peak_hours"))
        priced = held.withColumn("rate", pricing.rate(F.col("rates"), F.col("model"), peak)).withColumn("cost", pricing.cost(F.col("rate"), F.col("tokens_hit"), F.col("tokens_miss"), F.col("tokens_out")))
        assert [r["cost"] for r in priced.orderBy("job", "ts", "model").collect()] == [0.5, 1.0, 2.0, 1.0, 1.0, 0.5, None]
    use = {r["job"]: r for r in pricing.usage(priced).collect()}
    assert (use["j"]["cost"], use["j"]["calls"], use["j"]["priced"]) == (5.5, 5, True)
    assert (use["k"]["cost"], use["k"]["priced"], use["k"]["tokens_out"]) == (0.5, False, 5)


@pytest.mark.parametrize("spans", [1, 3, 50])
def test_prices_by_span(spark, spans):
    """Regimes met by spans of time are those met by intervals, before the first and at the very starts too."""
    rng = random.Random(4)
    starts = sorted(rng.sample(range(0, 100_000), 40))
    at = lambda v: F.timestamp_seconds(v)
    regimes = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "regime int, s long").select("regime", at("s").alias("effective_from"))
    times = [-500, *starts[:9], *(rng.randrange(-10, 120_000) for _ in range(300))]
    calls = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "call int, t long").select("call", "t", at("t").alias("ts"))
    got = {r["call"]: r["regime"] for r in pricing.in_force_by_span(calls, regimes, "ts", "effective_from", spans).collect()}
    assert got == {i: max([k for k, s in enumerate(starts) if s <= t], default=0) for i, t in enumerate(times)}
    assert pricing.in_force(calls, regimes, most=5).count() == len(times)


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("b", 1, "done"), ("c", 3, "queued")], "job string, seq int, status string")
    last = jobs.fold_log(log).withColumn("status", jobs.reap(F.col("status")))
    assert {r["job"]: r["status"] for r in last.collect()} == {"a": "interrupted", "b": "done", "c": "interrupted"}
    assert [r["job"] for r in jobs.recent(spark.createDataFrame([("x", 1), ("y", 3), ("z", 3)], "job string, created int"), limit=2).collect()] == ["y", "z"]
    runs = spark.createDataFrame([("a", 1, 2, 3, 0.5), ("a", 1, 1, 1, 0.25)], "job string, tokens_hit int, tokens_miss int, tokens_out int, cost double")
    assert tuple(jobs.add_usage(runs).first()) == ("a", 2, 3, 4, 0.75)
    at = spark.createDataFrame([("collect", 1, 2), ("layout", 1, 1), ("context", 0, 0)], "p string, d int, t int").select(jobs.progress(F.col("p"), F.col("d"), F.col("t")).alias("r"))
    assert [round(r["r"], 6) for r in at.collect()] == [0.05, 1.0, 0.1]
    kinds = spark.createDataFrame([(["mono"],), ([],), (["dual", "mono"],)], "kinds array<string>")
    assert [r["r"] for r in kinds.select(jobs.missing_kinds(kinds).alias("r")).collect()] == [["dual"], ["mono", "dual"], []]
    own = spark.createDataFrame([("a", "x.pdf"), ("a", "x-mono.pdf"), ("b", "1.pdf"), ("b", "2.pdf")], "job string, path string")
    made = spark.createDataFrame([("a", "x-mono.pdf")], "job string, path string")
    assert [tuple(r) for r in jobs.single_source(own, made).collect()] == [("a", "x.pdf")]


def events(n=120):
    rng, at, out = random.Random(5), 0.0, []
    for i in range(n):
        at += rng.choice([0.001, 0.004, 0.02])
        out.append((f"j{i % 3}", i, "one" if i < n // 2 else "two", at))
    return out


def plain_throttle(rows):
    last, out = {}, []
    for job, seq, stage, at in rows:
        if job not in last or last[job][0] != stage or abs(at - last[job][1]) >= 0.01:
            out.append((job, seq, stage, at))
            last[job] = (stage, at)
    return sorted(out)


def test_throttle(spark):
    rows = events()
    log = spark.createDataFrame(rows, "job string, seq long, stage string, progress double")
    assert sorted(tuple(r) for r in jobs.throttled(log).collect()) == plain_throttle(rows)


def test_throttle_stream(spark, tmp_path):
    rows, kind = events(), "job string, seq long, stage string, progress double"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    told = progress.throttle_stream(stream)
    run = told.writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from told").collect()) == plain_throttle(rows)


def test_running_usage(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0.5, "2026-01-01 00:10:00"), ("a", 2, 0.25, "2026-01-01 00:50:00"), ("a", 4, 1.0, "2026-01-01 01:10:00")], "job string, tokens long, cost double, t string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job string, tokens long, cost double, ts timestamp").parquet(f"{tmp_path}/in")
    run = progress.running_usage(stream).writeStream.format("memory").outputMode("complete").queryName("use").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["window"]["start"].hour, r["tokens"], r["cost"]) for r in spark.sql("select * from use").collect()) == [(0, 3, 0.75), (1, 4, 1.0)]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.pdf", "deep/b.DOCX", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.scan_folder(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.pdf", "b.DOCX"]
    assert sorted(r["name"] for r in files.output_names(found, ["mono"]).collect()) == ["a-mono.pdf", "b-mono.pdf"]
    wanted = spark.createDataFrame([(f"{tmp_path}/a.pdf",), (f"{tmp_path}/none.pdf",), ("https://example.org/x.pdf",)], "path string")
    assert [r["path"].rsplit("/", 1)[1] for r in files.missing_files(wanted, files.scan_files(spark, str(tmp_path / "*.pdf"))).collect()] == ["none.pdf"]


def test_stores(spark, tmp_path):
    at = f"{tmp_path}/memory"
    for seq, t in ((1, "你好"), (2, "您好")):
        files.append_memory(spark.createDataFrame([("g", "{}", "hello", t, seq)], files.CACHE), at)
    assert [r["translation"] for r in files.read_memory(spark, at).collect()] == ["您好"]
    kind, at = "doc_key string, seq long, facts map<string,string>, terms map<string,string>", f"{tmp_path}/profiles"
    files.save_profiles(spark.createDataFrame([("k", 1, {"field": "logic"}, {})], kind), at)
    files.save_profiles(spark.createDataFrame([("k", 2, {}, {})], kind), at)
    assert [(r["doc_key"], r["facts"]) for r in files.read_profiles(spark, at).collect()] == [("k", {"field": "logic"})]
    both = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "found map<string,string>, known map<string,string>")
    assert both.select(files.overlay(F.col("found"), F.col("known")).alias("r")).first()["r"] == {"a": "1", "b": "3"}


def test_services_and_registry():
    assert len(adapters.SERVICES) == 24 and adapters.SERVICES["google"].limit == 5000
    deepseek = adapters.SERVICES["deepseek"]
    assert deepseek.params("en", "zh", model="m", prompt="p", other=1) == {"source": "en", "target": "zh", "model": "m", "prompt": "p"}
    assert adapters.SERVICES["google"].params("en", "zh") == {"source": "en", "target": "zh-CN"}
    r = adapters.Registry()
    r.register("fast", adapters.EchoTranslator)
    assert r.get("fast").translate("x") == "x"
    with pytest.raises(KeyError):
        r.get("precise")


def test_whole_plan(spark):
    class Flaky:
        """Fails on one text, and once before every other; counts its calls in the text it gives."""

        def __init__(self):
            self.seen = set()

        def translate(self, text):
            if text.startswith("never"):
                raise RuntimeError("no")
            if text not in self.seen:
                self.seen.add(text)
                raise OSError("once")
            return f"<{text}>"

    words = [[0, 50 + 5 * i, 700, 10, "Times", c] for i, c in enumerate("First line of text")] + [[1, 50 + 5 * i, 700, 10, "Times", c] for i, c in enumerate("12")]
    docs = spark.createDataFrame([("d", bytearray(json.dumps(words).encode()))], "path string, content binary")
    glyphs = adapters.read_glyphs(docs, adapters.TableReader)
    assert adapters.read_glyphs(docs, adapters.TableReader, [1]).count() == 2
    boxes = adapters.detect_regions(glyphs.select("doc", "page").distinct(), adapters.WholePageModel)
    paras = paragraphs_of(glyphs, boxes)
    assert {(r["page"], r["text"]) for r in paras.collect()} == {(0, "First line of text"), (1, "12")}
    memory = spark.createDataFrame([("e", "{}", "known text", "remembered")], "engine string, params string, original string, translation string")
    done = translate_paragraphs(paras.select("doc", "page", "para", "text"), memory, lambda: adapters.EchoTranslator("zh"), "e", "{}")
    assert {r["text"]: r["translation"] for r in done.collect()} == {"First line of text": "zh:First line of text", "12": "12"}
    more = spark.createDataFrame([(0, "known text"), (1, "new text"), (2, "new text"), (3, "never this"), (4, "{v0}")], "i int, text string")
    got = {r["i"]: r["translation"] for r in translate_paragraphs(more, memory, Flaky, "e", "{}").collect()}
    assert got == {0: "remembered", 1: "<new text>", 2: "<new text>", 3: "never this", 4: "{v0}"}


def test_told():
    out, last = progress.told([(1, "a", 0.0), (2, "a", 0.005), (3, "b", 0.006)], None)
    assert [o[0] for o in out] == [1, 3] and last == ("b", 0.006)
