"""Frontier, folds, graph, joins, metrics and streaming on small inputs, against known values and plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.engine import Engine, RequestError
from webloom.functions import folds, machines
from webloom.operators import frontier, graph, joins, metrics
from webloom.streaming import stateful


def fold(spark, rows, fields, expression):
    """The fold's result over rows (tuples with a leading order number)."""
    df = spark.createDataFrame([("k", i, *r) for i, r in enumerate(rows)], f"key string, i int, {fields}")
    names = [f.split()[0] for f in fields.split(", ")]
    return metrics.replay(df, "key", ["i"], names, expression(F.col("events"))).first()["result"]


@pytest.mark.parametrize(("low", "high", "events", "ceiling"), [(2, 100, "s" * 10, 12), (2, 100, "s" * 10 + "f", 6), (2, 100, "s" * 10 + "ff", 3), (2, 100, "s" * 10 + "fff", 2), (1, 5, "s" * 100, 5), (5, 20, "s" * 15, 20)])
def test_aimd(spark, low, high, events, ceiling):
    assert fold(spark, [(e == "s",) for e in events], "ok boolean", lambda e: folds.aimd(e, low, high)) == ceiling


def test_ewma_order(spark):
    scores = {ms: fold(spark, [(True, ms)] * 10, "ok boolean, ms double", folds.ewma_score) for ms in (10.0, 100.0, 500.0)}
    for ms, s in scores.items():
        assert abs(s - (1000 / ms + (1 - 1000 / ms) * 0.7**10)) < 1e-9
    assert fold(spark, [(True, 0.0)], "ok boolean, ms double", folds.ewma_score) == pytest.approx(0.7)


def test_breaker(spark):
    run = lambda rows, most, timeout: tuple(fold(spark, rows, "t double, ok boolean", lambda e: folds.breaker(e, most, timeout)))
    fails = [(float(i), False) for i in range(3)]
    assert run(fails, 3, 5.0)[0] == 1
    assert run([*fails, (2.5, True)], 3, 5.0) == (1, 3, 2.0, 3, 1)
    assert run([*fails, (9.0, True)], 3, 5.0) == (0, 0, 2.0, 4, 0)
    assert run([*fails, (9.0, False)], 3, 5.0)[:2] == (1, 4)


def test_cache(spark):
    run = lambda times, ttl: [o for (o,) in machines.cache_outcomes(ttl).advance((None, 0, 0, 0), times)[1]]
    assert run([0.0, 0.0, 0.085], 0.1) == ["miss", "hit", "stale_revalidate"]
    assert run([0.0, 0.06], 0.05) == ["miss", "miss"]


def test_recrawl(spark):
    run = lambda *rows: tuple(fold(spark, rows, "t long, changed boolean", folds.recrawl))
    assert run((0, True)) == (0, 86400.0)
    assert run((0, True), (21600, True)) == (21600, 66960.0)
    assert run((0, True), (21600, True), (30000, False)) == (21600, 80352.0)
    assert run((0, True), *[(i, True) for i in range(1, 40)])[1] == 300.0
    assert run((0, True), *[(i, False) for i in range(1, 40)])[1] == 2592000.0


def test_fair_batches(spark):
    def fair(sizes, n):
        rows = [(d, f"{d}{i:03}", float(i)) for d, size in sizes.items() for i in range(size)]
        got = frontier.fair(spark.createDataFrame(rows, "domain string, url string, score double"), n).collect()
        return {d: sum(r["domain"] == d for r in got) for d in sizes}, got

    counts, got = fair({"a": 90, "b": 9, "c": 1}, 10)
    assert counts == {"a": 9, "b": 1, "c": 1} and {r["url"] for r in got if r["domain"] == "b"} == {"b008"}
    assert fair({"a": 1, "b": 1, "c": 1}, 1)[0] == {"a": 1, "b": 1, "c": 1}
    assert frontier.fair(spark.createDataFrame([], "domain string, url string, score double"), 5).count() == 0


def test_frontier_and_seen(spark):
    pushes = spark.createDataFrame([("u", 1.0, 1), ("v", 0.5, 2), ("u", 0.5, 3)], "url string, score double, seq long")
    last = frontier.latest(pushes)
    assert {(r["url"], r["score"]) for r in last.collect()} == {("u", 0.5), ("v", 0.5)}
    assert [r["url"] for r in frontier.top(last, 1).collect()] == ["v"]  # ties to the url that sorts last
    seen = frontier.add_seen(pushes.limit(0), pushes)
    assert frontier.unseen(pushes, seen).count() == 0 and frontier.delete_seen(seen, pushes.where("url = 'u'")).count() == 1


def test_bfs_model(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(50)]
    depth, level = {0: 1}, {0}
    for d in (2, 3):
        level = {b for a, b in edges if a in level} - depth.keys()
        depth |= dict.fromkeys(level, d)
    got = graph.bounded_bfs(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long"), 3)
    assert {r["node"]: r["depth"] for r in got.collect()} == depth


PAGES = [("https://a.b/", 200, "<title>root</title><a href='/x'>x</a><a href='/bad'>y</a><a href='https://other.c/'>z</a>"), ("https://a.b/x", 200, "<title></title><a href='/deep'>d</a>"), ("https://a.b/bad", 404, "<a href='/never'>n</a>"), ("https://a.b/deep", 200, "<title>deep</title>")]


def test_engine(spark):
    pages = spark.createDataFrame(PAGES, "url string, status_code int, html string")
    hits = spark.createDataFrame([("q", 1, "Hit", "https://a.b/x", "s1"), ("q", 2, "Gone", "https://gone/", "s2"), ("q", 3, "", "https://a.b/", "s3")], "query string, rank int, title string, url string, snippet string")
    engine = Engine(pages, hits)
    assert {r["url"]: r["depth"] for r in engine.crawl("a.b/", 3).collect()} == {"https://a.b/": 1, "https://a.b/x": 2, "https://a.b/bad": 2, "https://a.b/deep": 3}
    assert engine.crawl("https://a.b/", 1).count() == 1
    assert {(r["rank"], r["title"], r["snippet"]) for r in engine.search("q").collect()} == {(1, "Hit", "s1"), (2, "Gone", "s2")}
    assert engine.call("search", '{"query": "none"}') == [] and len(engine.call("scrape", {"url": "https://a.b/", "depth": 2})) == 3
    for bad, status in ((lambda: engine.search(" "), 400), (lambda: engine.search("none"), 404), (lambda: engine.call("zz", {}), 400)):
        with pytest.raises(RequestError) as e:
            bad()
        assert e.value.status == status
    batch, seen, after = graph.next_frontier(spark.createDataFrame([("https://a.b/", 1.0), ("https://z/", 0.1)], "url string, score double"), pages.select("url").limit(0), pages.select(F.col("url").alias("src"), F.lit("/n?ref=1").alias("href")), 1)
    assert [r["url"] for r in batch.collect()] == ["https://a.b/"] and {r["url"] for r in after.collect()} == {"https://z/", "https://a.b/n"} and seen.count() == 1


def test_robots_and_picks(spark):
    robots = spark.createDataFrame([("a.b", "*", "/p", False), ("a.b", "*", "/p/q", True), ("a.b", "me", "/", False)], "domain string, agent string, path string, allow boolean")
    df = spark.createDataFrame([("https://a.b/p/x",), ("https://a.b/p/q/1",), ("https://a.b/z",), ("https://none/p",)], "url string")
    assert [r["allowed"] for r in joins.allowed(df, robots).orderBy("url").collect()] == [True, False, True, True]
    assert [r["allowed"] for r in joins.allowed(df, robots, "me").orderBy("url").collect()] == [False, False, False, True]
    pool = [("a", 0.43), ("b", 0.17), ("c", 0.12), ("d", 0.12), ("e", 0.09), ("f", 0.04), ("g", 0.03)]
    assert abs(sum(w for _, w in pool) - 1) < 1e-10
    n = 100_000
    got = {r["label"]: r["count"] / n for r in joins.weighted_pick(spark.range(n).withColumn("u", F.rand(1)), pool).groupBy("label").count().collect()}
    assert all(abs(got[k] - w) < 0.02 for k, w in pool)
    sticky = joins.sticky_pick(spark.createDataFrame([("x",), ("x",), ("y",)], "d string"), ["1", "2", "3"], "d").where("d = 'x'")
    assert sticky.select("label").distinct().count() == 1


def test_histogram_and_streaks(spark):
    df = spark.createDataFrame([("d", 0.005), ("d", 0.02), ("d", 999.0), ("d", None)], "k string, s double")
    rows = {round(r["le"], 4): r for r in metrics.histogram(df, "s", ["k"], metrics.LATENCY).collect()}
    assert rows[0.01]["count"] == 1 and rows[0.02]["count"] == 2 and rows[0.01]["total"] == 3 and len(rows) == 15
    log = spark.createDataFrame([("k", i, c == "s") for i, c in enumerate("ffsfff")], "key string, i int, ok boolean")
    assert [r["streak"] for r in metrics.failure_streaks(log, "key", ["i"], "ok").orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, float(i * 10 + rng.randrange(10)), rng.random() < 0.5, rng.random() < 0.5) for i in range(60) for k in range(3)]
    schema = "key long, event_id long, t double, ok boolean, changed boolean"
    df = spark.createDataFrame(rows, schema)
    for b in range(3):  # three files, in the order of time
        df.where(F.floor(F.col("event_id") / 20) == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def last(build, name):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    got = last(lambda s: stateful.breaker(s, 2, 30.0), "b1")
    want = metrics.replay(df, "key", ["t", "event_id"], ["ok"], folds.breaker(F.col("events"), 2, 30.0)).select("key", "result.*").drop("failed_at")
    final = got.withColumn("n", F.col("allowed") + F.col("rejected")).where("n = 60").drop("n")
    assert sorted(map(tuple, final.select("key", "state", "failures", "allowed", "rejected").collect())) == sorted(map(tuple, want.select("key", "state", "failures", "allowed", "rejected").collect()))
    whole = df.withColumn("t", F.floor("t"))
    got = last(lambda s: stateful.recrawl(s.withColumn("t", F.floor("t"))), "r1").groupBy("key").agg(F.max_by(F.struct("last", "ema"), "last").alias("x"))
    want = metrics.replay(whole, "key", ["t", "event_id"], ["t", "changed"], folds.recrawl(F.col("events")))
    assert {r["key"]: r["x"]["last"] for r in got.collect()} == {r["key"]: r["result"]["last"] for r in want.collect()}
    stateful.append_once(df, 0, str(tmp_path / "sink"))
    stateful.append_once(df, 0, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == len(rows)
