"""Result pages, robots files, failed snapshots, as-of joins and small text functions."""

from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import joins
from webloom.sources import results
from webloom.streaming import stateful

FIRST = """<div class="result"><h2 class="result__title"><a class="result__a" href="//s.example/l/?uddg=https%3A%2F%2Fa.b%2Fc"> One </a></h2><a class="result__snippet">snip <b>x</b></a></div>
<div class="result"><h2 class="result__title"><a class="result__a" href="https://direct/">Two</a></h2></div><div class="result"><h2 class="result__title"><a class="result__a" href="/r"></a></h2></div>"""
SECOND = "<div class=g><a href='https://x/'><h3>T</h3></a><span class=VwiC3b>s</span></div><div class=g><a href='/rel'><h3>no</h3></a></div>"


def test_hits(spark):
    df = spark.createDataFrame([("q", 1, FIRST), ("q", 2, SECOND), ("e", 1, None), ("z", 9, FIRST)], "query string, source int, html string")
    got = {tuple(r) for r in results.hits(df).collect()}
    assert got == {("q", 1, 1, "One", "https://a.b/c", "snip x"), ("q", 1, 2, "Two", "https://direct/", ""), ("q", 2, 1, "T", "https://x/", "s")}
    assert results.hits(df, 1).count() == 2


def test_robots_files(spark):
    body = "# c\nUser-agent: A\nuser-agent: b\nDisallow: /x # no\nAllow: /x/y\nDisallow:\nSitemap: z\n\nUser-agent: *\r\nDisallow: /"
    df = spark.createDataFrame([("d", 200, body), ("gone", 404, body), ("none", 200, None)], "domain string, status int, body string")
    got = {tuple(r) for r in results.robots_rules(df).collect()}
    assert got == {("d", a, p, w) for a in "ab" for p, w in (("/x", False), ("/x/y", True))} | {("d", "*", "/", False)}


def test_snapshots(spark):
    rows = [("u1", 200, "<title>t</title><p>a b</p>", None), ("u2", 404, "<title>x</title>", None), ("u3", 200, None, "timeout"), ("u4", 200, None, None)]
    df = spark.createDataFrame(rows, "url string, status_code int, html string, error string").withColumns({"fetch_time_ms": F.lit(1), "fetched_at": F.current_timestamp()})
    got = {r["url"]: r for r in results.snapshot_results(df).collect()}
    assert [(got[u]["title"], got[u]["status_code"]) for u in ("u1", "u2", "u3", "u4")] == [("t", 200), ("HTTP 404", 404), ("Fetch error: timeout", 0), ("", 200)]
    assert got["u1"]["word_count"] == 2 or "a b" in got["u1"]["content"]


def test_as_of(spark):
    requests = spark.createDataFrame([("k", 1.0, 1), ("k", 5.0, 2), ("k", 0.5, 3), ("z", 9.0, 4)], "key string, t double, id int")
    states = spark.createDataFrame([("k", 1.0, "a"), ("k", 4.0, "b"), ("k", 6.0, "c")], "key string, t double, state string")
    got = {r["id"]: r["state"] for r in joins.as_of(requests, states, "key", "t", "id").collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None}


def test_small_functions(spark):
    row = spark.range(1).select(
        text.escaped(F.lit("<a href='x'>&\"")), text.kilobytes(F.lit(1536)), text.rate_score(F.lit(0.5), F.lit(0.0)), text.rate_score(F.lit(1.0), F.lit(1000.0)),
        text.preview(F.lit("x" * 5000)), text.preview_extras(F.expr("map('b', repeat('y', 99), 'a', 'z')")), text.badge(F.lit(302)),
        text.output_record(F.lit("u"), F.lit("d"), F.lit("h"), F.lit(200), F.lit("1970-01-01 00:01:00").cast("timestamp"), F.lit(None).cast("binary"), F.expr("map('k', 'v')")),
    ).first()
    assert row[0] == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;" and row[1] == "1.5 KB" and row[2] == 0.5 and abs(row[3] - 0.693147) < 1e-6
    assert (len(row[4]["short"]), len(row[4]["long"])) == (500, 3000) and row[5] == {"a": "z", "b": "y" * 80} and row[6] == "warn"
    assert row[7]["fetched_at"] == 60 and row[7]["body_size"] == 0 and row[7]["fields"] == {"field_k": "v"}


def test_streamed_cache_and_schedule(spark, tmp_path):
    schema = "host string, event_id long, t double"
    spark.createDataFrame([("h", 1, 0.0), ("h", 2, 0.0), ("h", 3, 85.0), ("g", 4, 0.0), ("g", 5, 200.0)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stateful.cache_outcomes(stream, 100.0).writeStream.format("memory").queryName("cache1").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r["event_id"]: r["outcome"] for r in spark.table("cache1").collect()} == {1: "miss", 2: "hit", 3: "stale_revalidate", 4: "miss", 5: "miss"}
    seen = []
    q = stateful.every(stream, 1, lambda batch, i: seen.append(batch.count()), str(tmp_path / "s"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 5
