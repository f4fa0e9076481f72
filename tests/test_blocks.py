"""As-of lookups, range picks, robots rules and the crawl, against plain versions, with keys and ties that fill several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.engine import Config, Engine, RequestError
from webloom.operators import crawl, graph, joins, membership
from webloom.session import new_folder
from webloom.sources import documents, results, table_functions


@pytest.mark.parametrize(("seed", "blocks", "before"), [(1, 1, False), (2, 6, False), (3, 25, False), (4, 9, True)])
def test_as_of(spark, seed, blocks, before):
    dice = random.Random(seed)
    key = lambda: dice.choice([7, 7, 7, 7, 1, 2, None])
    requests = [(i, key(), dice.choice([None, *range(40)]), "r") for i in range(200)]
    states = [(key(), dice.choice([None, *range(40)]), dice.choice([None, 1, 2, 3]), "s") for _ in range(120)]
    got = joins.as_of(spark.createDataFrame(requests, "id long, key long, ts long, tag string"), spark.createDataFrame(states, "key long, ts long, v long, own string"), "key", "ts", "id", before, blocks)
    want = []
    for i, k, t, tag in requests:
        found = [(ts, v is not None, v or 0) for sk, ts, v, _ in states if None not in (k, t, sk, ts) and sk == k and (ts < t or ts == t and not before)]
        last = max(found, default=None)
        want.append((i, k, t, tag, (last[2] if last[1] else None) if last else None, "s" if last else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_as_of_is_spread(spark):
    """A key with all of the rows is in many tasks."""
    rows = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("ts"), "id")
    plan = joins.as_of(rows, rows.select("key", "ts", F.col("id").alias("v")), "key", "ts", "id", blocks=16)
    sizes = plan.groupBy(F.spark_partition_id()).count().collect()
    assert plan.where("v <> id").count() == 0 and plan.count() == 4000 and len(sizes) > 1


@pytest.mark.parametrize("blocks", [1, 7])
def test_range_pick(spark, blocks):
    dice = random.Random(blocks)
    pool = [(i, dice.choice([0, 1, 2, 50, None]), f"p{i}") for i in range(60)]
    numbers = [(i, dice.choice([-1.0, 0.0, 0.5, 1.0, dice.uniform(0, 900), 1e9])) for i in range(150)]
    df, table = spark.createDataFrame(numbers, "n long, at double"), spark.createDataFrame(pool, "pos long, weight long, label string")
    got = dict(joins.range_pick(df, table, "at", blocks=blocks).select("n", "label").collect())
    some = [(w, label) for _, w, label in pool if w]

    def plain(x):
        total = 0
        for w, label in some:
            total += w
            if x <= total:
                return label
        return some[-1][1]

    assert got == {n: plain(x) for n, x in numbers}
    assert [tuple(r) for r in df.sparkSession.range(1).select(joins.weight_sum(table)).collect()] == [(sum(w for w, _ in some),)]
    cum = sorted((r.pos, r.lo, r.hi) for r in joins.cumulative(table.where("weight > 0"), blocks=blocks).collect())
    assert all(a[2] == b[1] for a, b in zip(cum, cum[1:], strict=False)) and cum[0][1] == 0
    plan = joins.range_pick(df, table, "at")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_rules_and_versions(spark):
    """A domain's rules are no array, the longest decides, and each holds for its time only."""
    rules = [("a.b", "*", f"/p{i}/", i % 2 == 0, None, None) for i in range(3000)] + [("a.b", "*", "/p7/open", True, "2024-01-05", "2024-01-10"), ("a.b", "*", "/p8", False, "2024-01-05", None), ("a.b", "*", "/p8/", False, "2024-02-01", None)]
    robots = spark.createDataFrame(rules, "domain string, agent string, path string, allow boolean, valid_from string, valid_to string")
    asked = [("https://a.b/p7/open/x", "2024-01-04", False), ("https://a.b/p7/open/x", "2024-01-05", True), ("https://a.b/p7/open/x", "2024-01-10", False), ("https://a.b/p8/y", "2024-01-06", True), ("https://a.b/p8x", "2024-01-06", False), ("https://c.d/p7/", "2024-01-06", True), (None, None, True)]
    df = spark.createDataFrame([(u, t, str(i)) for i, (u, t, _) in enumerate(asked)], "url string, at string, domain string")
    got = joins.allowed(df, robots, at="at")
    assert got.columns == ["url", "at", "domain", "allowed"]
    assert {r.domain: r.allowed for r in got.collect()} == {str(i): w for i, (_, _, w) in enumerate(asked)}


PAGES = [("https://a.b/", None), ("https://a.b/1", None), ("https://a.b/2", "timeout"), ("https://a.b/x/3", None), ("https://c.d/", None)]
LINKS = [("https://a.b/", "https://a.b/1"), ("https://a.b/", "https://a.b/2"), ("https://a.b/1", "https://a.b/x/3"), ("https://a.b/1", "https://c.d/"), ("https://c.d/", "https://a.b/"), ("https://c.d/", "https://e.f/"), ("https://a.b/x/3", "https://never/"), ("https://c.d/", None)]
WANT = {("https://a.b/", "crawled", None), ("https://a.b/1", "crawled", None), ("https://a.b/2", "dropped", "fetch: timeout"), ("https://a.b/x/3", "dropped", "robots"), ("https://c.d/", "crawled", None), ("https://e.f/", "dropped", "missing")}


@pytest.mark.parametrize("batch", [None, 1])
def test_crawl(spark, batch):
    pages, links = spark.createDataFrame(PAGES, "url string, error string"), spark.createDataFrame(LINKS, "src string, dst string")
    robots = spark.createDataFrame([("a.b", "*", "/x", False)], "domain string, agent string, path string, allow boolean")
    seeds = spark.createDataFrame([("https://a.b/",), ("https://a.b/",), (None,)], "url string")
    folder = new_folder(spark, "crawl")
    # stopped in the middle, and gone on with
    part = crawl.crawl(pages, links, seeds, robots, batch=batch, folder=folder, most_steps=2).collect()
    assert 0 < len(part) < len(WANT) and crawl.finished_steps(spark, folder) == 2
    whole = crawl.crawl(pages, links, seeds, robots, batch=batch, folder=folder).collect()
    assert {(r.url, r.outcome, r.reason) for r in whole} == WANT and len(whole) == len(WANT)
    once = crawl.crawl(pages, links, seeds, robots, batch=batch).collect()
    assert sorted(once) == sorted(whole)
    if batch:
        assert [r.step for r in sorted(whole, key=lambda r: r.step)] == list(range(1, len(WANT) + 1))  # one url a step


def test_nothing_to_crawl(spark):
    pages, links = spark.createDataFrame([], "url string, error string"), spark.createDataFrame([], "src string, dst string")
    assert crawl.crawl(pages, links, spark.createDataFrame([], "url string")).collect() == []


def test_membership(spark):
    """Deleted keys are gone from the filter, parts add up, and what it rules out is never shuffled."""
    keys = spark.range(3000).withColumnRenamed("id", "k")
    words = membership.words_for(3000)
    parts = [membership.members(keys.where(f"k % 3 = {i}"), "k", words) for i in range(3)]
    full = membership.merged(*parts)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, membership.members(keys, "k", words).collect()))
    half = membership.without(full, keys.where("k >= 1500"), "k", words)
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, membership.members(keys.where("k < 1500"), "k", words).collect()))
    others = spark.range(10_000, 40_000).withColumnRenamed("id", "k")
    may, new = membership.split(others.unionByName(keys), full, "k", words)
    assert new.where("k < 3000").count() == 0 and may.count() - 3000 < 0.04 * 30_000
    got = membership.unseen(others.unionByName(keys), keys.where("k < 1500"), half, "k", words)
    assert got.count() == 31_500 and got.where("k < 1500").count() == 0
    assert membership.unseen(spark.createDataFrame([(None,)], "k long"), keys, full, "k", words).count() == 1
    with pytest.raises(ValueError, match="at most"):
        membership.members(keys, "k", 1 << 40)


def test_json_urls(spark):
    """As the reader in Python finds them, at any depth."""
    bodies = [
        '{"a": "http://1", "b": ["https://2", {"http://key": "x", "c": [[["http://3"]]]}], "http://4": 5}', '"http://top"', '["a\\"http://no", "http:\\/\\/esc\\u0041", "http://x\\\\"]', '{"a": "http://1"', "", None, "[]", '{"k" : "http://1", "t": ":"}',
        '["http://a:", "http://b", ":", "x:"]', '{"u": "http://\\u00e9", "v": null, "w": 1.5}',
    ]
    docs = spark.createDataFrame([(str(i), b, "application/json") for i, b in enumerate(bodies)], "url string, body string, content_type string")
    native = documents.json_documents(docs)
    assert "Python" not in native._jdf.queryExecution().toString()
    assert {r.url: (r.links, r.text) for r in native.collect()} == {r.url: (r.links, r.text) for r in documents.parse(docs).collect()}


def test_table_functions(spark):
    table_functions.register(spark)
    html = "<h1>T</h1><a href='/1'>x</a><a href='#n'>y</a><a href='/2'>z</a>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    rows = spark.sql("select id, pos, href from {d}, lateral page_links(html)", d=df).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "/1"), (1, 1, "/2")]
    rules = '[{{"name": "h", "selector": "h1"}}]'
    rows = spark.sql(f"select id, name, value from {{d}}, lateral page_fields(html, '{rules}')", d=df).collect()
    assert sorted(map(tuple, rows)) == [(1, "h", "T"), (2, "h", ""), (3, "h", "")]


def test_bodies_that_are_no_utf8(spark):
    """A broken robots file, and bodies whose cut splits a character, are rows like others."""
    whole = "User-agent: *\nDisallow: /a\n"
    long_ = (whole + "#" * (results.ROBOTS_BYTES - len(whole) - 1) + "é\nDisallow: /b").encode()
    files = spark.createDataFrame([("bad", 200, whole.encode() + b"Disallow: /\xe9x\n# \xff\xfe"), ("long", 200, long_), ("none", 404, b"\xff")], "domain string, status int, body binary")
    got = results.robots_rules(files)
    assert {(r.domain, r.path) for r in got.collect() if r.domain == "long"} == {("long", "/a")}
    assert {(r.domain, r.path) for r in got.collect() if r.domain != "long"} == {("bad", "/a"), ("bad", "/\ufffdx")}
    page = "<p>" + "x" * (results.PAGE_BYTES - 4) + "é tail</p>"
    pages = spark.createDataFrame([("u", page, 200, None, 1)], "url string, html string, status_code int, error string, fetch_time_ms long").withColumn("fetched_at", F.current_timestamp())
    row = results.snapshot_results(pages).select("status_code", "content_length").first()
    assert row.status_code == 200 and row.content_length == results.PAGE_BYTES - 4


def test_second_source_serves_only_on_errors(spark):
    pages = spark.createDataFrame([("https://a.b/", 200, "<title>t</title>")], "url string, status_code int, html string")
    hit = lambda q, s, e=None: (q, s, None if e else 1, None if e else "T", None if e else "https://a.b/", "", e)
    rows = [hit("both", 1), hit("both", 2), hit("failed", 1, "timeout"), hit("failed", 2), hit("second only", 2), hit("down", 1, "x"), hit("down", 2, "y")]
    engine = Engine(pages, spark.createDataFrame(rows, "query string, source int, rank int, title string, url string, snippet string, error string"))
    assert engine.search("both").count() == 1 and engine.search("failed").count() == 1
    for query, status in (("second only", 404), ("down", 500), ("nothing", 404)):
        with pytest.raises(RequestError) as e:
            engine.search(query)
        assert e.value.status == status
    assert engine.call("search", {"query": "second only"}) == []


def test_engine_reads_its_settings(spark):
    log = spark.createDataFrame([(1, i, float(i), i > 3) for i in range(9)], "key long, event_id long, t double, ok boolean")
    one = Engine(log, config=Config(max_failures=2, open_timeout_s=100.0, min_in_flight=3, max_in_flight=5, cache_ttl_s=2.0))
    assert tuple(one.breakers(log).first()) == (1, 1, 2, 2, 7)
    assert tuple(one.ceilings(log).first()) == (1, 5)
    assert sum(r.n for r in one.lookups(log).collect()) == 9
    pages = spark.createDataFrame([("https://a.b/", 200, "<a href='/1'>x</a>"), ("https://a.b/1", 200, "")], "url string, status_code int, html string")
    got = Engine(pages, config=Config(batch_size=1)).crawl_all(["https://a.b/"])
    assert {(r.url, r.outcome) for r in got.collect()} == {(u, "crawled") for u in ("https://a.b/", "https://a.b/1")}
    found = Engine(pages).crawl("a.b/", 2)
    assert {r.url: r.depth for r in found.collect()} == {"https://a.b/": 1, "https://a.b/1": 2}


def test_levels_are_stored(spark):
    """Scans don't grow with the depth."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 0), (3, 1)], "src long, dst long")
    got = graph.bounded_bfs(edges, spark.createDataFrame([(0,)], "node long"), 4)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert got._jdf.queryExecution().toString().count("SortMergeJoin") + got._jdf.queryExecution().toString().count("HashJoin") == 0
