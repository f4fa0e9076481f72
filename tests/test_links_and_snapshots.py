"""Links as the tree reader finds them, snapshots that share a url, and one source of state after thirty days."""

from pyspark.sql import functions as F

from webloom.engine import Engine
from webloom.functions import folds
from webloom.operators import metrics
from webloom.sources import documents, results

import test_known_cases


def test_links_equal_the_tree_reader(spark):
    pages = [("https://a.b/", test_known_cases._ODD_PAGE), ("https://c/", "<a href='x' href='y'>1</a><base href=z><p><a\nhref = q>2"), ("https://e/", ""), (None, "<a href=/n>")]
    got: dict = {}
    for r in documents.page_links(spark.createDataFrame(pages, "url string, html string")).orderBy("url", "pos").collect():
        got.setdefault(r["url"], []).append(r["href"])
    assert got == {u: links for u, h in pages if (links := documents.read_html(h)["links"])}


def test_crawl_follows_odd_links(spark):
    pages = spark.createDataFrame([("https://a.b/", 200, test_known_cases._ODD_PAGE), ("https://a.b/p?a=1&b=2", 200, ""), ("https://a.b/bare", 200, ""), ("https://a.b/no", 200, "")], "url string, status_code int, html string")
    found = {r["url"] for r in Engine(pages).crawl("https://a.b/", 2).collect()}
    assert {"https://a.b/p?a=1&b=2", "https://a.b/bare"} <= found and "https://a.b/no" not in found


def test_snapshots_keep_their_own_columns(spark):
    rows = [("u", 200, "<title>a</title>", None, 1, "2024-01-01"), ("u", 301, "<title>b</title>", None, 2, "2024-01-02"), (None, 200, "<title>c</title>", None, 3, "2024-01-03"), ("u", 500, "<title>d</title>", None, 4, "2024-01-04")]
    df = spark.createDataFrame(rows, "url string, status_code int, html string, error string, fetch_time_ms long, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = sorted((r["fetch_time_ms"], r["url"], r["status_code"], r["title"], r["scraped_at"].day) for r in results.snapshot_results(df).collect())
    assert got == [(1, "u", 200, "a", 1), (2, "u", 301, "b", 2), (3, None, 200, "c", 3), (4, "u", 500, "HTTP 500", 4)]


def test_wanted_fields_only(spark):
    df = spark.createDataFrame([("u", "<title>t</title><h1>h</h1><meta property='og:x' content='y'><img src=i><p>two words</p>", 7)], "url string, html string, n int")
    whole, some = documents.page_results(df).first(), documents.page_results(df, ["extras", "headings"], keep=["n"]).first()
    assert some.asDict() == {"url": "u", "n": 7, "extras": whole["extras"], "headings": ["h"]} and whole["extras"] == {"og:x": "y"} and whole["images"] == ["i"] and whole["word_count"] >= 2


def test_change_after_thirty_days_is_a_first_one(spark):
    rows = [("k", 0, 0, True), ("k", 1, 100_000, True), ("k", 2, 100_000 + 2_592_000, True), ("j", 0, 0, True), ("j", 1, 2_000_000, False), ("j", 2, 2_591_999, True)]
    df = spark.createDataFrame(rows, "key string, i int, t long, changed boolean")
    got = {r["key"]: tuple(r["result"]) for r in metrics.replay(df, "key", ["i"], ["t", "changed"], folds.recrawl(F.col("events"))).collect()}
    assert got == {"k": (2_692_000, 86_400.0), "j": (2_591_999, float(round(0.3 * 2_591_999 + 0.7 * 103_680)))}
