"""Queries over pages that are longer than the web profile's limits, and pages that share a url, against their SQL."""

import duckdb
import pytest

from webloom.operators import joins
from webloom.plans import catalogue

LONG = "<article><p>" + "wörd " * 20_000 + "end</p></article>"
MANY = "<article>short</article>" + "".join(f'<a href="https://x.example/{i}">x</a>' for i in range(150))


def against_sql(spark, folder, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))), sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["page_article_text", "page_totals"])
def test_long_pages(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, [(0, "https://a.example/0", LONG), (1, "https://a.example/1", MANY)])
    assert got == want


def test_pages_that_share_a_url(spark, tmp_path):
    """Pages 1 and 5 have one url, and page 1 is an error, page 5 isn't; a page without a url is visited as well."""
    link = lambda n: f'<a href="{"x" * n}">x</a>'
    urls = ["https://a.example/en/0", "https://a.example/en/5", "https://a.example/de/2", "https://a.example/en/3", None, "https://a.example/en/5", "https://b.example/en/6#top", "https://b.example/en/7"]
    pages = [(i, u, "".join(link(n) for n in range(i + 1, i + 4))) for i, u in enumerate(urls)]
    got, want = against_sql(spark, tmp_path, "crawl_to_the_end", pages)
    assert got == want and len(got) > 5


def test_equal_robots_rules_are_met_once(spark):
    """A rule that is given many times decides as one does, and only one copy goes into the join."""
    days = [(f"2024-01-{1 + n:02d}", f"2024-01-{2 + n:02d}") for n in range(3)]
    rows = [("a.example", "*", "/en/", n == 1, since, until) for n, (since, until) in enumerate(days)]
    schema = "domain string, agent string, path string, allow boolean, valid_from string, valid_to string"
    df = spark.createDataFrame([(f"https://a.example/en/{i}", f"2024-01-{1 + i % 4:02d}") for i in range(40)], "url string, at string")
    once, often = (joins.allowed(df, spark.createDataFrame(r, schema), at="at") for r in (rows, rows * 50))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect()))
    assert {r.url: r.allowed for r in often.collect()} == {f"https://a.example/en/{i}": i % 4 in (1, 3) for i in range(40)}
    assert often._jdf.queryExecution().analyzed().toString().count("Deduplicate [") >= 2  # urls and rules
