"""URL functions against known values."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls

CANONICAL = [
    ("http://example.com/page", "https://example.com/page"),
    ("https://EXAMPLE.COM/page", "https://example.com/page"),
    ("https://example.com:443/page", "https://example.com/page"),
    ("https://example.com/page/", "https://example.com/page"),
    ("https://example.com/page#section", "https://example.com/page"),
    ("https://example.com/page?utm_source=twitter&q=foo", "https://example.com/page?q=foo"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("http://example.com:80/page", "https://example.com/page"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com/page?fbclid=abc123&id=42", "https://example.com/page?id=42"),
    ("https://h", "https://h"),
    ("https://h?b=2&a=1&a=0&UTM_X=3", "https://h?a=1&a=0&b=2"),
    ("https://h/p?a", "https://h/p?a="),
    ("https://h/p?", "https://h/p"),
    ("https://h/p?x=a%20b+c*~", "https://h/p?x=a+b+c%2A~"),
    ("https://u:p@H:8080/a//b/../../..", "https://u:p@h:8080/"),
    (None, None),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("u"))).collect()]


def test_canonical(spark):
    assert column(spark, [a for a, _ in CANONICAL], urls.canonical) == [b for _, b in CANONICAL]


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (urls.frontier_domain, ["example.com", "example.com", "sub.example.com", "", "www.a.com", "h", "h"]),
        (urls.crawler_domain, ["example.com", "example.com", "sub.example.com", "", "a.com", "h?x=1", "u"]),
        (urls.web_domain, ["www.example.com", "example.com", "sub.example.com", "", "www.a.com", "h?x=1", "u"]),
    ],
)
def test_domains(spark, f, expected):
    given = ["https://www.example.com/page", "https://example.com/page", "https://sub.example.com/page", "invalid-url", "https://WWW.A.com/", "https://h?x=1", "https://u:p@h/"]
    assert column(spark, given, f) == expected


def test_resolve(spark):
    given = ["https://x.y/z", "//cdn/x", "/p", "p", "../p", "?q", "mailto:a@b"]
    expected = ["https://x.y/z", "https://cdn/x", "http://h.com:8080/p", "", "", "", ""]
    assert column(spark, given, lambda u: urls.resolve_link(F.lit("http://h.com:8080/a/b"), u)) == expected


def test_redirect(spark):
    given = ["//search.example/l/?uddg=https%3A%2F%2Fa.b%2Fc", "//s/l/?x=1&uddg=https%253A%252F%252Fa.b", "https://direct", "/relative"]
    assert column(spark, given, urls.redirect_target) == ["https://a.b/c", "https://a.b", "https://direct", ""]


def test_priority(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' as now, cast(null as timestamp) as never, timestamp'2024-01-01 00:00:00' as old, timestamp'2024-01-02 00:00:00' as future")
    p = lambda imp, seen: urls.priority(F.lit(imp), F.col(seen), F.col("now"), F.lit(1.0))
    row = df.select(p(1.0, "never"), p(0.5, "old"), p(0.5, "future")).first()
    assert row[0] == 1.0 and abs(row[1] - 1.198948) < 1e-6 and row[2] == 0.0
