"""Known cases of the breaker, the limiter, links, robots files and document readers, each with the rows that must come out.

The thresholds, operations and outcomes of the breaker and limiter cases, and the pages and robots files, are fixed values.
"""

import gzip

import pytest
from pyspark.sql import functions as F

from webloom.functions import folds, machines, urls
from webloom.operators import joins, metrics
from webloom.sources import documents, results

#: (case, most, timeout, [(seconds, op, success)], expected state, allowed, rejected). States: 0 closed, 1 open, 2 half-open.
_BREAKER = [
    ("closed", 3, 5.0, [(0, "allow", None)], (0, 1, 0)),
    ("trips", 3, 5.0, [(t, op, ok) for t in (0, 1, 2) for op, ok in (("allow", None), ("record", False))] + [(3, "allow", None)], (1, 3, 1)),
    ("recovers", 3, 0.05, [(0, op, ok) for _ in range(3) for op, ok in (("allow", None), ("record", False))] + [(0.06, "allow", None), (0.06, "record", True)], (0, 4, 0)),
    ("one probe", 1, 0.01, [(0, "allow", None), (0, "record", False)] + [(0.02, "allow", None)] * 5000, (2, 2, 4999)),
    ("failed probe", 1, 0.01, [(0, "allow", None), (0, "record", False), (0.02, "allow", None), (0.02, "record", False)], (1, 2, 0)),
]
_LIMITER = [
    ("start", 5, 100, "", (5, 0, 0, 0)), ("aimd", 2, 100, "s" * 10 + "fff", (2, 0, 0, 0)), ("raised", 2, 100, "s" * 10, (12, 0, 0, 0)), ("cap", 1, 5, "s" * 100, (5, 0, 0, 0)),
    ("waits", 2, 5, "aaa", (2, 2, 2, 1)), ("released", 2, 5, "aaar", (2, 2, 3, 0)), ("slot of a success", 2, 5, "aaas", (3, 3, 3, 0)), ("over the ceiling", 1, 8, "sssaaaaf", (2, 4, 4, 0)), ("drained", 2, 5, "aarr", (2, 0, 2, 0)),
]
_OPS = {"a": "acquire", "r": "release", "s": "success", "f": "failure"}
_ODD_PAGE = """<a data-href="/no" href="/yes">1</a><!-- <a href="/comment">2</a> --><a href=/bare>3</a><a href="/p?a=1&amp;b=2">4</a><a href="/it's">5</a><A HREF='/upper'>6</A>
<a href="#top">7</a><a href="javascript:x()">8</a><a href="">9</a><a>10</a><script>"<a href='/script'>"</script><a href="//cdn.c/x">11</a><a href="http://o.c/y">12</a><a href="rel">13</a>"""
_ODD_LINKS = ["/yes", "/bare", "/p?a=1&b=2", "/it's", "/upper", "//cdn.c/x", "http://o.c/y", "rel"]
_ODD_RESOLVED = ["https://a.b/yes", "https://a.b/bare", "https://a.b/p?a=1&b=2", "https://a.b/it's", "https://a.b/upper", "https://cdn.c/x", "http://o.c/y", ""]
_ROBOTS_CASES = [
    ("/private/x", "any", False), ("/private/open", "any", True), ("/a.pdf", "any", False), ("/a.pdf?x", "any", True), ("/x/y/secret", "any", False), ("/", "any", True),
    ("/private/x", "ExampleBot/1.0", True), ("/only", "ExampleBot/1.0", False), ("/only", "examplebotnews", True), ("/news", "examplebotnews", False),
]
_ROBOTS_TXT = """User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Disallow: /x/*/secret

User-agent: examplebot
Disallow: /only

User-agent: ExampleBotNews
Disallow: /news
"""
_DOCUMENTS = [  # url, content type, body, encoding; expected parser, links, error
    ("rss", "application/rss+xml", "<rss><channel><item><link>http://a/1</link><link> http://a/2 </link></item><item><title>t</title></item></channel></rss>", ("xml", [" http://a/2 "], None)),
    ("atom", "application/atom+xml", "<feed xmlns='http://www.w3.org/2005/Atom'><entry><link href='http://a/3'/></entry><entry><link>http://a/4</link></entry></feed>", ("xml", ["http://a/4"], None)),
    ("cells", "text/csv", "a,b\nhttp://c/1,x\n", ("csv", ["http://c/1"], None)),
    ("uneven", "text/csv", "a,b\nc\n", ("csv", [], "csv: rows of unequal length")),
    ("plain", "image/png", "http://p/1", ("text", [], None)),
    ("nested", "application/json", '{"z": "http://j/2", "a": ["http://j/1", {"b": "ftp://x"}]}', ("json", ["http://j/1", "http://j/2"], None)),
    ("page", "", "<a href='/1'>x</a><a href='#y'>z</a>", ("html", ["/1"], None)),
]


@pytest.mark.parametrize("case", _BREAKER, ids=[c[0] for c in _BREAKER])
def test_breaker(spark, case):
    """The breaker with requests and results as events of their own."""
    name, most, timeout, events, want = case
    rows = spark.createDataFrame([(name, i, float(t), op, ok) for i, (t, op, ok) in enumerate(events)], "name string, i int, t double, op string, ok boolean")
    found = metrics.replay(rows, "name", ["i"], ["t", "op", "ok"], folds.breaker_log(F.col("events"), most, timeout)).select("result.state", "result.allowed", "result.rejected")
    assert tuple(found.first()) == want
    state, _ = machines.breaker_log(most, timeout).advance((0, 0, 0.0, 0, 0), *zip(*events, strict=True)) if events else ((0, 0, 0.0, 0, 0), [])
    assert (state[0], *state[3:]) == want


def test_limiter(spark):
    """The adaptive limiter with slots taken and returned."""
    for name, low, high, ops, want in _LIMITER:
        rows = spark.createDataFrame([(name, i, _OPS[op]) for i, op in enumerate(ops)] or [(name, 0, "none")], "name string, i int, op string")
        assert tuple(metrics.replay(rows, "name", ["i"], ["op"], folds.limiter_log(F.col("events"), low, high)).select("result.*").first()) == want, name
        fold = machines.limiter_log(low, high)
        assert fold.advance(fold.start, [_OPS[op] for op in ops])[0] == want, name


def test_links(spark):
    """Anchors of a page with references, comments, unquoted and other attributes."""
    found = documents.page_links(spark.createDataFrame([("https://a.b/d/e", _ODD_PAGE), ("https://none/", None)], "url string, html string"))
    got = sorted(map(tuple, found.select("pos", "href", urls.resolve_link(F.col("url"), F.col("href"))).collect()))
    assert got == [(i, h, r) for i, (h, r) in enumerate(zip(_ODD_LINKS, _ODD_RESOLVED, strict=True))]


def test_robots(spark):
    """Wildcards, ends, longest rules, and agents by their beginning in any case."""
    rules = results.robots_rules(spark.createDataFrame([("a.b", 200, _ROBOTS_TXT)], "domain string, status int, body string"))
    for agent in dict.fromkeys(a for _, a, _ in _ROBOTS_CASES):
        rows = spark.createDataFrame([(p, f"https://a.b{p}") for p, a, _ in _ROBOTS_CASES if a == agent], "path string, url string")
        assert {r.path: r.allowed for r in joins.allowed(rows, rules, agent).collect()} == {p: w for p, a, w in _ROBOTS_CASES if a == agent}


def test_documents(spark):
    """Feeds, tables, text and JSON, compressed, through the readers that their types name."""
    rows = [(u, kind, gzip.compress(body.encode()), " GZip") for u, kind, body, _ in _DOCUMENTS]
    found = documents.parse(spark.createDataFrame(rows, "url string, content_type string, body binary, encoding string"))
    assert {r.url: (r.parser, r.links, r.error) for r in found.collect()} == {u: want for u, _, _, want in _DOCUMENTS}
