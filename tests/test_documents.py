"""Document readers on small documents."""

import gzip
import zlib

from pyspark.sql import functions as F

from webloom.functions import text
from webloom.sources import documents, dom

HTML = """<html><head><title> T &amp; t </title><meta name="description" content="one"><meta name='description' content="two">
<meta property="og:type" content="x"><meta property="og:type" content="y"><meta property="other" content="z"></head><body><nav>menu</nav>
<script>var x = "</p>";</script><article><h1> Head </h1><p>a  b<p>c&nbsp;d <span class="my-price"> 9 </span></article><article>second</article>
<a href="#x">1</a><a href="">2</a><a href="javascript:z">3</a><a href="/k">4</a><a href="/k">5</a><img src="i.png"><img src=""><footer>f</footer>
<b class="rating">a very long rating text here</b><b class="rating">4.5</b></body></html>"""


def test_page():
    page = documents.read_page("u", HTML)
    assert page["title"] == "T & t" and page["meta_description"] == "two"
    assert page["links"] == ["/k", "/k"] and page["images"] == ["i.png"] and page["headings"] == ["Head"]
    assert page["extras"] == {"og:type": "y", "price": "9", "rating": "4.5"}
    assert page["content"] == "Head a bc d  9" or page["content"].startswith("Head a bc d")
    assert "menu" not in page["content"] and "second" not in page["content"]


def test_page_limits():
    many = "".join(f"<h2>{i}</h2><a href='/{i}'>x</a><img src='{i}'>" for i in range(150))
    page = documents.read_page("u", many)
    assert [len(page[k]) for k in ("headings", "links", "images")] == [20, 100, 30]
    long = documents.read_page("u", "<main>" + "é" * 60_000 + "</main>")
    assert long["content_length"] == 120_000 and len(long["content"].encode()) == 51_200


def test_crawler_profile():
    rules = [{"name": "a", "selector": "h1", "attr": "text"}, {"name": "b", "selector": "h9", "attr": ""}, {"name": "c", "selector": "meta[name='description']", "attr": "content"}, {"name": "d", "selector": "h1", "attr": "x"}]
    out = documents.read_html(HTML, rules)
    assert out["title"] == " T & t " and "menu" in out["text"] and 'var x = "</p>"' in out["text"]
    assert out["fields"] == {"a": "Head", "b": "", "c": "one"}


def test_other_readers():
    assert documents.read_json('{"a": ["http://x", {"b": "https://y"}], "http://key": 1}')["links"] == ["http://x", "https://y"]
    assert documents.read_json('"http://top"')["links"] == ["http://top"]
    assert documents.read_json("{bad") == documents._empty() | {"text": "{bad"}
    assert documents.read_xml("<rss><channel><item><link>http://a</link></item></channel></rss>")["links"] == ["http://a"]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://b"/></entry><entry><link>http://c</link></entry></feed>'
    assert documents.read_xml(atom)["links"] == ["http://c"]
    assert documents.read_xml("<bad")["links"] == []
    csv = documents.read_csv("h,u\n1,http://x\n")
    assert csv["fields"] == {"row_count": "2", "col_count": "2"} and csv["links"] == ["http://x"] and csv["text"] == ""
    assert documents.read_csv("a,b\n1\n")["error"] and documents.read_csv("")["fields"] == {}


def test_decompress():
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(b"abc") + raw.flush()
    assert documents.decompress("gzip", gzip.compress(b"abc")) == b"abc" and documents.decompress("deflate", deflated) == b"abc"
    assert documents.decompress("zz", b"abc") == b"abc" and len(documents.decompress("gzip", gzip.compress(bytes(99)), 10)) == 10


def test_parse(spark):
    rows = [("u1", "Text/HTML; charset=x", b"<title>a</title>"), ("u2", "application/ld+json", b'["http://x"]'), ("u3", "", b"<title>b</title>"), ("u4", "text/csv", b"a,b\n1\n"), ("u5", "image/png", b"\xff"), ("u6", None, None)]
    df = documents.parse(spark.createDataFrame(rows, "url string, content_type string, body binary"))
    got = {r["url"]: r for r in df.collect()}
    assert [got[f"u{i}"]["parser"] for i in range(1, 7)] == ["html", "json", "html", "csv", "text", "html"]
    assert got["u1"]["title"] == "a" and got["u2"]["links"] == ["http://x"] and got["u4"]["error"].startswith("csv")


def test_selectors():
    root = dom.parse("<div id=d class='a b'><p class=c>x</p></div><p data-k='price-1'>y</p>")
    one = lambda s: [n.text() for n in dom.select(root, s)]
    assert one("div.a p.c") == ["x"] and one("[data-k*='price']") == ["y"] and one("#d") == ["x"] and one("p, span") == ["x", "y"]
    assert one("p[data-k='no']") == [] and one("section p") == []


def test_rules_file():
    text_ = "rules:\n  example.com:\n    - name: title\n      selector: \"h1.x\"\n      attr: text\n    - name: d\n      selector: \"meta[name='description']\"\n      attr: content\n\n  other.org:\n    - name: t\n      selector: a\n      attr: href\n"
    assert documents.rules_from_yaml(text_) == [("example.com", 0, "title", "h1.x", "text"), ("example.com", 1, "d", "meta[name='description']", "content"), ("other.org", 0, "t", "a", "href")]
    assert documents.seeds(" a, ,b,") == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b\n\n\n\nc  d ", "")], "t string, e string")
    row = df.select(text.collapse(F.col("t")), text.word_count(F.col("t")), text.content_hash(F.col("e")), text.truncated(F.lit("aéb"), 2), text.truncated(F.lit("aéb"), 3), text.truncated(F.lit("ab"), 9)).first()
    assert list(row) == ["a b\n\nc  d", 4, "ef46db3751d8e999", "a", "aé", "ab"]
    codes = spark.createDataFrame([(100,), (204,), (302,), (404,), (503,), (None,)], "s int")
    assert [r[0] for r in codes.select(text.status_class(F.col("s"))).collect()] == ["2xx", "2xx", "3xx", "4xx", "5xx", "err"]
