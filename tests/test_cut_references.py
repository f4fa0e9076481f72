"""Titles and articles that end within a character reference, and null html, against brute force."""

import html
import re

from webloom.sources import documents

ENDS = ["&amp", "&am", "&a", "&", "&quo", "&quot", "&qu", "&copy", "&amp;", "&amp;&amp;&amp; b", "&ampx"]


def test_every_page_has_its_row(spark):
    pages = [(f"t{i}", f"<html><head><title>A {e}</title></head><body><article><p>B {e}</p></article></body></html>") for i, e in enumerate(ENDS)]
    got = {r["url"]: (r["title"], r["content"]) for r in documents.page_results(spark.createDataFrame([*pages, ("none", None)], "url string, html string")).collect()}
    want = {"none": ("", "")}
    for url, page in pages:
        title, article = re.search("<title>(.*?)</title>", page)[1], re.sub("<[^>]*>", "", re.search("<article>(.*?)</article>", page)[1])
        want[url] = html.unescape(title).strip(), html.unescape(article).strip()
    assert got == want
