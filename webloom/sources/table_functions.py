"""Readers as table functions, for LATERAL use in SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from webloom.sources import documents, dom


class PageLinks:
    """pos, href: the links of a page, in order."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str]]:
        hrefs = (n.attrs["href"] for n in dom.select(dom.parse(html or ""), "a[href]"))
        yield from enumerate(h for h in hrefs if documents.is_link(h))


class PageFields:
    """name, value: what rules find in a page; rules as JSON, a list of name, selector and attr."""

    def eval(self, html: str | None, rules: str | None) -> Iterator[tuple[str, str]]:
        wanted = [{"attr": "", **r} for r in json.loads(rules or "[]")]
        yield from documents.read_html(html or "", wanted)["fields"].items()


def register(spark: SparkSession) -> None:
    """page_links(html) and page_fields(html, rules) for the session's SQL; rows pass as Arrow batches."""
    spark.udtf.register("page_links", udtf(PageLinks, returnType="pos int, href string", useArrow=True))
    spark.udtf.register("page_fields", udtf(PageFields, returnType="name string, value string", useArrow=True))
