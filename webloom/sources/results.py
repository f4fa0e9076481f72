"""Readers of stored search-result pages and robots.txt files, and the rows for snapshots that failed."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import truncated
from webloom.sources import documents, dom

HITS = "query string, source int, rank int, title string, url string, snippet string"
RULES = "domain string, agent string, path string, allow boolean"
ROBOTS_BYTES, PAGE_BYTES = 512 << 10, 5 << 20
#: Fixed values: (result, title, link, snippet) selectors of the two kinds of result pages.
LAYOUTS = {1: (".result", ".result__title .result__a", ".result__title .result__a", ".result__snippet"), 2: ("div.g", "h3", "a", ".VwiC3b")}


def redirect_target(href: str, parameter: str = "uddg") -> str:
    """The target of a redirect link, decoded once more after the query; a direct http link stays; else ''."""
    found = parse_qs(urlsplit(href).query).get(parameter)
    return unquote(found[0]) if found else (href if href.startswith("http") else "")


def read_results(html: str, source: int, count: int) -> list[tuple[int, str, str, str]]:
    """(rank, title, url, snippet) of at most count results, in page order."""
    result, title_at, link_at, snippet_at = LAYOUTS[source]
    out: list[tuple[int, str, str, str]] = []
    for node in dom.select(dom.parse(html), result):
        if len(out) >= count:
            break
        titles, link, snippets = list(dom.select(node, title_at)), dom.first(node, link_at), dom.select(node, snippet_at)
        title = ("".join(t.text() for t in titles) if source == 1 else titles[0].text() if titles else "").strip()
        href = link.attrs.get("href", "") if link else ""
        url = (redirect_target(href) or href) if source == 1 else (href if href.startswith("http") else "")
        if url and title:
            out.append((len(out) + 1, title, url, "".join(s.text() for s in snippets).strip()))
    return out


def hits(pages: DataFrame, count: int = 15) -> DataFrame:
    """query, source, rank, title, url, snippet from stored result pages (query, source 1 or 2, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, s, *hit) for q, s, h in zip(batch["query"], batch["source"], batch["html"], strict=True) if s in LAYOUTS for hit in read_results(h or "", s, count)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HITS.split(", ")])

    return pages.select("query", F.col("source").cast("int"), "html").mapInPandas(run, HITS)


def robots_rules(files: DataFrame) -> DataFrame:
    """domain, agent, path, allow from robots.txt files (domain, status, body); files with another status than 200 give no rules, so all is allowed.

    Lines are unfolded with built-in functions. A group's agents are those that stand above its first rule; a rule gets the last such run of agents.
    """
    text = F.make_valid_utf8(F.substring(F.col("body").cast("binary"), 1, ROBOTS_BYTES).cast("string"))  # a cut may split a character, and files may be no UTF-8 at all
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.substring_index(x, "#", 1))), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    zero = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"),
        F.array().cast("array<struct<agents:array<string>,path:string,allow:boolean>>").alias("out"),
    )

    def step(a: Column, p: Column) -> Column:
        agent, rule = p["k"] == "user-agent", p["k"].isin("allow", "disallow")
        agents = F.when(agent, F.when(a["ruled"], F.array(F.lower(p["v"]))).otherwise(F.concat(a["agents"], F.array(F.lower(p["v"]))))).otherwise(a["agents"])
        found = F.struct(a["agents"].alias("agents"), p["v"].alias("path"), (p["k"] == "allow").alias("allow"))
        out = F.when(rule & (p["v"] != ""), F.concat(a["out"], F.array(found))).otherwise(a["out"])
        return F.struct(agents.alias("agents"), F.when(agent, False).otherwise(a["ruled"] | rule).alias("ruled"), out.alias("out"))

    good = files.where("status = 200").select("domain", F.explode(F.aggregate(pairs, zero, step)["out"]).alias("r"))
    return good.select("domain", F.explode("r.agents").alias("agent"), "r.path", "r.allow")


def snapshot_results(pages: DataFrame) -> DataFrame:
    """The web profile of snapshots (url, status_code, html, error, fetch_time_ms, fetched_at); none is dropped.

    A snapshot with an error has status 0 and a title that says so; one with a status of 400 or more is not read and has the title HTTP n.
    """
    failed, refused = F.col("error").isNotNull(), F.coalesce("status_code", F.lit(0)) >= 400
    title = F.when(failed, F.concat(F.lit("Fetch error: "), "error")).when(refused, F.concat(F.lit("HTTP "), "status_code"))
    body = F.when(failed | refused, F.lit("")).otherwise(truncated(F.make_valid_utf8(F.coalesce("html", F.lit(""))), PAGE_BYTES))
    ready = pages.select("url", body.alias("html"), title.alias("__title"), F.when(failed, 0).otherwise(F.col("status_code")).alias("status_code"), "fetch_time_ms", F.col("fetched_at").alias("scraped_at"))
    known = ("status_code", "fetch_time_ms", "scraped_at")
    read = documents.page_results(ready.where("__title is null"), keep=known)
    empty = {"content": F.lit(""), "content_length": F.lit(0), "meta_description": F.lit(""), "word_count": F.lit(0), "extras": F.expr("cast(map() as map<string,string>)")}
    empty |= {c: F.array().cast("array<string>") for c in ("links", "headings", "images")}
    bad = ready.where("__title is not null").drop("html").withColumnRenamed("__title", "title").withColumns(empty)
    return read.unionByName(bad.select(*read.columns))
