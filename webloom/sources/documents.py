"""Readers for stored documents: HTML (two profiles), JSON, XML feeds, CSV and text, after decompression.

``parse`` reads a table of (url, content_type, body) in one pass; each row goes to the reader that its content type names. A row that can't be read has a
reason in ``error`` and never fails the job.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import media_type, parser_of
from webloom.session import small_batches
from webloom.sources import dom

MAX_BYTES = 10 << 20
#: How many documents Python reads before it hands them back.
AT_ONCE = 100
CONTENT_BYTES, MAX_HEADINGS, MAX_LINKS, MAX_IMAGES = 50 * 1024, 20, 100, 30
PARSED = "url string, content_type string, parser string, title string, text string, links array<string>, fields map<string,string>, error string"
#: Selectors of the web profile.
NOISE = "script, style, nav, footer, header, aside, noscript, [role='complementary'], [role='navigation'], svg, iframe"
PRICE = "[class*='price'], [itemprop='price'], .a-price-whole, .product-price"
RATING = "[class*='rating'], [itemprop='ratingValue']"
_SPACES, _LINES = re.compile(r"[ \t\r\f]{2,}"), re.compile(r"\n{3,}")


def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, AT_ONCE at a time."""
    return (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE))


def is_link(href: str) -> bool:
    return href != "" and not href.startswith(("#", "javascript:"))


def is_http(value: str) -> bool:
    return value.startswith(("http://", "https://"))


def decompress(encoding: str | None, body: bytes, limit: int = MAX_BYTES) -> bytes:
    """At most limit bytes of the decoded body; unknown encodings pass through."""
    name = (encoding or "").strip().lower()
    if name == "gzip":
        return zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(body, limit)
    if name == "deflate":
        return zlib.decompressobj(-zlib.MAX_WBITS).decompress(body, limit)
    if name == "br":
        import brotli  # not everywhere

        return brotli.decompress(body)[:limit]
    return body[:limit]


def _empty() -> dict:
    return {"title": "", "text": "", "links": [], "fields": {}, "error": None}


def read_html(body: str, rules: list[dict] | None = None) -> dict:
    """Crawler profile: all links, the title as it stands, the body's whole text, and a field for each rule."""
    root = dom.parse(body)
    out = _empty()
    title, main = dom.first(root, "title"), dom.first(root, "body")
    out["title"] = title.text() if title else ""
    out["text"] = (main or root).text().strip()
    out["links"] = [n.attrs["href"] for n in dom.select(root, "a[href]") if is_link(n.attrs["href"])]
    for rule in rules or ():
        node, attr = dom.first(root, rule["selector"]), rule["attr"] or ""
        if attr in ("", "text"):
            out["fields"][rule["name"]] = node.text().strip() if node else ""
        elif node is not None and attr in node.attrs:
            out["fields"][rule["name"]] = node.attrs[attr]
    dom.free(root)
    return out


def json_links(value: object) -> list[str]:
    """The urls among a JSON document's string values, at any depth, sorted."""
    found, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack += x.values()
        elif isinstance(x, list):
            stack += x
        elif isinstance(x, str) and is_http(x):
            found.append(x)
    return sorted(found)


_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def json_urls(body: Column) -> Column:
    """The urls among the string values, at any depth, of a JSON document, sorted; none if it isn't JSON. Keys don't count.

    A built-in function takes all strings with the colon that makes one a key, so nesting needs neither recursion nor Python; those that stay are unescaped together.
    """
    strings = F.filter(F.regexp_extract_all(body, F.lit(_JSON_STRING), 0), lambda x: ~x.endswith(":") | x.endswith(':"'))
    values = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    found = F.array_sort(F.filter(values, lambda x: x.startswith("http://") | x.startswith("https://")))
    return F.when(F.try_parse_json(body).isNotNull(), found).otherwise(F.array().cast("array<string>"))


def json_documents(docs: DataFrame) -> DataFrame:
    """url, links, text of JSON documents (url, body string), as parse gives them, without Python."""
    body = F.coalesce("body", F.lit(""))
    return docs.select("url", F.coalesce(json_urls(body), F.array().cast("array<string>")).alias("links"), body.alias("text"))


def read_json(body: str) -> dict:
    out = _empty() | {"text": body}
    try:
        out["links"] = json_links(json.loads(body))
    except ValueError:
        pass  # not an error: the text stays
    return out


def read_xml(body: str) -> dict:
    """Feeds: the text, as it stands, of the last link of each channel/item and of each entry; a link without text gives none."""
    out = _empty() | {"text": body}
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return out
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
    found = [links[-1] for x in (*root.findall("channel/item"), *root.findall("entry")) if (links := x.findall("link"))]
    texts = ["".join([x.text or "", *(c.tail or "" for c in x)]) for x in found]
    out["links"] = [t for t in texts if t]
    return out


def read_csv(body: str) -> dict:
    """The number of rows (the header counts) and columns, and the cells that are urls; rows of unequal length are an error."""
    out = _empty()
    rows = [r for r in csv.reader(io.StringIO(body)) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        return out | {"error": "csv: rows of unequal length"}
    if rows:
        out["fields"] = {"row_count": str(len(rows)), "col_count": str(len(rows[0]))}
    out["links"] = [c for r in rows for c in r if is_http(c)]
    return out


def read_text(body: str) -> dict:
    return _empty() | {"text": body}


READERS = {"html": read_html, "json": read_json, "xml": read_xml, "csv": read_csv, "text": read_text}


def parse(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The parsed form of docs (url, content_type, body string or binary, and encoding if there is one). rules: (domain, pos, name, selector, attr)."""
    from webloom.functions.urls import crawler_domain

    ready = docs.select(
        "url",
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.col("body").cast("binary").alias("body"),
        (F.col("encoding") if "encoding" in docs.columns else F.lit(None).cast("string")).alias("encoding"),
    ).withColumns({"parser": parser_of(F.col("content_type")), "content_type": media_type(F.col("content_type"))})
    if rules is None:
        ready = ready.withColumn("rules", F.lit(None).cast("array<struct<pos:int,name:string,selector:string,attr:string>>"))
    else:
        of = rules.groupBy(F.col("domain").alias("__domain")).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "selector", "attr"))).alias("rules"))
        ready = ready.join(of, crawler_domain(F.col("url")) == F.col("__domain"), "left").drop("__domain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + AT_ONCE] for whole in batches for i in range(0, len(whole), AT_ONCE)):
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    text = decompress(r.encoding, bytes(r.body or b"")).decode("utf-8", "replace")
                    own = [dict(x) if isinstance(x, dict) else x.asDict() for x in r.rules] if r.rules is not None and len(r.rules) else None
                    out = read_html(text, own) if r.parser == "html" else READERS[r.parser](text)
                except Exception as e:  # a bad document is a row, not a failure
                    out = _empty() | {"error": f"{r.parser}: {type(e).__name__}"}
                rows.append({"url": r.url, "content_type": r.content_type, "parser": r.parser, **out})
            yield pd.DataFrame(rows, columns=["url", "content_type", "parser", "title", "text", "links", "fields", "error"])

    small_batches(docs.sparkSession)
    return ready.select("url", "content_type", "parser", "body", "encoding", "rules").mapInPandas(run, PARSED)


def clean_text(root: dom.Node) -> str:
    """Readable text of the first article, else the first main element, else the body, without noise."""
    chains = dom._compiled(NOISE)
    noise = lambda n: any(dom._matches(n, c) for c in chains)

    def visible(selector: str) -> dom.Node | None:
        for n in dom.select(root, selector):
            up = n
            while up is not None and not noise(up):
                up = up.parent
            if up is None:
                return n
        return None

    source = visible("article") or visible("main") or visible("body") or root
    return _LINES.sub("\n\n", _SPACES.sub(" ", source.text(noise))).strip()


def _extras(root: dom.Node) -> dict[str, str]:
    extras = {n.attrs["property"]: n.attrs["content"] for n in dom.select(root, "meta[property]") if n.attrs.get("content") and n.attrs["property"].startswith(("og:", "product:"))}
    for key, selector, most in (("price", PRICE, 1 << 30), ("rating", RATING, 20)):
        texts = (n.text().strip() for n in dom.select(root, selector))
        found = next((t for t in texts if t and len(t.encode()) < most), None)
        if found and not extras.get(key):
            extras[key] = found
    return extras


def _title(root: dom.Node) -> str:
    found = dom.first(root, "title")
    return found.text().strip() if found else ""


def _description(root: dom.Node) -> str:
    found = [n.attrs["content"] for n in dom.select(root, "meta[name='description']") if "content" in n.attrs]
    return found[-1] if found else ""


_STRINGS = pa.list_(pa.string())
#: The fields of the web profile: their types, and what gives them from the tree and the readable text.
FIELDS: dict[str, tuple[str, pa.DataType, Callable[[dom.Node, str], object]]] = {
    "title": ("string", pa.string(), lambda root, _: _title(root)),
    "content": ("string", pa.string(), lambda _, text: text),
    "content_length": ("int", pa.int32(), lambda _, text: len(text.encode())),
    "links": ("array<string>", _STRINGS, lambda root, _: [n.attrs["href"] for n in dom.select(root, "a[href]") if is_link(n.attrs["href"])]),
    "headings": ("array<string>", _STRINGS, lambda root, _: [t for n in dom.select(root, "h1, h2, h3") if (t := n.text().strip())]),
    "meta_description": ("string", pa.string(), lambda root, _: _description(root)),
    "word_count": ("int", pa.int32(), lambda _, text: len(text.split())),
    "images": ("array<string>", _STRINGS, lambda root, _: [n.attrs["src"] for n in dom.select(root, "img[src]") if n.attrs["src"]]),
    "extras": ("map<string,string>", pa.map_(pa.string(), pa.string()), lambda root, _: _extras(root)),
}
TEXTUAL = {"content", "content_length", "word_count"}
#: What the web profile leaves of long fields.
LIMITS: dict[str, Callable] = {
    "content": lambda x: x.encode()[:CONTENT_BYTES].decode("utf-8", "ignore"),
    "links": lambda x: x[:MAX_LINKS], "headings": lambda x: x[:MAX_HEADINGS], "images": lambda x: x[:MAX_IMAGES],
}


def read_page(url: str, html: str, fields: Iterable[str] = tuple(FIELDS), whole: bool = False) -> dict:
    """Web profile of a page; only what the wanted fields need is worked out. whole: without the profile's limits on content, links, headings and images."""
    root = dom.parse(html)
    text = clean_text(root) if TEXTUAL.intersection(fields) else ""
    found = {f: FIELDS[f][2](root, text) for f in fields}
    dom.free(root)
    if not whole:
        found |= {f: LIMITS[f](x) for f, x in found.items() if f in LIMITS}
    return {"url": url} | found


def page_results(pages: DataFrame, fields: Iterable[str] = tuple(FIELDS), keep: Iterable[str] = (), whole: bool = False) -> DataFrame:
    """The wanted fields of the web profile of pages (url, html), and the columns to keep as they are, one row each; null html is an empty page. whole: as in read_page."""
    fields, keep = list(fields), ["url", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [read_page("", html or "", fields, whole) for html in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([list(x[f].items()) if f == "extras" else x[f] for x in found], FIELDS[f][1]) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *fields])

    small_batches(pages.sparkSession)
    ready = pages.select(*keep, "html")
    return ready.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in ready.dtypes[:-1]] + [f"{f} {FIELDS[f][0]}" for f in fields]))


def page_links(pages: DataFrame) -> DataFrame:
    """url, pos, href: the crawlable links of pages (url, html) in document order, as ``read_html`` finds them; duplicates stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [[h for h in dom.hrefs(html or "") if is_link(h)] for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _STRINGS)], ["url", "hrefs"])

    small_batches(pages.sparkSession)
    return pages.select("url", "html").mapInArrow(run, "url string, hrefs array<string>").select("url", F.posexplode("hrefs").alias("pos", "href"))


def seeds(text: str) -> list[str]:
    """A comma-separated seed list."""
    return [s.strip() for s in text.split(",") if s.strip()]


def rules_from_yaml(text: str) -> list[tuple[str, int, str, str, str]]:
    """(domain, pos, name, selector, attr) rows of an extraction rule file: rules: domain: list of name/selector/attr."""
    out, domain, pos = [], None, -1
    item: dict[str, str] = {}

    def flush() -> None:
        if item and domain:
            out.append((domain, pos, item.get("name", ""), item.get("selector", ""), item.get("attr", "")))

    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, bare = len(bare) - len(bare.lstrip()), bare.strip()
        if bare.startswith("- "):
            flush()
            item, pos, bare = {}, pos + 1, bare[2:]
        elif indent and bare.endswith(":") and not item.get("name") or indent == 2 and bare.endswith(":"):
            flush()
            item, domain, pos = {}, bare[:-1].strip("'\""), -1
            continue
        key, _, value = bare.partition(":")
        if domain:
            value = value.strip()
            item[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    flush()
    return out
