"""Main text of web pages, with site template removal.

One pass over the tags of a page, linear in its length whatever its tags, finds all its blocks of text, menus, headers and footers included, and a hash of each
container element's subtree (its tag and, in order, its text and the hashes of its children).

1. Site templates: the hashes are counted per host in Spark, over distinct main texts, so that copies of a page count once. A subtree that recurs on at
   least ``MIN_PAGES`` main texts of its host, and on ``SHARE`` of them or on ``MANY``, is deleted from the whole page wherever it stands. Paragraphs, headings and other text
   blocks are no containers, and a subtree with ``BODY`` of a page's main text or more is never a template there, so articles that share passages or bodies stay whole.
2. Only what is left is judged by structure: if an article (else a main) element still has text, only what stands in it counts. Forms and elements
   whose tag, role, class or id marks a menu, header, footer, sidebar, notice, advert or reader comments are left out. A class or id word counts as such
   a mark only if all of its parts are marks or words for parts of a layout: related-posts is one, related-work is not.

Scripts, styles and the like are no text at all. The main text that counts and guards in step 1 is the innermost part by structure that holds ``PART`` of what isn't marked,
so a short recurring article element doesn't stand for the page.

Nulls: a null or empty html has an empty text; a null url or one without :// has the host ''. A null page_id stays null. Repeated rows stay
repeated. Very long pages are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, chunks, lean, stored

MIN_PAGES, SHARE, MANY, BODY, PART = 5, 0.02, 50, 0.8, 0.25
BROADCAST_BYTES = 16 << 20

#: Possessive, and a quote that is never closed stands for itself: so a tag only fails to match if no > follows at all.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("div section ul ol dl table details figure center fieldset nav header footer aside form menu search dialog hgroup address".split())
ENDS_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
#: An opening tag ends an open element of its own kind, up to the element that holds such.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = RAW | frozenset("head nav aside footer form template button dialog menu datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar menu navbar nav navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe popup modal comment comments disqus replies respond share sharing social related footer masthead pagination pager toolbar widget widgets".split()
)
#: Words for parts of a layout, which may stand beside a mark.
LAYOUT = frozenset(
    "site page top bottom left right main primary secondary global mobile desktop sticky fixed box bar block container wrapper wrap inner outer row col column grid list lists section area region group panel module unit slot zone item items link links icon icons button buttons btn post posts article articles story stories content text title overlay form placeholder google responsive header nav menu toggle".split()
)
#: Words with which a class tells what a page has or lacks.
ABOUT = frozenset("no has with without".split())
ROOTS = frozenset(("html", "body", "article", "main"))


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is left out by its tag or attributes."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ROOTS and tag != "article":
        return False
    for name, *values, bare in _ATTRIBUTE.findall(attributes):
        name = (name or bare).lower()
        if name == "hidden":
            return True
        if name == "role" and ROLES.intersection("".join(values).lower().split()):
            return True
        if name in ("class", "id"):
            for word in "".join(values).split():
                parts = {x.lower() for x in _PART.findall(word)}
                if parts & ABOUT:
                    continue  # it tells of another element
                if parts & MARKS and parts <= MARKS | LAYOUT or ("header" in parts and parts <= LAYOUT and not in_article and tag != "article"):
                    return True
    return False


class Page:
    """Blocks of text, whether structure leaves each out, spans of blocks of article and main elements, and the containers with text: (hash, first block, end)."""

    def __init__(self, html: str) -> None:
        self.blocks: list[str] = []
        self.marked: list[bool] = []
        self.containers: list[tuple[int, int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self._text: list[str] = []
        self._gone: list[str] = []  # text of the open block that structure leaves out
        self._stack: list[tuple[str, bool, int, list[int]]] = []  # tag, left out, first block, hashes of what is in it
        self._at: dict[str, list[int]] = {}  # places in the stack by tag
        self._raw = self._out = 0  # open elements that have no text, or are left out
        self._inside = 0  # open articles
        at, last = 0, html.rfind(">")
        while at <= last and (m := _TOKEN.search(html, at)):
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
        self._add(html[at:].partition("<!--")[0])
        while self._stack:
            self._pop()
        self._flush()

    def _add(self, text: str) -> None:
        if not self._raw:
            (self._gone if self._out else self._text).append(text)

    def _flush(self) -> None:
        for held in (self._text, self._gone):
            if not held:
                continue
            text = "".join(held)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(text)
                self.marked.append(held is self._gone)
                if self._stack:
                    self._stack[-1][3].append(xxhash.xxh3_64_intdigest(text))
            held.clear()

    def _close_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _last(self, tags: set[str]) -> int:
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and (at := self._last({"p"})) >= 0:
            self._close_to(at)
        if tag in SIBLINGS:
            same, holders = SIBLINGS[tag]
            if (at := self._last(same)) > self._last(holders):
                self._close_to(at)
        if tag == "br":
            self._add(" ")
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        out = _marked(tag, attributes, self._inside > 0)
        if out and not self._out and tag not in BLOCK:
            self._text.append(" ")
        self._out += out
        self._raw += tag in RAW
        self._inside += tag == "article"
        self._at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, out, len(self.blocks), []))

    def _end(self, tag: str) -> None:
        if at := self._at.get(tag):
            self._close_to(at[-1])
        elif tag in BLOCK:
            self._flush()

    def _pop(self) -> None:
        tag, out, first, _ = self._stack[-1]
        if tag in BLOCK or tag in RAW:
            self._flush()
        inside = self._stack.pop()[3]
        self._at[tag].pop()
        self._raw -= tag in RAW
        self._inside -= tag == "article"
        if inside:
            own = xxhash.xxh3_64_intdigest(tag.encode() + b"".join([x.to_bytes(8, "little") for x in inside]))
            if tag in CONTAINER:
                self.containers.append((own - (1 << 63), first, len(self.blocks)))
            if self._stack:
                self._stack[-1][3].append(own)
        self._out -= out
        if not self._out and not out and len(self.blocks) > first:
            if tag == "article" and not self._inside:
                self.articles.append((first, len(self.blocks)))
            elif tag == "main":
                self.mains.append((first, len(self.blocks)))

    def levels(self) -> list[int]:
        """Of each block: 3 in an article, 2 in a main element, 1 elsewhere, 0 where it is left out."""
        level = [1] * len(self.blocks)
        for value, spans in ((2, self.mains), (3, self.articles)):
            for lo, hi in spans:
                level[lo:hi] = [value] * (hi - lo)
        return [0 if out else x for x, out in zip(level, self.marked, strict=True)]

    def main(self, levels: list[int]) -> list[bool]:
        """Whether each block counts as main text before templates are known."""
        sizes = [0] * 4
        for block, level in zip(self.blocks, levels, strict=True):
            sizes[level] += len(block)
        above = [sum(sizes[x:]) for x in range(4)]
        least = max((x for x in (1, 2, 3) if above[x] and above[x] >= PART * above[1]), default=1)
        return [x >= least for x in levels]

    def parts(self, own: list[bool]) -> list[tuple[int, int, int]]:
        """The containers without those that hold BODY of the page's main text."""
        sizes = [0]
        for block, mine in zip(self.blocks, own, strict=True):
            sizes.append(sizes[-1] + len(block) * mine)
        return [(h, lo, hi) for h, lo, hi in self.containers if sizes[hi] == sizes[lo] or sizes[hi] - sizes[lo] < BODY * sizes[-1]]


def host(url: F.Column) -> F.Column:
    """What stands between the first :// and the next /, ? or #, with A-Z in lower case; '' if there is none."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


_CONTAINERS = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
_PARSED = "page_id long, url string, host string, content long, page long, blocks array<string>, levels array<tinyint>, containers array<struct<h:bigint,lo:int,hi:int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content and page (hashes of the main text and of all that was found), blocks, levels, containers (h, lo, hi): a row per row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3, 4 << 20):
            found: list[tuple] = []
            for html in batch.column(3).to_pylist():
                page = Page(html or "")
                levels = page.levels()
                own = page.main(levels)
                spans = page.parts(own)
                content = xxhash.xxh3_64_intdigest("\n".join([b for b, mine in zip(page.blocks, own, strict=True) if mine]))
                whole = xxhash.xxh3_64_intdigest(f"{content} {levels} {spans}")
                found.append((content - (1 << 63), whole - (1 << 63), page.blocks, levels, [{"h": h, "lo": lo, "hi": hi} for h, lo, hi in spans]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()), _CONTAINERS)
            columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [c.split()[0] for c in _PARSED.split(", ")])

    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    return ready.mapInArrow(lean(run), _PARSED)


def templates(found: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """host, h, n: the subtrees of parsed pages that recur on n main texts of their host, and so are deleted."""
    seen = found.select("host", "content", F.explode("containers.h").alias("h")).distinct()
    total = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents"))
    often = seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(total, "host").where((F.col("n") >= share * F.col("contents")) | (F.col("n") >= many)).select("host", "h", "n")


def _after(levels: pa.ListArray, containers: pa.ListArray, recurs: Callable[[int, np.ndarray], np.ndarray]) -> pa.Array:
    """levels with -1 for blocks in containers whose hashes recur; recurs(row, hashes)."""
    out = []
    for row, (level, held) in enumerate(zip(levels, containers, strict=True)):
        left = level.values.to_numpy().copy()
        parts = held.values
        if left.size and len(parts):
            h, lo, hi = (parts.field(i).to_numpy() for i in range(3))
            gone = recurs(row, h)
            edges = np.zeros(left.size + 1, np.int64)
            np.add.at(edges, lo[gone], 1)
            np.add.at(edges, hi[gone], -1)
            left[np.cumsum(edges[:-1]) > 0] = -1
        out.append(left)
    return pa.array(out, pa.list_(pa.int8()))


def judged(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, blocks, levels: all blocks of a page with the levels of Page.levels, and -1 for those that went with a template; a row per row of pages."""
    found = stored(parsed(pages))
    recurring = checkpoint(templates(found, min_pages, share, many).select("host", "h"))
    size = recurring.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= broadcast_bytes:
        by_host = {r["host"]: np.array(r["hs"], np.int64) for r in recurring.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("hs")).collect()}
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        @F.arrow_udf("array<tinyint>")
        def left(host: pa.Array, levels: pa.Array, containers: pa.Array) -> pa.Array:
            hosts, none = host.to_pylist(), np.zeros(0, np.int64)
            return _after(levels, containers, lambda row, h: np.isin(h, sent.value.get(hosts[row], none)))

        return found.select("page_id", "url", "blocks", left("host", "levels", "containers").alias("levels"))
    own = found.select("host", "page", F.explode("containers.h").alias("h")).distinct().join(recurring, ["host", "h"])
    lists = own.groupBy("host", "page").agg(F.collect_list("h").alias("hs"))  # no longer than a page's containers

    @F.arrow_udf("array<tinyint>")
    def left_by_list(levels: pa.Array, containers: pa.Array, hs: pa.Array) -> pa.Array:
        return _after(levels, containers, lambda row, h: np.isin(h, hs[row].values.to_numpy()) if hs[row].is_valid else np.zeros(h.size, bool))

    return found.join(lists, ["host", "page"], "left").select("page_id", "url", "blocks", left_by_list("levels", "containers", "hs").alias("levels"))


def texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of pages."""
    found = judged(pages, min_pages, share, many).withColumn("top", F.array_max("levels"))
    text = F.concat_ws("\n", F.filter("blocks", lambda b, i: (F.col("top") > 0) & (F.get("levels", i) == F.col("top"))))
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def deletions(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """page_id, n_blocks, by_template, by_structure: how many of a page's blocks are left out by either step."""
    found = judged(pages, min_pages, share, many).withColumn("top", F.greatest(F.array_max("levels"), F.lit(1)))
    count = lambda keep: F.size(F.filter("levels", keep)).cast("long")
    by_structure = count(lambda x: (x >= 0) & (x != F.coalesce("top", F.lit(1))))
    return found.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), count(lambda x: x < 0).alias("by_template"), by_structure.alias("by_structure"))
