"""Benchmark decontamination: a BM25 inverted index of the test items, searched for every training passage by block-max WAND.

A passage is a window of words of a whole text; windows overlap by half, and are so wide that any item's words fit into one. Words
are runs of letters, digits and underscores in lower case. An item is a question and an answer (its last line, if it has several).
It counts as leaked by a text that has at least ``SIMILARITY`` of the item's 5-word shingles, or of those of its question alone
if that has ``QUESTION`` words or more, wherever they stand: question and answer may be far apart.

Passages retrieve items by their longer part. An item may also be scattered over passages, so texts whose passages together may reach an item's threshold (the impacts of its terms
anywhere in the text, against what all of its shingles but a fifth must leave) are verified as a whole, too, first by hashes of their shingles; no item that the definition counts is lost. The threshold of each item follows: a text that qualifies lacks at most a fifth of all the
item's shingles, so the passage with the longer part scores at least that part's own score without the strongest terms that so many shingles
can take with them (``least_score``). Impacts are divided by the item's threshold, and all items that reach 1 are retrieved. Before the search, a passage is skipped if for every
item the impacts of the item's essential terms, plus all of its other ones, stay below 1. An item's other terms are its most frequent ones,
as long as their impacts add up to ``LOW`` at most. What the passages of a
text retrieve is verified on the shingles of the whole text.

The index goes to every task, for at most ``BLOCK_ITEMS`` items at a time (and ``BLOCK_WORDS`` words); larger benchmarks are searched block by block.

Nulls: null or empty texts, and items shorter than five words, match nothing; an
answer shorter than that is one shingle. A null doc_id stays null; a
null item_id is no item. Repeated rows stay repeated. Without items nothing is contaminated. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import chunks, lean, packed, unpacked

SIMILARITY, SHINGLE = 0.8, 5
BLOCK_ITEMS, BLOCK_WORDS = 5000, 2_000_000
K1, B = 1.2, 0.75
QUESTION, LOW = 10, 0.2
POSTINGS = 8  # in a block of an inverted list
WORD = re.compile(r"\w+")
LAST = 1 << 62


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """63-bit hashes of the runs of k ids."""
    h = np.zeros(max(0, ids.size - k + 1), np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + h.size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    lines = [WORD.findall(x) for x in text.lower().split("\n")]
    lines = [x for x in lines if x]
    if len(lines) < 2:
        return (lines[0] if lines else []), []
    return [w for x in lines[:-1] for w in x], lines[-1]


def least_score(segments: list[list[str]], impact: dict[str, float], missing: int) -> float:
    """The least sum of impacts of the words that are left, if at most so many shingles of the segments lack a word."""
    words, lo, hi, base = [], [], [], 0
    for seg in segments:
        n = max(1, len(seg) - SHINGLE + 1)
        for p in range(len(seg)):
            lo.append(base + min(n - 1, max(0, p - SHINGLE + 1)))
            hi.append(base + min(n - 1, p))
        words += seg
        base += n if seg else 0
    none = float("-inf")
    best = []  # best[p][j]: most impact of lost words, the last of which is p, in j shingles
    before = [0.0] + [none] * missing  # the same for words that share no shingle with p
    at = 0
    for p, w in enumerate(words):
        while at < p and hi[at] < lo[p]:
            before = list(map(max, before, best[at]))
            at += 1
        row = [none] * (missing + 1)
        cost = hi[p] - lo[p] + 1
        for j in range(cost, missing + 1):
            row[j] = before[j - cost] + impact[w]
        for q in range(at, p):
            more = max(0, hi[p] - max(lo[p], hi[q] + 1) + 1)
            for j in range(more, missing + 1):
                row[j] = max(row[j], best[q][j - more] + impact[w])
        best.append(row)
    lost = max([0.0, *(x for row in best for x in row)])
    return sum(impact[w] for w in set(words)) - lost


@dataclass
class Index:
    """Inverted lists over items 0..n-1 in this order; impacts are divided by the item's threshold."""

    items: list[int]
    sets: list[tuple[set, set]] = field(default_factory=list)  # all shingles, those of a question that counts alone
    lists: dict[str, tuple[list[int], list[float], list[float], float]] = field(default_factory=dict)  # items, impacts, maxima of blocks and of all
    terms: dict[str, int] = field(default_factory=dict)  # numbers of all terms
    rare: np.ndarray | None = None  # the place among essential terms of each, or -1
    rare_at: np.ndarray | None = None
    rare_item: np.ndarray | None = None
    rare_impact: np.ndarray | None = None
    need: np.ndarray | None = None  # what the essential terms must add in a passage
    text_need: np.ndarray | None = None  # what they must add in a whole text
    stride: int = 32
    tables: dict[int, tuple] = field(default_factory=dict)  # by length of a shingle: hashes, marks of their first bits, where each one's items begin, and these (twice the item, and 1 if in its question)
    sizes: np.ndarray | None = None  # shingles of the whole and of the question

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index:
        rows = [(i, *parts(t)) for i, t in sorted(rows)]
        rows = [r for r in rows if len(r[1]) + len(r[2]) >= SHINGLE]
        out = cls([r[0] for r in rows])
        n = len(rows)
        if not n:
            return out
        words = [q + a for _, q, a in rows]
        out.sets = [(shingles(q) | shingles(a), shingles(q) if len(q) >= QUESTION else set()) for _, q, a in rows]
        out.stride = max(32, max(map(len, words)))
        df: dict[str, int] = defaultdict(int)
        for w in words:
            for x in set(w):
                df[x] += 1
        mean = sum(map(len, words)) / n
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        low, whole = np.zeros(n), np.zeros(n)
        essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, (w, (_, q, a)) in enumerate(zip(words, rows, strict=True)):
            tf: dict[str, int] = defaultdict(int)
            for x in w:
                tf[x] += 1
            impact = {x: float(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5))) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for x, c in tf.items()}

            def least(parts_: list[list[str]], of: set, impact: dict[str, float] = impact) -> float:
                # a shingle that occurs twice is one of the set but several places
                again = sum(max(1, len(p) - SHINGLE + 1) for p in parts_) - len(set().union(*map(shingles, parts_)))
                return least_score(parts_, impact, int((1 - SIMILARITY) * len(of) + 1e-9) + again)

            longer = max(q, a, key=lambda x: len(shingles(x)))
            alone = [least([q], out.sets[i][1])] if out.sets[i][1] else []
            bound = max(1e-9, min([least([longer], out.sets[i][0]), *alone]) * (1 - 1e-9))
            whole[i] = min([least([x for x in (q, a) if x], out.sets[i][0]), *alone]) * (1 - 1e-9) / bound
            for x in sorted(impact, key=lambda x: (-df[x], x)):
                s = impact[x] / bound
                postings[x].append((i, s))
                if low[i] + s <= LOW:
                    low[i] += s
                else:
                    essential[x].append((i, s))
        for x, ps in postings.items():
            impacts = [p[1] for p in ps]
            out.lists[x] = ([p[0] for p in ps], impacts, [max(impacts[k : k + POSTINGS]) for k in range(0, len(ps), POSTINGS)], max(impacts))
        out.need, out.text_need = 1 - low, whole - low
        terms = sorted(essential)
        out.terms = {w: k for k, w in enumerate(sorted(postings))}
        out.rare = np.full(len(out.terms) + 1, -1, np.int64)  # the last is for words that are no term
        out.rare[[out.terms[w] for w in terms]] = np.arange(len(terms))
        out.rare_at = np.concatenate(([0], np.cumsum([len(essential[w]) for w in terms]))).astype(np.int64)
        flat = [p for w in terms for p in essential[w]]
        out.rare_item, out.rare_impact = np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat])
        out.number_shingles()
        return out

    def number_shingles(self) -> None:
        """Tables, by length, of the hashes of the items' shingles, and the items of each."""
        of: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (whole, question) in enumerate(self.sets):
            for g in whole:
                h = int(_hashes(np.array([self.terms[w] for w in g], np.int64), len(g))[0])
                of[len(g)][h].append(2 * i + (g in question))
        self.tables = {}
        for k, found in of.items():
            hashes = np.array(sorted(found), np.int64)
            marks = np.zeros(1 << 20, bool)
            marks[hashes >> 43] = True
            lists = [found[h] for h in hashes.tolist()]
            self.tables[k] = (hashes, marks, np.concatenate(([0], np.cumsum(list(map(len, lists))))), np.array([x for y in lists for x in y], np.int64))
        self.sizes = np.array([[len(w), len(q) or LAST] for w, q in self.sets])

    def likely(self, ids: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Those of the wanted pairs (text x items + item) that have enough shingles, by their hashes. ids: the terms of whole texts, one behind the other; text: theirs."""
        n, pairs = len(self.items), []
        for k, (hashes, marks, at, items) in self.tables.items():
            if ids.size < k:
                continue
            h = _hashes(ids, k)
            hit = np.flatnonzero(marks[h >> 43] & (text[: h.size] == text[k - 1 :]))
            place = np.minimum(np.searchsorted(hashes, h[hit]), hashes.size - 1)
            same = hashes[place] == h[hit]
            # a shingle counts once in a text
            both = np.unique(text[hit[same]] * hashes.size + place[same])
            where, place = both // hashes.size, both % hashes.size
            counts = at[place + 1] - at[place]
            entry = np.repeat(at[place] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            pairs.append(np.repeat(where, counts) * 2 * n + items[entry])
        found, times = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]), return_counts=True)
        key, question = found // 2, found % 2
        whole = np.bincount(np.searchsorted(wanted, key[np.isin(key, wanted)]), times[np.isin(key, wanted)], wanted.size)
        alone = np.bincount(np.searchsorted(wanted, key[np.isin(key, wanted)]), (times * question)[np.isin(key, wanted)], wanted.size)
        sizes = self.sizes[wanted % n]
        return wanted[(whole >= (SIMILARITY - 1e-9) * sizes[:, 0]) | (alone >= (SIMILARITY - 1e-9) * sizes[:, 1])]

    def passages(self, terms: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Blocks b of words such that the passage of blocks b and b + 1 may reach an item's threshold. terms: the essential terms' places; block: theirs."""
        key, total = self._sums(np.concatenate((terms, terms)), np.concatenate((block, block - 1)))
        return np.unique(key[total >= self.need[key % len(self.items)]] // len(self.items))

    def texts(self, terms: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The pairs (text x items + item), sorted, such that the text may reach the item's threshold as a whole. terms: the essential terms' places; text: theirs."""
        key, total = self._sums(terms, text)
        return key[total >= self.text_need[key % len(self.items)]]

    def _sums(self, terms: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of impacts for each place and item that share an essential term; as (place x items + item, sum). A term counts once in a place."""
        n, width = len(self.items), max(1, len(self.rare_at))
        pairs = np.sort(place * width + terms)
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: pairs.size]]
        place, terms = pairs // width, pairs % width
        counts = self.rare_at[terms + 1] - self.rare_at[terms]
        entry = np.repeat(self.rare_at[terms] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        key, impact = np.repeat(place, counts) * n + self.rare_item[entry], self.rare_impact[entry]
        order = np.argsort(key, kind="stable")
        key, impact = key[order], impact[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: key.size])
        return key[starts], np.add.reduceat(impact, starts) if starts.size else impact

    def search(self, words: set[str]) -> list[int]:
        """All items that reach their threshold with these words: WAND over the inverted lists, with the maxima of blocks."""
        lists = [self.lists[w] for w in words if w in self.lists]
        order = [[x[0][0], k, 0] for k, x in enumerate(lists)]  # the item that a list stands at, the list, the place in it
        found = []
        while order:
            order.sort()
            total, pivot = 0.0, None
            for item, k, _ in order:
                total += lists[k][3]
                if total >= 1:
                    pivot = item
                    break
            if pivot is None:
                break
            here = [x for x in order if x[0] <= pivot]
            for x in here:
                items = lists[x[1]][0]
                x[2] = bisect_left(items, pivot, x[2])
                x[0] = items[x[2]] if x[2] < len(items) else LAST
            live = [x for x in here if x[0] < LAST]
            to = pivot + 1
            if sum(lists[k][2][at // POSTINGS] for _, k, at in live) < 1:
                # no item can qualify before one of these blocks ends or another list begins
                ends = [lists[k][0][min(len(lists[k][0]), (at // POSTINGS + 1) * POSTINGS) - 1] + 1 for _, k, at in live]
                to = max(to, min(ends + [x[0] for x in order if x[0] > pivot and x not in here] + [LAST]))
            elif sum(lists[k][1][at] for item, k, at in live if item == pivot) >= 1:
                found.append(pivot)
            for x in live:
                if x[0] < to:
                    items = lists[x[1]][0]
                    x[2] = bisect_left(items, to, x[2])
                    x[0] = items[x[2]] if x[2] < len(items) else LAST
            order = [x for x in order if x[0] < LAST]
        return found

    def overlap(self, item: int, seen: set) -> tuple[float, float]:
        whole, question = self.sets[item]
        return len(whole & seen) / len(whole), len(question & seen) / len(question) if question else 0.0

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float]]:
        """(text's index, item's index, overlap, question's overlap) of verified items."""
        if not self.items:
            return
        docs = [WORD.findall((t or "").lower()) for t in texts]
        get, none = self.terms.get, repeat(-1)
        starts, at, terms, blocks, numbers = [], 0, [], [], []
        for words in docs:
            ids = np.fromiter(map(get, words, none), np.int64, len(words))
            numbers.append(ids)
            found = self.rare[ids]
            hit = np.flatnonzero(found >= 0)
            terms.append(found[hit])
            blocks.append(at + 1 + hit // self.stride)
            starts.append(at)
            at += 2 + len(words) // self.stride  # an empty block before each text keeps texts apart
        first = np.array(starts)
        candidates: dict[int, set[int]] = defaultdict(set)  # of each text
        for b in self.passages(np.concatenate(terms), np.concatenate(blocks)).tolist():
            d = int(np.searchsorted(first, b, "right")) - 1
            lo = max(0, (b - starts[d] - 1) * self.stride)
            words = docs[d][lo : (b - starts[d] + 1) * self.stride]
            if words and (items := self.search(set(words))):
                candidates[d].update(items)
        # items scattered over passages
        n = len(self.items)
        wanted = self.texts(np.concatenate(terms), np.repeat(np.arange(len(docs)), [x.size for x in terms]))
        some = np.unique(wanted // n)
        if some.size:
            ids, text = np.concatenate([numbers[d] for d in some.tolist()]), np.repeat(some, [numbers[d].size for d in some.tolist()])
            for x in self.likely(ids, text, wanted).tolist():
                candidates[x // n].add(x % n)
        for d, items in sorted(candidates.items()):
            wanted = set().union(*(self.sets[i][0] for i in items))
            seen = {x for k in {len(x) for x in wanted} for x in zip(*(islice(docs[d], j, None) for j in range(k))) if x in wanted}
            for i in sorted(items):
                o, q = self.overlap(i, seen)
                if max(o, q) >= SIMILARITY - 1e-9:
                    yield d, i, o, q


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of bounded size."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    k = 1 + max(size["n"] // BLOCK_ITEMS, size["chars"] // (4 * BLOCK_WORDS))
    for b in range(k):
        part = rows if k == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rest (the row's columns but text), text, leaks."""
    schema = "array<struct<item_id:bigint,overlap:double,question_overlap:double>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("question_overlap", pa.float64())]))
    out = docs.select(packed(docs, "text").alias("rest"), "text", F.lit(None).cast(schema).alias("leaks"))
    of_rest = out.schema["rest"].dataType.simpleString()
    for items in _blocks(benchmark):
        if not items:
            continue
        index = Index.build(items)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, 1, 1 << 20):
                found: list[list | None] = batch.column(2).to_pylist()
                for d, i, o, q in index.leaks(batch.column(1).to_pylist()):
                    found[d] = [*(found[d] or []), {"item_id": index.items[i], "overlap": o, "question_overlap": q}]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["rest", "text", "leaks"])

        out = out.mapInArrow(lean(run), f"rest {of_rest}, text string, leaks {schema}")
    return out.withColumn("leaks", F.array_sort("leaks"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with leaks, in place of a column of that name: the items that each text contains, as (item_id, overlap, question_overlap), by item_id; null if none."""
    return _found(docs, benchmark).select(*unpacked([c for c in docs.columns if c != "leaks"], "text", of=docs.columns), "leaks")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, overlap (the largest of an item): a row per row of docs."""
    found = leaks(docs.select("doc_id", "text"), benchmark)
    ids = F.coalesce(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])), F.array().cast("array<bigint>"))
    most = F.coalesce(F.array_max(F.transform("leaks", lambda x: F.greatest(x["overlap"], x["question_overlap"]))), F.lit(0.0))
    return found.select("doc_id", F.col("leaks").isNotNull().alias("contaminated"), ids.alias("item_ids"), most.alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain a test item, with all their columns."""
    return _found(docs, benchmark).where("leaks is null").select(*unpacked(docs.columns, "text"))
