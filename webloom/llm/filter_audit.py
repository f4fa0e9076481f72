"""How document filters interact: what each removes at each place of each order, alone and beside the others.

Whether a document fails a filter depends on the document alone (and, for repeats, on the table), never on the order. So each task packs a bitmap index of its
rows: a bit vector for each filter and label, rows sorted by part, and each part starting a new byte. For every set of filters that may stand before a filter
(80 pairs of set and filter with five) the removed rows are its vector AND NOT the OR of the set's, counted by population count for each part at once. Tasks emit
these counts, which are summed; the orders are laid over the sums at the end, so their number doesn't matter to the rows.

Texts are judged whole, as UTF-8 bytes and a piece at a time, so a very long one takes memory for its distinct words only. A null text is an empty one: it has no
words (A, and not B or C). Texts are the same if their SHA-256 is. A null doc_id has no smaller one and is none; repeated rows of one doc_id don't repeat each other,
and count each. Labels of a doc_id are taken together: it is good or toxic if any row says so; rows without labels, or with null ones, are neither. A null part is the empty
string. An empty table gives no rows. Further columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, chunks, lean, stored

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least percentage of distinct words, most percentage of capitals, characters that fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
#: Rows of one bitmap.
ROWS = 1 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _pieces(text: memoryview) -> Iterator[bytes]:
    """The text's bytes in pieces that end at a blank, so that no word is cut."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text):
            found = _BLANK.search(text[stop : stop + PIECE])
            if found:
                stop += found.end()
                break
            stop += PIECE
        yield bytes(text[start:stop])
        start = stop


def judge(text: bytes | memoryview) -> tuple[int, bytes]:
    """Which of the filters A to D a text fails, as bits from A on, and its SHA-256."""
    words = capitals = points = 0
    distinct: set[bytes] = set()
    signs, digest = False, hashlib.sha256()
    for piece in _pieces(memoryview(text)):
        found = piece.split()  # of bytes: at the blanks of ASCII
        words += len(found)
        distinct.update(found)
        capitals += len(piece) - len(piece.translate(None, _CAPITALS))
        points += len(piece) - len(piece.translate(None, _CONTINUED))
        signs = signs or _SIGNS.search(piece) is not None
        digest.update(piece)
    points = len(text) - points
    fails = (words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | signs << 3
    return fails, digest.digest()


#: Bytes within a character, of which only the first counts.
_CONTINUED = bytes(range(0x80, 0xC0))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 2, 16 << 20):
        texts = batch.column(2).cast(pa.binary()) if not pa.types.is_binary(batch.column(2).type) else batch.column(2)
        both = [judge(t.as_buffer()) if t.is_valid else judge(b"") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in both], pa.int32()), pa.array([d for _, d in both], pa.binary())], names=["doc_id", "part", "fails", "digest"])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bit k: fails filter k), one row for each of docs (doc_id, source, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    read = stored(rows.mapInArrow(lean(_judged), "doc_id long, part string, fails int, digest binary"))
    # only texts that more than one doc_id has; stored, so that the join can split a text that very many have
    firsts = checkpoint(read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    repeats = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return read.join(firsts, "digest", "left").select("doc_id", "part", (F.col("fails") + repeats).alias("fails"))


def _count(part: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the parts that there are, and for each of them and each pair of set and filter the six counts. flags: bits 0.. filters, then good and toxic."""
    order = np.argsort(part, kind="stable")
    part, flags = part[order], flags[order]
    present, starts, sizes = np.unique(part, return_index=True, return_counts=True)
    widths = (sizes + 7) // 8  # bytes of each part
    at = np.r_[0, np.cumsum(widths)]
    place = np.repeat(at[:-1] * 8 - starts, sizes) + np.arange(len(part))  # each part starts a byte

    def packed(bit: int) -> np.ndarray:
        bits = np.zeros(at[-1] * 8, np.uint8)
        bits[place] = flags >> bit & 1
        return np.packbits(bits)

    ones = np.zeros(at[-1] * 8, np.uint8)
    ones[place] = 1
    n = len(FILTERS)
    full, fails, good, toxic = np.packbits(ones), [packed(k) for k in range(n)], packed(n), packed(n + 1)
    ors = [np.zeros_like(full)] * (1 << n)
    for s in range(1, 1 << n):
        low = (s & -s).bit_length() - 1
        ors[s] = ors[s & (s - 1)] | fails[low]
    tally = lambda vector: np.add.reduceat(np.bitwise_count(vector), at[:-1], dtype=np.int64)
    rows = []
    for k in range(n):
        alone = tally(fails[k] & ~ors[(1 << n) - 1 - (1 << k)])
        for s in range(1 << n):
            if not s >> k & 1:
                removed = fails[k] & ~ors[s]
                rows.append([tally(full & ~ors[s | 1 << k]), tally(removed), tally(fails[k] & ors[s]), alone, tally(removed & good), tally(removed & toxic)])
    return present, np.array(rows).transpose(2, 0, 1)


#: (filter, set of filters before it) in the order of _count.
PAIRS = [(k, s) for k in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> k & 1]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, filter, before (the set as bits) and the six counts, of each part in a task; at most ROWS rows are held at once."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        names = pc.dictionary_encode(table.column("part")).combine_chunks()
        names = names if isinstance(names, pa.DictionaryArray) else names.chunk(0)
        present, counts = _count(names.indices.to_numpy(), table.column("flags").to_numpy())
        for i, p in enumerate(present):
            first = [pa.array([names.dictionary[int(p)].as_py()] * len(PAIRS), pa.string()), pa.array([k for k, _ in PAIRS], pa.int32()), pa.array([s for _, s in PAIRS], pa.int32())]
            yield pa.RecordBatch.from_arrays([*first, *[pa.array(counts[i, :, c]) for c in range(len(COUNTS))]], names=["part", "filter", "before", *COUNTS])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from out()
            held.clear()
    if held:
        yield from out()


def prefix_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter (number), before (bits of the filters before it), kept, removed, redundant, unique_fails, good_lost, toxic_lost: sums over all documents."""
    good, toxic = F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"), toxic.alias("bad"))
    n = len(FILTERS)
    flags = F.col("fails") + F.coalesce("good", F.lit(0)) * (1 << n) + F.coalesce("bad", F.lit(0)) * (1 << n + 1)
    ready = marked(docs).join(known, "doc_id", "left").select("part", flags.cast("int").alias("flags"))
    schema = "part string, filter int, before int, " + ", ".join(f"{c} long" for c in COUNTS)
    return ready.mapInArrow(lean(_bitmaps), schema).groupBy("part", "filter", "before").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, number of its filter, bits of the filters before it) for each permutation."""
    out = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(order), i + 1, filters.index(f), before))
            before |= 1 << filters.index(f)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the filters and step in it.

    shapley: what the step's filter removes, summed over all orders; a set of k filters stands before it in k! (4 - k)! of them.
    """
    spark, n = docs.sparkSession, len(FILTERS)
    counts = checkpoint(prefix_counts(docs, labels))
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    shares = counts.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter")).cast("long"))  # 16 rows each
    steps = F.broadcast(spark.createDataFrame(orders(), "filter_order string, step int, filter int, before int"))  # 600 rows
    return shares.join(steps, ["filter", "before"]).select("part", "filter_order", "step", *COUNTS, "shapley")
