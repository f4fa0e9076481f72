"""SimHash near-duplicate detection with tiled exact comparison.

Fingerprints: ``fingerprints`` hashes the 3-word shingles of each whole text in Arrow batches.

Comparison: two 64-bit fingerprints within ``radius`` bits agree on all but ``radius`` of ``m`` bit blocks, so every
linked pair shares one masked value (a bucket). Buckets shard the exact comparison: inside a bucket the rows are
cut into tiles, numpy takes exclusive-or and bit counts of tile pairs, and tile pairs whose population counts
differ by more than the radius are skipped. ``m`` follows from the number of distinct fingerprints alone, to keep the
expected bucket short; a bucket above ``TILE`` rows is cut into tiles by population count (and by a hash, where one count has more rows than that), and
only tile pairs whose counts are within the radius are dealt out over the tasks, so that none is ever gathered and far pairs never meet. A tile
reports a spanning forest of its links, never all pairs.

Nulls: a null text is treated as empty; texts without words have fingerprint zero and are linked like any other. A
null doc_id keeps its row; the component's id is the smallest id that is not null (null if there is none). Repeated rows stay
repeated. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, chunks, connected, labels_of

TILE = 2048
BITS = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of one text's word shingles, as an unsigned integer."""
    parts = text.lower().split()  # on bytes: A-Z are lowered, words end at \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    take = xxhash.xxh64_intdigest
    hashes = np.array([take(joined[i:j], seed) for i, j in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, 4096):
        piece = hashes[at : at + 4096]
        counts += np.unpackbits(piece.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > hashes.size).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a row per document; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 4 << 20):
            found = np.array([fingerprint(t or b"", words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text"), "utf-8").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(n: int, radius: int, row_cost: float = 300.0) -> list[int]:
    """Bit masks such that fingerprints within the radius agree under one of them; few comparisons are expected for n."""

    def made(m: int) -> list[int]:
        edges = [BITS * i // m for i in range(m + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
        return [sum(x) for x in combinations(blocks, m - radius)]

    cost = lambda ms: sum(row_cost + n / 2 ** (1 + x.bit_count()) for x in ms)
    return min((made(m) for m in range(radius + 1, radius + 5)), key=cost)


def close_pairs(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among rows sorted by group and population count; side: 0 in a tile of its own, else 1 or 2 of a tile pair."""
    pop = np.bitwise_count(fp).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [group.size])))
    left, right = [], []
    # short groups: all are compared at once, row i with row i + shift
    short = sizes <= 32
    if short.any():
        room = np.repeat(np.where(short, starts + sizes, 0), sizes)
        for shift in range(1, int(sizes[short].max())):
            i = np.flatnonzero(room > np.arange(group.size) + shift)
            if not i.size:
                break
            i = i[pop[i + shift] - pop[i] <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius]
            left.append(i)
            right.append(i + shift)
    # longer ones: tiles of rows against tiles of columns, by population count
    for at, size in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
        x, p, s = fp[at : at + size], pop[at : at + size], side[at : at + size]
        parent: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, size, 256):
            hi = min(lo + 256, size)
            for lo2 in range(lo, size, 1024):
                hi2 = min(lo2 + 1024, size)
                if p[lo2] - p[hi - 1] > radius:
                    break  # rows are sorted by population count: no later tile can be near
                near = np.bitwise_count(x[lo:hi, None] ^ x[None, lo2:hi2]) <= radius
                i, j = np.nonzero(near)
                i, j = i + lo, j + lo2
                keep = (i < j) & ((s[i] == 0) | (s[i] != s[j]))
                if keep.any():
                    parent.append((i[keep], j[keep]))
            if sum(a.size for a, _ in parent) > 1 << 20:  # only a spanning forest is kept
                tree = labels_of(size, *map(np.concatenate, zip(*parent, strict=True)))
                moved = np.flatnonzero(tree != np.arange(size))
                parent = [(tree[moved], moved)]
        for i, j in parent:
            left.append(i + at)
            right.append(j + at)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect just those distinct values of fps.fp that a chain of steps within the radius connects."""
    fps = fps.select("fp").distinct()
    spark = fps.sparkSession
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(x - (1 << BITS) if x >> (BITS - 1) else x)).alias("v")) for i, x in enumerate(masks(fps.count(), radius))])
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(keys).alias("k")).select("fp", "pop", F.xxhash64("k.t", "k.v").alias("bucket"))
    sizes = rows.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    big = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("salts"))).alias("tiles")).where(F.col("n") > tile)
    number = lambda pop, salt: pop.cast("long") * (1 << 32) + salt
    own = F.filter("tiles", lambda t: t["pop"] == F.col("pop"))[0]["salts"]
    near = F.filter("tiles", lambda t: F.abs(t["pop"] - F.col("pop")) <= radius)
    # a row of tile t in a large bucket goes to the cells {t, u} of all tiles u with near counts; the cell {t, t} compares the tile with itself
    cells = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["salts"] - 1), lambda salt: number(t["pop"], salt))))
    spread = rows.join(big.select("bucket", "tiles"), "bucket", "left").withColumn("mine", number(F.col("pop"), F.pmod(F.xxhash64("fp"), own)))
    dealt = spread.select("fp", "pop", "bucket", "mine", F.explode(F.coalesce(cells, F.array(F.lit(-1).cast("long")))).alias("other")).select(
        "fp",
        F.when(F.col("mine").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"),
        F.when(F.col("mine").isNull() | (F.col("mine") == F.col("other")), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
        "pop",
    )

    def compare(cell: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        i, j = close_pairs(fp.view(np.uint64), cell, side, radius)
        tree = labels_of(fp.size, i, j)
        moved = np.flatnonzero(tree != np.arange(fp.size))
        return pa.RecordBatch.from_arrays([pa.array(fp[tree[moved]]), pa.array(fp[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0  # the last cell may go on
            if last:
                yield compare(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held[0].size:
            yield compare(*held)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "pop").select("cell", "fp", "side").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of docs; component_id is the smallest doc_id reachable over links."""
    fps = checkpoint(fingerprints(docs, words, seed))
    roots = connected(links(fps, radius))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(lowest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays.

    Texts under one doc_id stay or go together, and of exact repeated rows one stays. Rows with a null doc_id stay, as nothing names them.
    """
    found = near_duplicates(docs, radius, words, seed)
    names = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(names, docs["doc_id"].cast("long") == names["doc_id"], "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        kept = kept.dropDuplicates()
    nameless = docs.where("doc_id is null")
    return kept if nameless.isEmpty() else kept.unionByName(nameless)
