"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that checkpoint() has the shared folder named in spark.checkpoint.dir.

    A folder of our own is used only in local mode with the setting unset, as in tests.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webloom-checkpoint-")
    context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def narrow(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, which has so many rows at most, in no more tasks than they need: a small result isn't spread over all shuffle partitions, with a file for each."""
    return df.coalesce(max(1, -(-rows // each)))


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the folder of checkpoints and read again; smaller there than checkpoint() for texts."""
    with_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession, after: tuple[float, ...] = (1.5, 2.0, 3.0)) -> None:
    """Lets Spark delete the shuffle files that nothing reads any more: it does so only when the driver collects its garbage, however full the disks are.

    The driver's JVM learns of dropped frames with some delay, so this is done a few times (after so many seconds each), beside the jobs that follow.
    """

    def collect() -> None:
        with contextlib.suppress(Exception):  # the session may have ended meanwhile
            for seconds in after:
                time.sleep(seconds)
                gc.collect()
                spark.sparkContext._jvm.System.gc()

    threading.Thread(target=collect, daemon=True).start()


#: Arrow batches of texts hold about so many bytes, or one row.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark sends to Python at once by BATCH_BYTES, where the session allows more: ten thousand long texts would be held whole by the JVM and by Python, in each task.

    It holds for what the session works out from now on, and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which serves other tasks too, gives its free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    """Gives this Python process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if give_back is not None:
        give_back(0)


def likely(base: DataFrame, keys: DataFrame, *columns: str, words: int = 1 << 17) -> DataFrame:
    """The rows of base whose columns may be among the keys, by a bit map of a fixed size (64 bits a word): others need not be shuffled for a join."""
    word, bit = f"cast(pmod(xxhash64({', '.join(columns)}), {words}) as int)", f"shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}, 1), 64) as int))"
    bits = keys.select(F.expr(word).alias("word"), F.expr(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    there = F.broadcast(bits)  # as many rows as words at most
    return base.join(there, (F.expr(word) == there["word"]) & (there["bits"].bitwiseAND(F.expr(bit)) != 0), "left_semi")


def packed(df: DataFrame, *without: str) -> Column:
    """The columns of df but some, as one struct with fields c0, c1, ..., so that no name can clash on the way through a Python stage."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without], F.lit(0).alias("end"))


def unpacked(columns: list[str], *apart: str, of: list[str] | None = None, rest: str = "rest") -> list[Column]:
    """The columns again, from the struct ``rest``; those apart stand beside it. of: the packed frame's columns, if these are some of them."""
    place = {c: i for i, c in enumerate(of or columns)}
    return [F.col(c) if c in apart else F.col(f"{rest}.c{place[c]}").alias(c) for c in columns]


def chunks(batches: Iterable[pa.RecordBatch], text: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column number ``text`` has about ``max_bytes`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node that each one reaches."""
    label = np.arange(n)
    while a.size:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is one node of its component.

    Each round maps every node to the smallest of its neighbours and itself and contracts the links, so that
    no group of neighbours is ever gathered: minima are pre-aggregated and joins may be split by skew. Node ids
    should be spread like hashes; the number of rounds is then logarithmic in the largest component.
    """
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpoint(edges.where("a <> b").select("a", "b").distinct())
    steps: list[DataFrame] = []
    while rows := edges.count():
        step = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        # pointers are followed twice, which shortens chains
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = checkpoint(narrow(step.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to")), 2 * rows))
        steps.append(step)
        at = lambda side: step.select(F.col("node").alias(side), F.col("to").alias(f"{side}2"))  # noqa: B023, E731
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
        edges = checkpoint(narrow(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), rows))
    spark = edges.sparkSession
    if not steps:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    # from the last round back: the image of a node of an earlier round either moves again or is a root
    later = None
    for step in reversed(steps):
        now = step.select("node", F.col("to").alias("root"))
        if later is not None:
            after = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
            now = now.join(after, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        later = now
    return later
