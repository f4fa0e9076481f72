"""Ordered folds over any number of events of a key, without gathering them.

Events are dealt out by ranges of (key, order) into blocks, sorted there and stored; each block is folded in one pass that carries a state of fixed size from batch
to batch. A key that goes on from an earlier block waits for that block's state: rounds hand states on, one block a round for every such key at once, so a key
that fills many blocks is folded block by block and never held by one task. Between rounds the driver holds a state of fixed size for each block that waits; the number of
blocks is a setting, not a matter of the rows.

Events without a key take no part. Events that agree in key and order are taken in any order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.machines import Fold
from webloom.session import checkpoint


def _folding(fold: Fold, keep: list[str], waiting: dict[int, object], given: dict[int, tuple], columns: list[str]):
    """A pass over sorted blocks: states (and events' rows) of every key but those that wait; given: states that were handed on to a block's waiting key."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype(object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: tuple | None = None
        ended: list[tuple] = []
        blank = [None] * (len(columns) - 3 - len(fold.start))
        for batch in batches:
            keys, blocks = batch["__key"].to_numpy(), batch["__block"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            fields = [batch[f].to_numpy() for f in fold.fields]
            places: list[int] = []
            said: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                block, key = int(blocks[lo]), keys[lo]
                if current != (block, key):
                    if state is not None:
                        ended.append(("state", current[1], current[0], *state, *blank))
                    current = (block, key)
                    waits = block in waiting and waiting[block] == key
                    state = given.get(block) if waits else fold.start
                if state is None:
                    continue  # until its state is known
                state, rows = fold.advance(state, *[f[lo:hi] for f in fields])
                if keep:
                    places += range(lo, hi)
                    said += rows
            if places:
                own = batch.iloc[places]
                nothing = [None] * len(fold.start)
                kept = zip(*[own[c] for c in keep], strict=True)
                yield frame([("event", k, b, *nothing, *o, *r) for k, b, o, r in zip(own["__key"], own["__block"], said, kept, strict=True)])
            if ended:
                yield frame(ended)
                ended = []
        if state is not None:
            yield frame([*ended, ("state", current[1], current[0], *state, *blank)])

    return run


def _replayed(df: DataFrame, key: str, order: list[str], fold: Fold, keep: list[str], blocks: int | None) -> DataFrame:
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *[F.col(o).alias(f"__order{i}") for i, o in enumerate(order)], *[F.col(c) for c in dict.fromkeys([*fold.fields, *keep])])
    ordered = [f"__order{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(blocks, "__key", *ordered).sortWithinPartitions("__key", *ordered)
    dealt = checkpoint(dealt.drop(*ordered).withColumn("__block", F.spark_partition_id()))  # keeps partitions and their order
    ends = sorted(tuple(r) for r in dealt.groupBy("__block").agg(F.min("__key"), F.max("__key")).collect())  # a row a block
    waiting = {b: low for (_, _, high), (b, low, _) in zip(ends, ends[1:], strict=False) if high == low}
    before = {b: a for (a, _, _), (b, _, _) in zip(ends, ends[1:], strict=False)}
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    ddl = [f"what string, __key {types['__key']}, __block int", *[f"s_{c}" for c in fold.state.split(", ")], *([f"out_{c}" for c in fold.out.split(", ")] if keep else []), *[f"row_{c} {types[c]}" for c in keep]]
    columns = [c.split()[0] for c in ", ".join(ddl).split(", ")]
    found = [checkpoint(dealt.mapInPandas(_folding(fold, keep, waiting, {}, columns), ", ".join(ddl)))]
    open_ = dict(waiting)
    states = found[0].where("what = 'state'").select("__block", "__key", *[f"s_{c}" for c in fold.names()])
    known: dict[int, tuple] = {}
    fresh = states.where(F.col("__block").isin([before[b] for b in open_])) if open_ else None
    while open_:
        known = {r[0]: (r[1], tuple(r[2:])) for r in fresh.collect() if any(before[b] == r[0] and k == r[1] for b, k in open_.items())}
        given = {b: known[before[b]][1] for b in open_ if before[b] in known}
        todo = dealt.where(F.col("__block").isin(list(given)))
        own = reduce(lambda a, x: a | x, [(F.col("__block") == b) & (F.col("__key") == F.lit(waiting[b])) for b in given])
        found.append(checkpoint(todo.where(own).mapInPandas(_folding(fold, keep, waiting, given, columns), ", ".join(ddl))))
        fresh = found[-1].where("what = 'state'").select("__block", "__key", *[f"s_{c}" for c in fold.names()])
        open_ = {b: k for b, k in open_.items() if b not in given}
    return reduce(DataFrame.unionAll, found)


def replay(df: DataFrame, key: str, order: list[str], fold: Fold, blocks: int | None = None) -> DataFrame:
    """key and the fold's state after all of the key's events, taken in order. blocks: into how many ranges the events are dealt; shuffle partitions if not given."""
    found = _replayed(df, key, order, fold, [], blocks)
    names = [f"s_{c}" for c in fold.names()]
    # a key in several blocks has a state in each; the last counts
    last = found.groupBy("__key").agg(F.max_by(F.struct(*names), "__block").alias("s"))
    return last.select(F.col("__key").alias(key), *[F.col(f"s.s_{c}").alias(c) for c in fold.names()])


def replay_events(df: DataFrame, key: str, order: list[str], fold: Fold, keep: list[str], blocks: int | None = None) -> DataFrame:
    """key, the columns ``keep`` and what the fold says about each event."""
    found = _replayed(df, key, order, fold, keep, blocks).where("what = 'event'")
    return found.select(F.col("__key").alias(key), *[F.col(f"row_{c}").alias(c) for c in keep], *[F.col(f"out_{c}").alias(c) for c in fold.out_names()])
