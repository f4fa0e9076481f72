"""Structured Streaming twins of the ordered folds.

State lives in the state store, per share of the keys or per key, and events of a key are taken in event order within a micro-batch, so a stream gives what the batch fold gives
when batches follow one another in time. Late data: events older than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions import machines
from webloom.functions.machines import Fold
from webloom.session import new_folder


#: Into how many shares the keys of a stream are dealt, how many events a stored file should have and how many files a slice has at most.
SHARES, FILE_ROWS, MOST_FILES = 1024, 250_000, 48


def with_time(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """events with ts as a timestamp and a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(events: DataFrame, key: str) -> DataFrame:
    """The first event of each key; state never expires."""
    return events.dropDuplicates([key])


def deduplicated_within(events: DataFrame, key: str) -> DataFrame:
    """The first event of each key within the watermark's delay; state expires with it."""
    return events.dropDuplicatesWithinWatermark([key])


def windowed_ratio(events: DataFrame, flag: F.Column, width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """window_start, n, ratio over sliding event-time windows; events carry a watermark on ts."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("ratio")).select(F.col("w.start").alias("window_start"), "n", "ratio")


def sessions(events: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """keys, session_start, session_end, n: runs of events of a key without a pause of gap; events carry a watermark on ts, and a session is complete once that passes its end."""
    rows = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def windowed_counts(events: DataFrame, keys: list[str], width: str) -> DataFrame:
    """keys, window_start, n: events of a key in windows of ts; events that come when their window has been written are dropped."""
    return events.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def folded(events: DataFrame, key: str, order: list[str], fold: Fold, keep: list[str] | None = None, shares: int = SHARES) -> DataFrame:
    """key and the fold's state after each micro-batch; with keep, instead, key, those columns and what the fold says about each event. State never expires.

    Keys are dealt out by hash into shares, and a share's keys are folded in one call, as a call costs far more than a key's fold; the store holds the states of a share's keys
    together. A task holds a share's events of one micro-batch. shares stays as it is for as long as a checkpoint is used.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"{key} {types[key]}, {fold.state}" if keep is None else ", ".join([f"{key} {types[key]}", *[f"{c} {types[c]}" for c in keep], fold.out])
    columns = [c.split()[0] for c in out.split(", ")]
    stored = ", ".join([f"keys array<{types[key]}>", *["{} array<{}>".format(*c.split()) for c in fold.state.split(", ")]])

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
        rows = rows.assign(__code=codes).sort_values(["__code", *order])
        keys = [None if pd.isna(k) else k for k in keys.tolist()]
        known: dict[object, tuple] = {}
        if state.exists:
            was = state.get
            known = dict(zip(was[0], zip(*was[1:], strict=True), strict=True))
        fields = [rows[f].tolist() for f in fold.fields]
        ends = rows["__code"].value_counts(sort=False).sort_index().cumsum().tolist()
        said: list[tuple] = []
        for k, lo, hi in zip(keys, [0, *ends], ends, strict=False):
            known[k], own = fold.advance(known.get(k, fold.start), *[f[lo:hi] for f in fields])
            said += own
        state.update((list(known), *map(list, zip(*known.values(), strict=True))))
        if keep is None:
            yield pd.DataFrame([(k, *known[k]) for k in keys], columns=columns)
        else:
            of = [keys[c] for c in rows["__code"]]
            yield pd.DataFrame([(k, *r, *s) for k, r, s in zip(of, rows[keep].itertuples(index=False), said, strict=True)], columns=columns)

    share = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))  # rows without a key apart, so that others' keys stay exact
    wanted = events.select(*dict.fromkeys([key, *order, *fold.fields, *(keep or [])]), share.alias("__share"))
    return wanted.groupBy("__share").applyInPandasWithState(run, out, stored, "update" if keep is None else "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, most: int = 5, timeout_s: float = 30.0) -> DataFrame:
    """key, state, failures, allowed, rejected after each micro-batch. events: key, event_id, t (seconds), ok."""
    return folded(events, "key", ["t", "event_id"], machines.breaker(most, timeout_s)).drop("failed_at")


def breaker_log(events: DataFrame, most: int = 5, timeout_s: float = 30.0) -> DataFrame:
    """key, state, failures, allowed, rejected after each micro-batch. events: key, event_id, step, t (seconds), op (allow or record), ok."""
    return folded(events, "key", ["t", "event_id", "step"], machines.breaker_log(most, timeout_s)).drop("failed_at")


def limiter_log(events: DataFrame, low: int, high: int) -> DataFrame:
    """key, ceiling, in_flight, acquired, waiting after each micro-batch. events: key, event_id, step, t, op (acquire, success, failure or release)."""
    return folded(events, "key", ["t", "event_id", "step"], machines.limiter_log(low, high))


def cache_outcomes(lookups: DataFrame, ttl_s: float = 300.0) -> DataFrame:
    """host, event_id, outcome of each lookup: hit, stale_revalidate or miss. lookups: host, event_id, t (seconds)."""
    return folded(lookups, "host", ["t", "event_id"], machines.cache_outcomes(ttl_s), ["event_id"])


def ewma_score(events: DataFrame) -> DataFrame:
    """key, n, good, ms, score after each micro-batch. events: key, event_id, t, ok, ms."""
    return folded(events, "key", ["t", "event_id"], machines.ewma_score())


def limiter(events: DataFrame, low: int, high: int) -> DataFrame:
    """key, ceiling after each micro-batch. events: key, event_id, t, ok."""
    return folded(events, "key", ["t", "event_id"], machines.aimd(low, high))


class _Timed(StatefulProcessor):
    """A processor with timers at the times at which parts of its state die: old ones go, new ones come, and what has died is cleared when event time gets there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _times(self, before: set[int], after: set[int]) -> None:
        for ms in before - after:
            self.handle.deleteTimer(ms)
        for ms in after - before:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class Tracker(_Timed):
    """The change tracker's two variables of a url: the last change, and the interval with the time at which it was set. Each dies ttl_s after it was set."""

    COLUMNS = "key long, last long, ema double, expired boolean"

    def __init__(self, ttl_s: float) -> None:
        self.ttl_s, self.fold = ttl_s, machines.recrawl(ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last, self.ema = handle.getValueState("last", "last long"), handle.getValueState("ema", "ema double, set_at long")

    def _state(self) -> tuple:
        return (self.last.get() if self.last.exists() else (None,)) + (self.ema.get() if self.ema.exists() else (None, None))

    def _deaths(self, state: tuple) -> set[int]:
        return {int((x + self.ttl_s) * 1000) for x in (state[0], state[2]) if x is not None}

    def _row(self, key: tuple, expired: bool) -> pd.DataFrame:
        last, ema, _ = self._state()
        return pd.DataFrame({"key": [key[0]], "last": pd.array([last], "Int64"), "ema": pd.array([ema], "Float64"), "expired": [expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, before = pd.concat(list(rows)).sort_values(["t", "event_id"]), self._state()
        after, _ = self.fold.advance(before, new["t"].to_numpy(), new["changed"].to_numpy())
        if after[0] is not None:
            self.last.update((after[0],))
        if after[1] is not None:
            self.ema.update((after[1], after[2]))
        self._times(self._deaths(before), self._deaths(after))
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, state = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._state()
        if state[0] is not None and state[0] + self.ttl_s <= now:
            self.last.clear()
        if state[2] is not None and state[2] + self.ttl_s <= now:
            self.ema.clear()
        yield self._row(key, True)


class RobotsCache(_Timed):
    """The robots entry of a domain, also of a load that failed; it dies when it may no longer serve."""

    COLUMNS = "key long, event_id long, outcome string, allowed boolean"

    def __init__(self, ttl_s: float) -> None:
        self.ttl_s, self.fold = ttl_s, machines.robots_cache(ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", self.fold.state)

    def _deaths(self, loaded: float | None) -> set[int]:
        return set() if loaded is None else {int((loaded + self.ttl_s) * 1000) + 1}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, before = pd.concat(list(rows)).sort_values(["t", "event_id"]), self.entry.get() if self.entry.exists() else self.fold.start
        after, said = self.fold.advance(before, *[new[f].to_numpy() for f in self.fold.fields])
        self.entry.update(after)
        self._times(self._deaths(before[0]), self._deaths(after[0]))
        yield pd.DataFrame([(key[0], e, *s) for e, s in zip(new["event_id"], said, strict=True)], columns=["key", "event_id", "outcome", "allowed"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entry.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="str"), "allowed": pd.Series(dtype="bool")})


def _with_state(events: DataFrame, processor: Tracker | RobotsCache, mode: str) -> DataFrame:
    """The processor over events (key, ts with a watermark, and more), its state in the store that such processors need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("key").transformWithStateInPandas(processor, processor.COLUMNS, mode, "EventTime")


def recrawl(events: DataFrame, ttl_s: float = machines.TRACKER_TTL_S) -> DataFrame:
    """key, last, ema, expired after each micro-batch, and when something of a key expires. events: key, event_id, ts (with a watermark), t (whole seconds), changed."""
    return _with_state(events, Tracker(ttl_s), "Update")


def robots_cache(lookups: DataFrame, ttl_s: float = machines.ROBOTS_TTL_S) -> DataFrame:
    """key, event_id, outcome, allowed of each lookup. lookups: key, event_id, ts (with a watermark), t (seconds), found, allow."""
    return _with_state(lookups, RobotsCache(ttl_s), "Append")


def in_slices(df: DataFrame, ts: str, slices: int = 3, files: int | None = None, cuts: list[str] | None = None) -> DataFrame:
    """A stream that reads df in micro-batches, one slice of time after the other; the slices are stored once in the shared folder. Rows without ts come first.

    Slices are about equally large, where cuts aren't given as times. files: of each slice, which its readers share; by the rows of the largest slice if not given.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "slices")
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).cast("double")
    if cuts is None:
        bounds = df.select(at.alias("at")).approxQuantile("at", [i / slices for i in range(1, slices)], 0.01)
    else:
        bounds = [float(r[0]) for r in spark.createDataFrame([(c,) for c in cuts], "at string").select(F.unix_micros(F.col("at").cast("timestamp"))).collect()]
    parts = [(at >= lo) & (at < hi) for lo, hi in zip([float("-inf"), *bounds], [*bounds, float("inf")], strict=True)]
    sizes = df.select(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).first()  # a row of counts
    files = files or min(MOST_FILES, max(1, max(sizes) // FILE_ROWS))
    for part, n in zip(parts, sizes, strict=True):  # one after the other: a stream of files takes older ones first
        own = files if n >= 1000 * files else 1  # so many rows that no file stays out
        df.where(part).repartition(own).write.mode("append").parquet(path)
        for _ in range(files - own):  # a micro-batch takes so many files
            df.limit(0).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def collected(stream: DataFrame, mode: str, keep: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, StreamingQuery]:
    """What a stream has written when it has read all that there is, with the number of the micro-batch of each row as batch; and the ended query.

    Each micro-batch goes to a folder of its own in the shared folder, so a repeated one overwrites itself, and nothing goes through the driver.
    """
    spark = stream.sparkSession
    path = new_folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, batch_id, f"{path}/rows")
        if keep is not None:
            keep(batch, batch_id)

    running = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
    running.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{path}/rows"), running


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def every(stream: DataFrame, seconds: int, tick: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls tick with each micro-batch, on a schedule; stop() ends it, and a new start goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """A foreachBatch sink: each batch has a folder of its own, so a repeated batch overwrites itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
