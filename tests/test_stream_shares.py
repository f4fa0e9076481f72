"""Streams deal keys out into shares and store slices in several files: the same folds, with work that doesn't grow by the key."""

import datetime

from pyspark.sql import functions as F
from test_streams import states

from webloom.functions import machines
from webloom.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def test_many_keys(spark):
    """3,000 keys, some with huge numbers, and rows without a key, over three micro-batches; the store has a row a share."""
    keys = [None, 2**62 + 1, *range(3000)]
    rows = [(k, n * 10 + i, float(i * 40_000 + n % 7), (n + i) % 3 > 0) for n, k in enumerate(keys) for i in range(4)]
    df = spark.createDataFrame(rows, "key long, event_id long, t double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    found, query = stateful.collected(stateful.breaker(stateful.in_slices(df, "ts"), 2, 86_400.0), "update")
    last = found.groupBy("key").agg(F.max_by(F.struct("state", "failures", "allowed", "rejected"), "batch").alias("s")).select("key", "s.*").collect()
    fold, want = machines.breaker(2, 86_400.0), {}
    for k, _, t, ok in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        want[k] = fold.advance(want.get(k, fold.start), [t], [ok])[0]
    assert {r.key: tuple(r)[1:] for r in last} == {k: (s[0], s[1], s[3], s[4]) for k, s in want.items()}
    assert 0 < states(query)[-1] <= stateful.SHARES + 1


def test_events_keep_their_columns(spark):
    rows = [(f"h{k}", 10 * k + i, float(i * 100 * (k + 1))) for k in range(5) for i in range(6)]
    df = spark.createDataFrame(rows, "host string, event_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    found, _ = stateful.collected(stateful.cache_outcomes(stateful.in_slices(df, "ts"), 300.0), "append")
    fold = machines.cache_outcomes(300.0)
    want = {(h, e, o[0]) for k in range(5) for (h, e, _), o in zip(rows[6 * k : 6 * k + 6], fold.advance(fold.start, [r[2] for r in rows[6 * k : 6 * k + 6]])[1], strict=True)}
    assert {(r.host, r.event_id, r.outcome) for r in found.collect()} == want


def test_slices_in_several_files(spark, monkeypatch):
    """Each micro-batch is one slice, however many files that has; a small slice and rows before 1970 come whole."""
    monkeypatch.setattr(stateful, "FILE_ROWS", 1000)
    times = [datetime.datetime(1960, 1, 1)] * 5 + [START + datetime.timedelta(seconds=i) for i in range(4000)] + [START + datetime.timedelta(days=9, seconds=i) for i in range(7)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id long, ts timestamp_ntz")
    stream = stateful.in_slices(df, "ts", cuts=["2024-01-01", "2024-01-05", "2024-02-01"])
    found, _ = stateful.collected(stream, "append")
    by = found.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("lo")).orderBy("batch").collect()
    assert [(r.n, r.lo) for r in by] == [(5, 0), (4000, 5), (7, 4005)]
    assert found.count() == len(times)
