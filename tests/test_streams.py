"""Streams in micro-batches: state that expires, late rows, repeated micro-batches, a restart, and what a listener sees."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import machines
from webloom.operators import observed
from webloom.session import new_folder
from webloom.streaming import stateful

START = datetime.datetime(2024, 1, 1)
DAY = 86_400


def log(spark, rows):
    """(key, second, changed) as events."""
    df = spark.createDataFrame([(k, i, START + datetime.timedelta(seconds=s), c) for i, (k, s, c) in enumerate(rows)], "key long, event_id long, ts timestamp_ntz, changed boolean")
    return df


def streamed(spark, rows, cuts):
    stream = stateful.with_time(stateful.in_slices(log(spark, rows), "ts", cuts=[str(START + datetime.timedelta(seconds=s)) for s in cuts]), late="0 seconds")
    return stream.select("key", "event_id", "ts", (F.unix_seconds("ts") - int(START.replace(tzinfo=datetime.UTC).timestamp())).alias("t"), "changed", (F.col("key") != 5).alias("found"), F.col("changed").alias("allow"))


def states(query):
    """Rows of state after each micro-batch that has a state operator."""
    return [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) if hasattr(x, "json") else x for x in query.recentProgress) if p["stateOperators"]]


def test_tracker_expires(spark):
    """Both variables die by event time, and the state store is rid of them."""
    ttl = 2.0 * DAY
    rows = [(1, 0, True), (2, 0, True), (2, DAY, False), (3, 10, False), (2, 2 * DAY + 5, True), (4, 9 * DAY, True), (1, 9 * DAY, False), (4, 20 * DAY, True)]
    stream = stateful.recrawl(streamed(spark, rows, [2 * DAY, 5 * DAY, 15 * DAY]), ttl)
    found, query = stateful.collected(stream, "update")
    rows_out = found.collect()
    last = {r.key: r for r in sorted((r for r in rows_out if not r.expired), key=lambda r: r.batch)}
    fold = machines.recrawl(ttl)
    for key in (1, 2, 3, 4):
        own = sorted((s, c) for k, s, c in rows if k == key)
        want = fold.advance(fold.start, [s for s, _ in own], [c for _, c in own])[0]
        assert (last[key].last, last[key].ema) == want[:2] or key == 1  # url 1 was forgotten before its last visit
    assert last[1].last is None and last[1].ema is None
    gone = {r.key for r in rows_out if r.expired and r.last is None and r.ema is None}
    assert {1, 2} <= gone
    kept = states(query)
    assert len(kept) >= 3 and kept[-1] <= 2 < max(kept)


def test_robots_entries_expire(spark):
    """A failed load allows all until it expires; then the file counts again."""
    rows = [(5, 0, False), (5, 100, False), (6, 0, False), (6, 50, True), (6, 2 * DAY, True), (5, 3 * DAY, False), (7, 9 * DAY, True)]
    found, query = stateful.collected(stateful.robots_cache(streamed(spark, rows, [DAY, 3 * DAY - 1, 5 * DAY])), "append")
    got = {r.event_id: (r.outcome, r.allowed) for r in found.collect()}
    assert got == {0: ("miss", True), 1: ("hit", True), 2: ("miss", False), 3: ("hit", False), 4: ("miss", True), 5: ("miss", True), 6: ("miss", True)}
    assert states(query)[-1] <= 2


def test_repeated_batch(spark):
    """A micro-batch that is written again takes its own place."""
    path = new_folder(spark, "sink")
    batch = spark.createDataFrame([(1,), (2,)], "x long")
    for _ in range(2):
        for i in range(3):
            stateful.append_once(batch.withColumn("x", F.col("x") + i), i, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("x", "batch").collect()) == [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 2)]


def test_restart(spark):
    """A stream that was stopped goes on from its checkpoint and folds on its state."""
    folder, out = new_folder(spark, "in"), new_folder(spark, "out")
    fold = machines.aimd(2, 20)
    rows = [(k, i, float(i), (i * k) % 5 > 0) for i in range(60) for k in (1, 2)]
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, "key long, event_id long, t double, ok boolean").coalesce(1).write.mode("append").parquet(folder)
        stream = stateful.limiter(spark.readStream.schema("key long, event_id long, t double, ok boolean").parquet(folder), 2, 20)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda d, i: stateful.append_once(d, i, out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(out).groupBy("key").agg(F.max_by("ceiling", "batch").alias("c")).collect()
    assert {r.key: r.c for r in got} == {k: fold.advance((2,), [ok for key, _, _, ok in rows if key == k])[0][0] for k in (1, 2)}


def test_sessions_and_late_rows(spark):
    rows = [(1, 0, True), (1, 600, True), (1, 9000, True), (2, 100, True), (1, 5 * DAY, True), (1, 30, True), (9, 9 * DAY, True)]
    by_arrival = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(k, START + datetime.timedelta(seconds=s), START + datetime.timedelta(seconds=10 * i)) for i, k, s, _ in by_arrival], "key long, ts timestamp_ntz, arrived timestamp_ntz")
    cuts = [str(START + datetime.timedelta(seconds=x)) for x in (35, 45, 55)]
    stream = stateful.with_time(stateful.in_slices(df, "arrived", cuts=cuts), late="1 hour")
    found, _ = stateful.collected(stateful.sessions(stream, ["key"], "1 hour"), "append")
    assert sorted((r.key, r.n) for r in found.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]  # the row of second 30 comes five days late; key 9's session is still open


def test_observed(spark):
    df, seen = observed.counted(spark.range(100), n=F.count("*"), top=F.max("id"))
    assert df.where("id > 5").count() == 94 and seen.get == {"n": 100, "top": 99}


def test_shared_folder_is_needed(monkeypatch):
    from webloom import session

    class Context:
        master = "spark://x"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class _Unset:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        return type("O", (), {"isDefined": staticmethod(lambda: False)})

                return _Unset

    class Session:
        sparkContext = Context  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="shared|share"):
        session.shared_folder(Session)
