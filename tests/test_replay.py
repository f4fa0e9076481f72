"""Folds over blocks against the same folds in one go, with keys that fill several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import folds, machines
from webloom.operators import metrics, replay

SCHEMA = "key long, t double, n long, ok boolean, ms double, changed boolean, found boolean, allow boolean"
FOLDS = {
    "aimd": machines.aimd(2, 20), "ewma": machines.ewma_score(), "breaker": machines.breaker(2, 40.0), "cache": machines.cache_outcomes(30.0),
    "recrawl": machines.recrawl(200.0), "robots": machines.robots_cache(60.0),
}


def events(seed, n=600):
    """Half of the events are one key's."""
    dice = random.Random(seed)
    return [(dice.choice([7, 7, 7, 1, 2, 3, None]), float(dice.randrange(9000)), i, dice.random() < 0.6, float(dice.randrange(1, 900)), dice.random() < 0.5, dice.random() < 0.7, dice.random() < 0.5) for i in range(n)]


def plain(rows, fold):
    """Each key's last state and what is said of its events, one event at a time."""
    places = [c.split()[0] for c in SCHEMA.split(", ")]
    states, said = {}, []
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        state, out = fold.advance(states.get(r[0], fold.start), *[[r[places.index(f)]] for f in fold.fields])
        states[r[0]] = state
        said += [(r[0], r[2], *o) for o in out]
    return states, sorted(said)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_blocks(spark, name):
    rows, fold = events(3), FOLDS[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    states, said = plain(rows, fold)
    got = {r[0]: tuple(r[1:]) for r in replay.replay(df, "key", ["t", "n"], fold, 9).collect()}
    assert got.keys() == states.keys()
    for k in got:
        assert got[k] == pytest.approx(states[k])
    if fold.out:
        assert sorted(tuple(r) for r in replay.replay_events(df, "key", ["t", "n"], fold, ["n"], 9).collect()) == said


def test_odd_events(spark):
    fold = machines.aimd(2, 20)
    assert replay.replay(spark.createDataFrame([], SCHEMA), "key", ["t", "n"], fold, 5).collect() == []
    assert replay.replay(spark.createDataFrame([(None, 1.0, 1, True, 1.0, True, True, True)], SCHEMA), "key", ["t", "n"], fold).collect() == []
    one_key = spark.createDataFrame([(1, 1.0, i, True, 1.0, True, True, True) for i in range(50)], SCHEMA)
    assert [tuple(r) for r in replay.replay(one_key, "key", ["t", "n"], fold, 20).collect()] == [(1, 20)]
    words = one_key.withColumn("key", one_key.key.cast("string"))
    assert [tuple(r) for r in replay.replay(words, "key", ["t", "n"], fold, 20).collect()] == [("1", 20)]


def test_no_list_of_a_key(spark):
    """A key's events are in many tasks and in no array."""
    df = spark.createDataFrame(events(4), SCHEMA)
    plan = replay.replay(df, "key", ["t", "n"], machines.aimd(2, 20), 9)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_tracker_forgets():
    """Both keys expire, either on its own."""
    fold = machines.recrawl(100.0)
    run = lambda *events: fold.advance(fold.start, *zip(*events, strict=True))[0]
    assert run((0, False)) == (None, None, None)  # nothing to set back
    assert run((0, True)) == (0, 86400.0, 0)
    assert run((0, True), (50, False)) == (0, 103680.0, 50)
    assert run((0, True), (50, False), (149, False)) == (0, 124416.0, 149)
    assert run((0, True), (50, False), (150, False)) == (0, 103680.0, 50)  # the interval is forgotten: no change does nothing
    assert run((0, True), (50, False), (120, True)) == (120, 86400.0, 120)  # the last change is forgotten, the interval isn't: a first change
    assert run((0, True), (99, True)) == (99, 60510.0, 99)
    assert fold.advance((0, None, None), [99], [True])[0] == (99, 300.0, 99)  # without an interval the time since the last change counts


def test_logs_in_many_blocks(spark):
    """Requests and results of a key that fills several blocks, as the column folds over its whole history give them."""
    dice = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i * 0.7, dice.choice(["allow", "record"]), dice.random() < 0.4, dice.choice(["acquire", "release", "success", "failure"])) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, i int, t double, op string, ok boolean, slot string").repartition(5)
    got = replay.replay(df, "key", ["t", "i"], machines.breaker_log(2, 5.0), blocks=6).drop("failed_at")
    want = metrics.replay(df, "key", ["t", "i"], ["t", "op", "ok"], folds.breaker_log(F.col("events"), 2, 5.0)).select("key", "result.state", "result.failures", "result.allowed", "result.rejected")
    assert sorted(got.collect()) == sorted(want.collect())
    slots = df.select("key", "i", F.col("slot").alias("op"))
    got = replay.replay(slots, "key", ["i"], machines.limiter_log(2, 6), blocks=6)
    want = metrics.replay(slots, "key", ["i"], ["op"], folds.limiter_log(F.col("events"), 2, 6)).select("key", "result.*")
    assert sorted(got.collect()) == sorted(want.collect())
