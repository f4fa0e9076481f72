"""Ordered folds over the events of a key, as column expressions on a sorted array of structs.

The array of a key holds its events only as the fields that a fold needs: for short histories. Keys of any size are folded by operators.replay and webloom.streaming,
with the machines of functions.machines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.3
MIN_INTERVAL, FIRST_INTERVAL, MAX_INTERVAL = 300.0, 86_400.0, 2_592_000.0


def history(order: list[str], fields: list[str]) -> Column:
    """The aggregate that gathers a key's events in order."""
    return F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))


def aimd(events: Column, low: int, high: int) -> Column:
    """The ceiling after additive increase on success and halving on failure, from low on."""
    step = lambda c, e: F.when(e["ok"], F.least(c + F.lit(1).cast("long"), F.lit(high).cast("long"))).otherwise(F.greatest(F.expr("1L") * F.floor(c / 2).cast("long"), F.lit(low).cast("long")))
    return F.aggregate(events, F.lit(low).cast("long"), step)


def ewma_score(events: Column) -> Column:
    """0.3 x (success rate x 1000 / mean latency) + 0.7 x previous, from 1; the rate and the mean run over the events so far."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("good"), F.lit(0.0).alias("ms"), F.lit(1.0).alias("score"))

    def step(a: Column, e: Column) -> Column:
        n, good, ms = a["n"] + 1.0, a["good"] + F.when(e["ok"], 1.0).otherwise(0.0), a["ms"] + e["ms"]
        seen = F.when(ms > 0, (good / n) * (F.lit(1000.0) / (ms / n))).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), good.alias("good"), ms.alias("ms"), (F.lit(ALPHA) * seen + F.lit(1 - ALPHA) * a["score"]).alias("score"))

    return F.aggregate(events, zero, step, lambda a: a["score"])


def breaker(events: Column, most: int, timeout_s: float) -> Column:
    """Circuit breaker: (state, failures, allowed, rejected) after a request per event; fields t (seconds) and ok.

    States: 0 closed, 1 open, 2 half-open. Requests are taken one after the other, so a probe's result comes before the next request.
    """
    number = lambda x: F.lit(x).cast("long")
    zero = F.struct(number(0).alias("state"), number(0).alias("failures"), F.lit(0.0).alias("failed_at"), number(0).alias("allowed"), number(0).alias("rejected"))

    def step(a: Column, e: Column) -> Column:
        allowed = (a["state"] == 0) | (e["t"] - a["failed_at"] >= timeout_s)
        failed = allowed & ~e["ok"]
        failures = F.when(~allowed, a["failures"]).when(e["ok"], number(0)).otherwise(a["failures"] + 1)
        state = F.when(~allowed, a["state"]).when(e["ok"], number(0)).when(failures >= most, number(1)).otherwise(F.when(a["state"] == 1, number(2)).otherwise(a["state"]))
        return F.struct(
            state.alias("state"), failures.alias("failures"), F.when(failed, e["t"]).otherwise(a["failed_at"]).alias("failed_at"),
            (a["allowed"] + allowed.cast("long")).alias("allowed"), (a["rejected"] + (~allowed).cast("long")).alias("rejected"),
        )

    return F.aggregate(events, zero, step)


def breaker_log(events: Column, most: int, timeout_s: float) -> Column:
    """Circuit breaker whose requests and results are events of their own: fields t (seconds), op (allow or record) and ok (of a record).

    (state, failures, allowed, rejected). An open breaker lets one probe through after the timeout; until its result is recorded all others are rejected.
    """
    number = lambda x: F.lit(x).cast("long")
    zero = F.struct(number(0).alias("state"), number(0).alias("failures"), F.lit(0.0).alias("failed_at"), number(0).alias("allowed"), number(0).alias("rejected"))

    def step(a: Column, e: Column) -> Column:
        asks = e["op"] == "allow"
        probe = asks & (a["state"] == 1) & (e["t"] - a["failed_at"] >= timeout_s)
        passed, good, bad = asks & ((a["state"] == 0) | probe), ~asks & e["ok"], ~asks & ~e["ok"]
        failures = F.when(good, number(0)).when(bad, a["failures"] + 1).otherwise(a["failures"])
        state = F.when(probe, number(2)).when(good, number(0)).when(bad & (failures >= most), number(1)).otherwise(a["state"])
        return F.struct(
            state.alias("state"), failures.alias("failures"), F.when(bad, e["t"]).otherwise(a["failed_at"]).alias("failed_at"),
            (a["allowed"] + passed.cast("long")).alias("allowed"), (a["rejected"] + (asks & ~passed).cast("long")).alias("rejected"),
        )

    return F.aggregate(events, zero, step)


def limiter_log(events: Column, low: int, high: int) -> Column:
    """Adaptive limiter: (ceiling, in_flight, acquired, waiting) after events with a field op: acquire, release, success or failure.

    An acquire beyond the ceiling waits; it takes the next slot that a release or a raised ceiling leaves.
    """
    number = lambda x: F.lit(x).cast("long")
    zero = F.struct(number(low).alias("ceiling"), number(0).alias("in_flight"), number(0).alias("acquired"), number(0).alias("waiting"))

    def step(a: Column, e: Column) -> Column:
        op = e["op"]
        ceiling = F.when(op == "success", F.least(a["ceiling"] + 1, number(high))).when(op == "failure", F.greatest(F.floor(a["ceiling"] / 2).cast("long"), number(low))).otherwise(a["ceiling"])
        busy = a["in_flight"] - (op == "release").cast("long")
        want = a["waiting"] + (op == "acquire").cast("long")
        taken = F.greatest(F.least(want, ceiling - busy), number(0))
        return F.struct(ceiling.alias("ceiling"), (busy + taken).alias("in_flight"), (a["acquired"] + taken).alias("acquired"), (want - taken).alias("waiting"))

    return F.aggregate(events, zero, step)


def recrawl(events: Column, ttl_s: float = MAX_INTERVAL) -> Column:
    """(last, ema): last change and re-crawl interval, in seconds, after events (t, changed), as machines.recrawl has them: either is forgotten ttl_s after it was set."""
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(None).cast("double").alias("ema"), F.lit(None).cast("long").alias("set_at"))

    def step(a: Column, e: Column) -> Column:
        live = F.coalesce(e["t"] - a["set_at"] < ttl_s, F.lit(False))
        first = F.coalesce(e["t"] - a["last"] >= ttl_s, F.lit(True))
        seen = (e["t"] - a["last"]).cast("double")
        mean = F.lit(ALPHA) * seen + F.lit(1 - ALPHA) * F.when(live, a["ema"]).otherwise(seen)
        changed = F.when(first, F.lit(FIRST_INTERVAL)).otherwise(F.bround(F.least(F.greatest(mean, F.lit(MIN_INTERVAL)), F.lit(MAX_INTERVAL)), 0))
        same = F.when(live, F.bround(F.least(a["ema"] * 1.2, F.lit(MAX_INTERVAL)), 0)).otherwise(a["ema"])
        return F.struct(
            F.when(e["changed"], e["t"]).otherwise(a["last"]).alias("last"), F.when(e["changed"], changed).otherwise(same).alias("ema"),
            F.when(e["changed"] | live, e["t"]).otherwise(a["set_at"]).alias("set_at"),
        )

    return F.aggregate(events, zero, step, lambda a: F.struct(a["last"].alias("last"), a["ema"].alias("ema")))
