"""Ordered folds as small state machines: one definition for batch replays (operators.replay) and streams (streaming.stateful).

A fold takes a key's events in order, as lists of fields, and carries a state of fixed size; some also say something about each event. Nothing of a
key's events is kept, so a key may have any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from webloom.functions.folds import ALPHA, FIRST_INTERVAL, MAX_INTERVAL, MIN_INTERVAL

#: What the tracker keeps of a url lives so long after it was last set.
TRACKER_TTL_S, ROBOTS_TTL_S = 2_592_000.0, 86_400.0


class Fold(NamedTuple):
    """fields of an event; state (as DDL) and its start; advance(state, *lists of fields) gives the state and, if out (as DDL) isn't empty, a row for each event."""

    fields: tuple[str, ...]
    state: str
    start: tuple
    advance: Callable[..., tuple[tuple, list[tuple]]]
    out: str = ""

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.state.split(", ")]

    def out_names(self) -> list[str]:
        return [c.split()[0] for c in self.out.split(", ")] if self.out else []


def aimd(low: int, high: int) -> Fold:
    """The ceiling: one more on success, half of it on failure, within low and high, from low on."""

    def advance(state: tuple, ok: Sequence) -> tuple:
        (ceiling,) = state
        for good in ok:
            ceiling = min(ceiling + 1, high) if good else max(ceiling // 2, low)
        return (int(ceiling),), []

    return Fold(("ok",), "ceiling long", (low,), advance)


def ewma_score() -> Fold:
    """score: 0.3 x (success rate x 1000 / mean latency) + 0.7 x previous, from 1; the rate and the mean run over the events so far."""

    def advance(state: tuple, ok: Sequence, ms: Sequence) -> tuple:
        n, good, total, score = state
        for fine, took in zip(ok, ms, strict=True):
            n, good, total = n + 1.0, good + (1.0 if fine else 0.0), total + took
            score = ALPHA * ((good / n) * (1000.0 / (total / n)) if total > 0 else 0.0) + (1 - ALPHA) * score
        return (n, good, float(total), float(score)), []

    return Fold(("ok", "ms"), "n double, good double, ms double, score double", (0.0, 0.0, 0.0, 1.0), advance)


def breaker(most: int = 5, timeout_s: float = 30.0) -> Fold:
    """Circuit breaker with a request an event: state (0 closed, 1 open, 2 half-open), failures, allowed and rejected requests."""

    def advance(state: tuple, t: Sequence, ok: Sequence) -> tuple:
        now, failures, failed_at, allowed, rejected = state
        for at, good in zip(t, ok, strict=True):
            if now != 0 and at - failed_at < timeout_s:
                rejected += 1
                continue
            allowed += 1
            if good:
                now, failures = 0, 0
            else:
                failures, failed_at = failures + 1, float(at)
                now = 1 if failures >= most else (2 if now == 1 else now)
        return (now, failures, failed_at, allowed, rejected), []

    return Fold(("t", "ok"), "state long, failures long, failed_at double, allowed long, rejected long", (0, 0, 0.0, 0, 0), advance)


def breaker_log(most: int = 5, timeout_s: float = 30.0) -> Fold:
    """Circuit breaker whose requests and results are events of their own: t (seconds), op (allow or record) and ok (of a record).

    An open breaker lets one probe through after the timeout and is half-open then: until a result is recorded, all others are rejected.
    """

    def advance(state: tuple, t: Sequence, op: Sequence, ok: Sequence) -> tuple:
        now, failures, failed_at, allowed, rejected = state
        for at, what, good in zip(t, op, ok, strict=True):
            if what == "allow":
                probe = now == 1 and at - failed_at >= timeout_s
                if probe:
                    now = 2
                allowed, rejected = (allowed + 1, rejected) if probe or now == 0 else (allowed, rejected + 1)
            elif good:
                now, failures = 0, 0
            else:
                failures, failed_at = failures + 1, float(at)
                now = 1 if failures >= most else now
        return (now, failures, failed_at, allowed, rejected), []

    return Fold(("t", "op", "ok"), "state long, failures long, failed_at double, allowed long, rejected long", (0, 0, 0.0, 0, 0), advance)


def limiter_log(low: int, high: int) -> Fold:
    """Adaptive limiter over events with op acquire, release, success or failure: an acquire beyond the ceiling waits for the next slot that a release or a raised ceiling leaves."""

    def advance(state: tuple, op: Sequence) -> tuple:
        ceiling, in_flight, acquired, waiting = state
        for what in op:
            if what == "success":
                ceiling = min(ceiling + 1, high)
            elif what == "failure":
                ceiling = max(ceiling // 2, low)
            in_flight -= what == "release"
            waiting += what == "acquire"
            taken = max(0, min(waiting, ceiling - in_flight))
            in_flight, acquired, waiting = in_flight + taken, acquired + taken, waiting - taken
        return (int(ceiling), int(in_flight), int(acquired), int(waiting)), []

    return Fold(("op",), "ceiling long, in_flight long, acquired long, waiting long", (low, 0, 0, 0), advance)


def cache_outcomes(ttl_s: float = 300.0) -> Fold:
    """A cache that renews an entry once 80 % of its time have passed: counts of hits, stale hits and misses, and the outcome of each lookup."""

    def advance(state: tuple, t: Sequence) -> tuple:
        loaded, hits, stales, misses = state
        out = []
        for at in t:
            age = None if loaded is None else at - loaded
            if age is None or age >= ttl_s:
                loaded, misses, outcome = float(at), misses + 1, "miss"
            elif age > 0.8 * ttl_s:
                loaded, stales, outcome = float(at), stales + 1, "stale_revalidate"
            else:
                hits, outcome = hits + 1, "hit"
            out.append((outcome,))
        return (loaded, hits, stales, misses), out

    return Fold(("t",), "loaded double, hit long, stale_revalidate long, miss long", (None, 0, 0, 0), advance, "outcome string")


def recrawl(ttl_s: float = TRACKER_TTL_S) -> Fold:
    """When a url changed last and its re-crawl interval, in whole seconds; either is forgotten ttl_s after it was set.

    A change without a live last change is a first one: the interval is a day. Else it takes 0.3 of the time since the last change, within five minutes and
    thirty days, and 0.7 of the interval (of that same time, if the interval isn't alive). No change adds a fifth to a live interval and sets it anew, and does nothing without one.
    """

    def advance(state: tuple, t: Sequence, changed: Sequence) -> tuple:
        last, ema, set_at = state
        for at, new in zip(t, changed, strict=True):
            live = ema is not None and at - set_at < ttl_s
            if new:
                if last is None or at - last >= ttl_s:
                    ema = FIRST_INTERVAL
                else:
                    seen = float(at - last)
                    ema = float(round(min(max(ALPHA * seen + (1 - ALPHA) * (ema if live else seen), MIN_INTERVAL), MAX_INTERVAL)))
                last = set_at = int(at)
            elif live:
                ema, set_at = float(round(min(ema * 1.2, MAX_INTERVAL))), int(at)
        return (last, ema, set_at), []

    return Fold(("t", "changed"), "last long, ema double, set_at long", (None, None, None), advance)


def robots_cache(ttl_s: float = ROBOTS_TTL_S) -> Fold:
    """A cache of robots files that also keeps failures: what a lookup finds when it loads a domain's file holds for ttl_s, a failed load as one that allows all.

    Of each lookup: t, found (a load at that time would succeed), allow (by the file as it is then). The entry keeps its load's found and allow. Outcome of a lookup: hit or miss, and allowed.
    """

    def advance(state: tuple, t: Sequence, found: Sequence, allow: Sequence) -> tuple:
        loaded, allowed = state
        out = []
        for at, there, fine in zip(t, found, allow, strict=True):
            miss = loaded is None or at - loaded > ttl_s
            if miss:
                loaded, allowed = float(at), bool(fine) if there else True
            out.append(("miss" if miss else "hit", allowed))
        return (loaded, allowed), out

    return Fold(("t", "found", "allow"), "loaded double, allowed boolean", (None, None), advance, "outcome string, allowed boolean")
