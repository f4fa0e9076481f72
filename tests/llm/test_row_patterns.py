"""A D+ U+ P against a backtracking matcher, with runs that cross blocks, and odd rows."""

import datetime
import hashlib
import math
import random

import pytest

from webloom.llm import row_patterns

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, client string"
START = datetime.datetime(2024, 1, 1)


def plain(rows):
    """(client, match_no, first_id, last_id, n_rows, sum_cents, labels_sha256), letter by letter with backtracking."""
    out = []
    distinct = {r for r in rows if r[1] is not None and r[2] is not None}
    for client in {r[2] for r in distinct}:
        own = sorted((r for r in distinct if r[2] == client), key=lambda r: (r[1], r[0]))
        cents = [math.floor(100 * r[4] + 0.5) if r[4] is not None and abs(r[4]) < 9e13 else None for r in own]

        def fits(letter, i, start):
            if i >= len(own) or cents[i] is None:
                return False
            if letter == "A":
                return True
            if own[i][1] - own[i - 1][1] > datetime.timedelta(minutes=5):
                return False
            if letter == "P":
                return own[i][3] == "click" and cents[i] >= cents[start]
            if own[i][3] in (None, "error") or cents[i - 1] is None:
                return False
            return cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1]

        number = 0
        for i in range(len(own)):
            if not fits("A", i, i):
                continue
            d = 0
            while fits("D", i + d + 1, i):
                d += 1
            found = None
            for n_d in range(d, 0, -1):
                u = 0
                while fits("U", i + n_d + u + 1, i):
                    u += 1
                found = next(((n_d, n_u) for n_u in range(u, 0, -1) if fits("P", i + n_d + n_u + 1, i)), None)
                if found:
                    break
            if found:
                number += 1
                end = i + sum(found) + 1
                labels = hashlib.sha256(f"A{'D' * found[0]}{'U' * found[1]}P".encode()).hexdigest()
                out.append((client, number, own[i][0], own[end][0], end - i + 1, sum(cents[i : end + 1]), labels))
    return sorted(out)


def got(spark, rows, blocks):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in row_patterns.digests(row_patterns.matches(df, blocks)).collect())


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 1), (2, 7), (3, 40), (4, 13)])
def test_random(spark, seed, blocks):
    dice = random.Random(seed)
    rows = []
    for i in range(400):
        client = dice.choice([1, 1, 1, 2, 3, None])
        value = dice.choice([None, float("nan"), float("inf")]) if dice.random() < 0.04 else dice.choice([1.0, 2.0, 2.005, 3.5, -4.0, 5.25])
        rows.append((i, at(i * 40 + dice.choice([0, 0, 0, 299])) if dice.random() > 0.02 else None, client, dice.choice(["click", "click", "view", "error", None]), value, "x"))
    rows += dice.sample(rows, 40)
    assert got(spark, rows, blocks) == plain(rows)


@pytest.mark.parametrize("blocks", [2, 5, 17, 60])
def test_runs_across_blocks(spark, blocks):
    """Runs of 40 rows that fill whole blocks, with the goal in any place, and one client alone."""
    rows, i = [], 0
    for goal in (0, 1, 2, 20, 39, None):
        for k in range(40):
            rows.append((i, at(i), 7, "view", 100.0 - k, ""))
            i += 1
        for k in range(40):
            rows.append((i, at(i), 7, "click" if k == goal else "view", 61.5 + k, ""))
            i += 1
        rows.append((i, at(i + (400 if goal == 2 else 0)), 7, "click" if goal in (2, 20) else "view", 70.0, ""))
        i += 1
    assert got(spark, rows, blocks) == plain(rows)


def test_every_row_a_block(spark):
    rows = [(i, at(i), 1, "click", v, "") for i, v in enumerate([5.0, 4.0, 3.0, 4.0, 5.0, 6.0, 2.0, 7.0])]
    assert got(spark, rows, 30) == plain(rows) != []


def test_odd_rows(spark):
    """Ties of time, ids that are null or repeat, copies, gaps of just five minutes, and an empty table."""
    rows = [(None, at(0), 1, "view", 5.0, "a"), (2, at(300), 1, "view", 4.0, "a"), (3, at(600), 1, "view", 4.5, "a"), (4, at(900), 1, "click", 5.0, "a"), (4, at(900), 1, "click", 5.0, "a")]
    rows += [(10, at(0), 2, "view", 5.0, ""), (11, at(0), 2, "view", 4.0, ""), (12, at(0), 2, "view", 4.5, ""), (13, at(300.000001), 2, "click", 9.0, "")]
    found = got(spark, rows, 4)
    assert found == [(1, 1, None, 4, 4, 1850, hashlib.sha256(b"ADUP").hexdigest())]
    assert got(spark, [], 4) == []
    assert got(spark, [(1, None, None, None, None, None)], 4) == []


def test_no_client_is_gathered(spark):
    """One client's rows are spread over the blocks."""
    rows = [(i, at(i), 7, "view", float(i % 5), "") for i in range(4000)]
    dealt = row_patterns.events(spark.createDataFrame(rows, SCHEMA)).repartitionByRange(20, "client", "ts", "id")
    assert max(dealt.rdd.glom().map(len).collect()) < 1000
