"""Row pattern matching: A D+ U+ P over each client's rows, by runs of D and U rows.

A row is a D row (cents below the row before) or a U row (above) whatever the match is, and never both. So rows are run-length encoded into tokens of
D or U rows, and the pattern is matched over tokens: a D token, the U token right behind it, and the row behind that. A token's goal is its last row of
kind click from the second one on; cents grow within a U token, so it is also the token's highest. A greedy U+ that backtracks therefore places P on the row
behind the token if that row fits, else on the goal if its cents reach A's, else nowhere: two lookups for each start, and each D row stands for one start,
the row before it.

Rows are dealt out by ranges of (client, time, id), so that one client may fill many blocks; each block is matched on its own. What is open at a block's end
(starts in its last token) goes on in the next: a block hands on a summary of fixed size of how it begins, and these are folded per client from the end. A
client's fold takes one summary a block, and the number of blocks is a setting (``blocks``), not a matter of the rows. No client's rows are ever gathered.

Rows without client or time take no part; repeated rows (equal in all columns) count once. A null value fits no letter, nor do NaN and values of 9e13 or more
in size. A null kind is neither D, U nor P. Rows that share client, time and id but differ elsewhere are ordered by a hash of the row. Null ids stay null in the
result and sort first. A match of any length is one row of counts; an empty table gives no rows. Further columns only tell rows apart, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, lean

GAP_US = 300_000_000
LARGEST = 9e13
#: Labels of rows.
OTHER, D, U = 0, 1, 2
CLICK = 2
#: A match or an open start, as far as its block knows it. d and dsum: D rows; u and usum: U rows so far; g*: the goal so far, as (number of its U row, cents, id, sum up to it).
NUMBERS = ["client", "block", "pos", "first_id", "cents", "last_id", "n_rows", "sum_cents", "d", "u", "dsum", "usum", "gk", "gc", "gid", "gsum"]
BLOCKS = "what string, " + ", ".join(f"{c} long" for c in NUMBERS) + ", head string"
REST = ["client", "block", "d2", "dsum2", "u2", "usum2", "gk2", "gc2", "gid2", "gsum2", "xid", "xc"]
ENDS = "what string, " + ", ".join(f"{c} long" for c in REST)


def _cents(value: Column) -> Column:
    return F.when(F.abs(value) < LARGEST, F.floor(value * 100 + 0.5).cast("long"))


def events(clicks: DataFrame) -> DataFrame:
    """client, ts, id, kind (0: null or error, 1: other, 2: click), cents, h1, h2 of the distinct rows."""
    others = [F.col(f"`{c}`") for c in clicks.columns if c not in ("client_id", "ts", "click_id")]
    parts = [x for c in others for x in (c, c.isNull())]
    kind = F.when(F.col("kind") == "click", CLICK).when(F.col("kind") != "error", 1).otherwise(0).cast("byte")
    there = clicks.where("client_id is not null and ts is not null")
    rows = there.select(
        F.col("client_id").cast("long").alias("client"), "ts", F.col("click_id").cast("long").alias("id"), kind.alias("kind"), _cents(F.col("value").cast("double")).alias("cents"),
        F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"),
    )
    return rows.distinct()  # combined in each task first, so that a row repeated without end doesn't meet in one


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.int64()).fill_null(0).to_numpy()


class _Rows:
    """The sorted rows of a block with their labels and run-length tokens."""

    def __init__(self, table: pa.Table) -> None:
        self.client, self.t, self.id, self.kind, self.cents = (_numbers(table, c) for c in ("client", "ts", "id", "kind", "cents"))
        self.no_id = table.column("id").is_null().to_numpy()
        self.ok = table.column("cents").is_valid().to_numpy()
        n = self.n = len(self.t)
        self.same, self.near = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        self.same[1:n] = self.client[1:] == self.client[:-1]
        self.near[1:n] = self.same[1:n] & (self.t[1:] - self.t[:-1] <= GAP_US)
        fits = self.near[1:n] & self.ok[1:] & self.ok[:-1] & (self.kind[1:] > 0)
        self.label = np.zeros(n, np.int8)
        self.label[1:][fits & (self.cents[1:] < self.cents[:-1])] = D
        self.label[1:][fits & (self.cents[1:] > self.cents[:-1])] = U
        cuts = np.flatnonzero(self.label[1:] != self.label[:-1]) + 1
        self.starts, self.ends = np.r_[0, cuts], np.r_[cuts, n]
        self.sums = np.r_[0, np.cumsum(self.cents)]
        self.click = self.ok & (self.kind == CLICK)
        self.last_click = np.maximum.accumulate(np.where(self.click, np.arange(n), -1))
        self.goal_row = np.r_[self.click & self.near[:n], False]  # may be P behind a U row

    def total(self, lo: np.ndarray | int, hi: np.ndarray | int) -> np.ndarray | int:
        return self.sums[hi] - self.sums[lo]

    def run(self, i: int, label: int, stop: int) -> int:
        """The end of the run of label from row i on."""
        other = np.flatnonzero(self.label[i:stop] != label)
        return i + int(other[0]) if len(other) else stop

    def ident(self, i: int) -> int | None:
        return None if self.no_id[i] else int(self.id[i])

    def u_part(self, lo: int, first: int, stop: int) -> dict:
        """U rows first..(but from lo on, whatever row lo's own label is): count, sum, goal (its number from 1, cents, id, sum), and the row behind: open, or [id, cents] or None."""
        end = self.run(first, U, stop)
        at = int(self.last_click[end - 1]) if end > lo else -1
        goal = [at - lo + 1, int(self.cents[at]), self.ident(at), int(self.total(lo, at + 1))] if at >= lo else None
        behind = "open" if end == stop else [self.ident(end), int(self.cents[end])] if self.goal_row[end] else None
        return {"n": end - lo, "sum": int(self.total(lo, end)), "goal": goal, "behind": behind}


def _head(r: _Rows, stop: int) -> dict:
    """How a block's first client begins (rows 0..stop), if its first row should go on a D run, a U run or none."""
    d_end = r.run(1, D, stop)
    as_d = {"n": d_end, "sum": int(r.total(0, d_end)), "open": d_end == stop, "u": r.u_part(d_end, d_end, stop) if d_end < stop and r.label[d_end] == U else None}
    return {"t": int(r.t[0]), "id": r.ident(0), "kind": int(r.kind[0]), "cents": int(r.cents[0]), "ok": bool(r.ok[0]), "as_d": as_d, "as_u": r.u_part(0, 1, stop), "first": True}


def _columns(n: int, **given: object) -> dict:
    return {c: given.get(c, np.zeros(n, np.int64)) for c in NUMBERS}


def _batch(what: str, columns: dict, head: str | None = None) -> pa.RecordBatch:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in columns.values()]
    n = len(arrays[0])
    return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.string()), *arrays, pa.array([head] * n, pa.string())], names=["what", *columns, "head"])


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a block; its starts that are still open (A, D or U: what their last row is); and how its first and last client's rows begin and end."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    block = TaskContext.get().partitionId()
    r = _Rows(pa.Table.from_batches(held).combine_chunks())
    n = r.n
    ids = lambda rows: pa.array(r.id[rows], pa.int64(), mask=r.no_id[rows])
    token = np.searchsorted(r.starts, np.arange(n), "right") - 1
    rows = np.flatnonzero(r.label == D)  # a D row each start: the row before it
    d_end = r.ends[token[rows]]
    is_last = d_end == n
    followed = ~is_last
    followed[~is_last] = r.label[d_end[~is_last]] == U
    u_end = np.where(followed, r.ends[token[np.minimum(d_end, n - 1)]], 0)
    open_u = followed & (u_end == n)
    # closed tokens: P is the row behind the U token, or its goal
    s, lo, hi = rows[followed & ~open_u], d_end[followed & ~open_u], u_end[followed & ~open_u]
    a = r.cents[s - 1]
    behind = r.goal_row[hi] & (r.cents[np.minimum(hi, n - 1)] >= a)
    goal = r.last_click[hi - 1]
    p = np.where(behind, hi, np.where((goal > lo) & (r.cents[goal] >= a), goal, -1))
    s, lo, p = s[p >= 0], lo[p >= 0], p[p >= 0]
    if len(s):
        yield _batch("match", _columns(len(s), client=r.client[s], block=np.full(len(s), block), pos=s - 1, first_id=ids(s - 1), last_id=ids(p), n_rows=p - s + 2, sum_cents=r.total(s - 1, p + 1), d=lo - s, u=p - lo))
    for what, which in (("D", is_last), ("U", open_u)):
        s = rows[which]
        if len(s):
            lo = d_end[which]
            goal = np.full(len(s), r.last_click[n - 1] if what == "U" else -1)
            there = goal > lo
            yield _batch(what, _columns(
                len(s), client=r.client[s], block=np.full(len(s), block), pos=s - 1, first_id=ids(s - 1), cents=r.cents[s - 1], d=lo - s, dsum=r.total(s, lo), u=n - lo, usum=r.total(lo, np.full(len(s), n)),
                gk=np.where(there, goal - lo + 1, 0), gc=r.cents[goal], gid=ids(goal), gsum=r.total(lo, np.maximum(goal + 1, lo)),
            ))
    if r.ok[n - 1]:
        yield _batch("A", _columns(1, client=r.client[-1:], block=[block], pos=[n - 1], first_id=ids([n - 1]), cents=r.cents[-1:]))
    of_first = int(np.searchsorted(r.client, r.client[0], "right"))
    last = {"t1": int(r.t[-1]), "cents1": int(r.cents[-1]), "ok1": bool(r.ok[-1])}
    first = _head(r, of_first)
    if of_first == n:
        yield _batch("edge", _columns(1, client=r.client[:1], block=[block]), json.dumps(first | last))
    else:
        yield _batch("edge", _columns(1, client=r.client[:1], block=[block]), json.dumps(first))
        yield _batch("edge", _columns(1, client=r.client[-1:], block=[block]), json.dumps(last))


def _more_u(part: dict, after: dict, least: int) -> dict:
    """A U part, and what comes after it if it is open. least: the number of the first of its rows that may be a goal."""
    out = {"u": part["n"], "usum": part["sum"], "goal": part["goal"] if part["goal"] and part["goal"][0] >= least else None, "behind": part["behind"]}
    if part["behind"] == "open":
        out |= {"u": part["n"] + after["u"], "usum": part["sum"] + after["usum"], "behind": after["behind"]}
        if after["goal"]:
            k, cents, ident, total = after["goal"]
            out["goal"] = [part["n"] + k, cents, ident, part["sum"] + total]
    return out


_NOTHING = {"u": 0, "usum": 0, "goal": None, "behind": None}


def _ends(client: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """For each block of a client how starts go on that are open at its end, by what their last row is; from the last block back."""
    rows: list[tuple] = []
    after: dict[str, dict | None] = {"A": None, "D": None, "U": dict(_NOTHING)}
    begin: dict | None = None  # how the next block begins
    for block, head in sorted(zip(edges["block"], edges["head"], strict=True), reverse=True):
        edge = json.loads(head)
        if "t1" in edge:
            now: dict[str, dict | None] = {"A": None, "D": None, "U": dict(_NOTHING)}
            if begin is not None:
                near = begin["t"] - edge["t1"] <= GAP_US
                both = near and begin["ok"] and edge["ok1"] and begin["kind"] > 0
                label = (D if begin["cents"] < edge["cents1"] else U if begin["cents"] > edge["cents1"] else OTHER) if both else OTHER
                fits = near and begin["ok"] and begin["kind"] == CLICK
                if label == D:
                    d = begin["as_d"]
                    more = _more_u(d["u"], after["U"], 2) if d["u"] else after["D"] if d["open"] else None
                    now["A"] = now["D"] = more and more | {"d": d["n"] + more.get("d", 0), "dsum": d["sum"] + more.get("dsum", 0)}
                elif label == U:
                    now["D"] = _more_u(begin["as_u"], after["U"], 2)
                    now["U"] = _more_u(begin["as_u"], after["U"], 1)
                if label != U and fits:
                    now["U"] = _NOTHING | {"behind": [begin["id"], begin["cents"]]}
            after = now
            for what, x in now.items():
                if x is not None:
                    goal, behind = x["goal"] or [0, None, None, 0], x["behind"] or [None, None]
                    rows.append((what, client[0], block, x.get("d", 0), x.get("dsum", 0), x["u"], x["usum"], *goal, *behind))
        begin = edge if "first" in edge else None
    out = pd.DataFrame(rows, columns=["what", *REST])
    return out.astype({c: "Int64" for c in REST})


def _labels(d: Column, u: Column) -> Column:
    """SHA-256 of the matched letters."""
    return F.sha2(F.concat(F.lit("A"), F.repeat(F.lit("D"), d.cast("int")), F.repeat(F.lit("U"), u.cast("int")), F.lit("P")), 256)


def matches(clicks: DataFrame, blocks: int | None = None) -> DataFrame:
    """client_id, match_no (from 1 for each client, by first row), first_id, last_id, n_rows, sum_cents, d, u (how many rows matched D and U), labels_sha256.

    clicks: click_id, ts, client_id, kind, value and more. blocks: how many ranges the rows are dealt out to; shuffle partitions if not given.
    """
    blocks = blocks or int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["client", "ts", "id", "h1", "h2"]
    dealt = events(clicks).repartitionByRange(blocks, "client", "ts", "id").sortWithinPartitions(*order)
    found = checkpoint(dealt.select("client", "ts", "id", "kind", "cents").mapInArrow(lean(_block), BLOCKS))
    ends = found.where("what = 'edge'").select("client", "block", "head").groupBy("client").applyInPandas(_ends, ENDS)
    going = found.where("what in ('A', 'D', 'U')").join(checkpoint(ends), ["what", "client", "block"])
    # P: the row behind the U rows, else the later goal, else the goal of the own block
    behind, later, own = F.col("xc") >= F.col("cents"), (F.col("gk2") > 0) & (F.col("gc2") >= F.col("cents")), (F.col("gk") > 0) & (F.col("gc") >= F.col("cents"))
    d, u = F.col("d") + F.col("d2"), F.col("u") + F.col("u2")
    pick = lambda x, y, z: F.when(behind, x).when(later, y).when(own, z)
    k = pick(u + 1, F.col("u") + F.col("gk2"), F.col("gk"))  # U rows up to P, with it
    total = pick(F.col("usum") + F.col("usum2") + F.col("xc"), F.col("usum") + F.col("gsum2"), F.col("gsum"))
    last = pick(F.col("xid"), F.col("gid2"), F.col("gid"))
    closed = going.where(k.isNotNull()).select("client", "block", "pos", "first_id", last.alias("last_id"), (1 + d + k).alias("n_rows"), (F.col("cents") + F.col("dsum") + F.col("dsum2") + total).alias("sum_cents"), d.alias("d"), (k - 1).alias("u"))
    names = ["client", "block", "pos", "first_id", "last_id", "n_rows", "sum_cents", "d", "u"]
    all_ = found.where("what = 'match'").select(*names).unionByName(closed)
    # numbers within a block, and how many matches the client has in earlier ones
    counts = all_.groupBy("client", "block").agg(F.count("*").alias("here"))
    before = counts.withColumn("before", F.sum("here").over(Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").select("client", "block", "before")
    nr = F.row_number().over(Window.partitionBy("client", "block").orderBy("pos"))
    numbered = all_.withColumn("nr", nr).join(before, ["client", "block"], "left")
    return numbered.select(
        F.col("client").alias("client_id"), (F.col("nr") + F.coalesce("before", F.lit(0))).cast("long").alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "d", "u", _labels(F.col("d"), F.col("u")).alias("labels_sha256")
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")
