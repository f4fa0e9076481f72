"""Exact removal of long repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if some string of ``depth`` bytes that covers it also starts earlier (in a smaller doc_id, or earlier in the same
document). Suffixes are ordered only through their first ``depth`` bytes, most significant digit first, and a
suffix leaves the sort as soon as it is alone in its group:

1. Of all suffixes, those at anchors are sorted. An anchor is a place whose next ``gram`` bytes have the least
   hash in some string of ``depth`` bytes, so equal strings have an anchor at the same offset (about one place in 30).
2. The first digit is the hash of the gram, the second that of the whole neighbourhood, i.e. all bytes of the strings
   with this anchor. Each Arrow batch combines its own equal neighbourhoods before the shuffle. An anchor that is not the
   first of its neighbourhood is a repeat of all those strings; a gram with one neighbourhood is done. Two neighbourhoods are
   equal if the gram's 64 bits and 96 more, of two independent hashes, agree.
3. Of grams with several neighbourhoods, one suffix each is left. Their strings are sorted on the real bytes, eight
   at a time, in the task that holds the gram.
4. A gram with more than ``HOT`` neighbourhoods is never gathered. It takes further rounds over the cluster: the distances of a
   string's start from the anchor are cut into ``WAYS`` ranges, and the digit of a range is all bytes that its strings have in
   common. Rows with equal bytes are pre-aggregated to the first one (the others are repeats), rows that are alone with their
   digit leave, groups that have become small go to step 3, and the rest is cut again, until a range is one string. Rows are
   grouped by the real bytes here, and fall from round to round.

Nulls: a null text is an empty document. A null doc_id counts as larger than all others. Exact repeated rows are one document and
each gets its result; different texts under one doc_id count as documents in the order of a hash of the text. Texts shorter than
``depth`` bytes stay whole. Other columns are ignored by ``removals`` and returned as they are by ``removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, chunks, lean, likely, narrow, packed, release, small_batches, unpacked

DEPTH, GRAM, HOT, WAYS = 100, 40, 1024, 4
CHUNK = 1 << 19
NO_ID = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE, _TABLE2 = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size <= n:
            inverse = pow(_BASE, -1, 1 << 64)
            factors = np.ones((2, n + 1024), np.uint64)
            factors[:, 1:] = np.array([[_BASE], [inverse]], np.uint64)
            cls.up, cls.down = np.multiply.accumulate(factors, axis=1)
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    return x


def _slide(x: np.ndarray, width: int, what: np.ufunc) -> np.ndarray:
    """what over x[i : i + width] for every i."""
    span, out = 1, x
    while span * 2 <= width:
        out = what(out[: out.size - span], out[span:])
        span *= 2
    rest = width - span
    return what(out[: out.size - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, starts: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, its text's index, gram hash, two neighbourhood hashes) of the anchors; data joins texts that begin at starts."""
    n, width = data.size, depth - gram + 1
    if n < depth:
        none = np.zeros(0, np.int64)
        return none, none, *[none.astype(np.uint64)] * 3
    up, down = _Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * down[:n], out=sums[1:])
    h = _mix((sums[gram:] - sums[:-gram]) * up[: n - gram + 1]) | _U(1)
    least = _slide(h, width, np.minimum)  # of the string that starts here
    ends = np.concatenate((starts[1:], [n]))
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        least[max(s, e - depth + 1) : e] = 0  # it would go over the text's end
    padded = np.zeros(h.size + width - 1, np.uint64)
    padded[width - 1 : width - 1 + least.size] = least
    place = np.flatnonzero(_slide(padded, width, np.maximum) == h)
    text = np.searchsorted(starts, place, "right") - 1
    lo, hi = np.maximum(starts[text], place - width + 1), np.minimum(ends[text], place + depth)
    size = (place - lo).astype(np.uint64) * _U(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64)
    around = _mix(_mix((sums[hi] - sums[lo]) * up[lo]) + size)
    np.cumsum(_TABLE2[data] * down[:n], out=sums[1:])
    return place, text, h[place], around, _mix(_mix((sums[hi] - sums[lo]) * up[lo]) + size) >> _U(32)


def _spread(texts: list[bytes], depth: int, gram: int, limit: int = 2 * CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, place in it, gram hash, two neighbourhood hashes) for the texts; very long ones go piece by piece."""
    if len(texts) == 1 and len(texts[0]) > limit:
        margin, data = 4 * depth, np.frombuffer(texts[0], np.uint8)
        for at in range(0, data.size, limit):
            lo, hi = max(0, at - margin), min(data.size, at + limit + margin)
            place, text, *hashes = anchors(data[lo:hi], np.zeros(1, np.int64), depth, gram)
            own = (place + lo >= at) & (place + lo < at + limit)
            yield text[own], place[own] + lo, *(x[own] for x in hashes)
        return
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
    place, text, *hashes = anchors(np.frombuffer(b"".join(texts), np.uint8), starts, depth, gram)
    yield full[text], place - starts[text], *hashes


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(keys[0].size, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _anchored(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """gram, around, more, doc, sub, at: the first anchor of each neighbourhood in each batch. at < 0: bytes -1-at to around are a repeat."""
    names, width = ["gram", "around", "more", "doc", "sub", "at"], depth - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2, CHUNK):
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for text, place, h, around, more in _spread([t or b"" for t in batch.column(2).to_pylist()], depth, gram):
                doc, sub = ids[text], subs[text]
                order = np.lexsort((place, sub, doc, more, around, h))
                text, place, h, around, more, doc, sub = (x[order] for x in (text, place, h, around, more, doc, sub))
                new = _first(h, around, more)
                yield _batch(names, h[new].view(np.int64), around[new].view(np.int64), more[new].astype(np.uint32).view(np.int32), doc[new], sub[new], place[new].astype(np.int32))
                old = np.flatnonzero(~new)
                old = old[np.lexsort((place[old], text[old]))]
                # repeats that touch become one row
                text, lo, doc, sub = text[old], np.maximum(place[old] - width + 1, 0), doc[old], sub[old]
                begin = _first(text)
                if old.size:
                    begin[1:] |= lo[1:] > place[old][:-1] + depth
                    stop = place[old][np.concatenate((np.flatnonzero(begin)[1:] - 1, [old.size - 1]))] + depth
                    lo, doc, sub = lo[begin], doc[begin], sub[begin]
                    yield _batch(names, _mix(doc.astype(np.uint64) * _U(_BASE) + lo.astype(np.uint64)).view(np.int64), stop.astype(np.int64), np.zeros(lo.size, np.int32), doc, sub, (-1 - lo).astype(np.int32))

    return docs.select("doc", "sub", "text").mapInArrow(lean(run), "gram long, around long, more int, doc long, sub long, at int")


def _sorted_out(rows: DataFrame, depth: int, gram: int, hot: int) -> DataFrame:
    """doc, sub, lo, hi, gram, kind. kind 0: bytes lo to hi are a repeat. 1, 2: the anchor lo of a gram with several neighbourhoods; 2: of a hot one."""
    names, width = ["doc", "sub", "lo", "hi", "gram", "kind"], depth - gram + 1

    def out(kind: int, g: np.ndarray, doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return _batch(names, doc, sub, lo.astype(np.int32), hi.astype(np.int32), g, np.full(g.size, kind, np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, ...] | None = None  # gram and neighbourhood of the last anchor
        over: int | None = None  # the gram that is known as hot
        held = [np.zeros(0, np.int64)] * 4  # the last gram's anchors so far
        for batch in batches:
            if not batch.num_rows:
                continue
            g, around, more, doc, sub, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            done = at < 0
            if done.any():
                yield out(0, g[done], doc[done], sub[done], -1 - at[done], around[done])
                g, around, more, doc, sub, at = (x[~done] for x in (g, around, more, doc, sub, at))
                if not g.size:
                    continue
            new = _first(g, around, more)
            new[0] = last != (int(g[0]), int(around[0]), int(more[0]))
            last = (int(g[-1]), int(around[-1]), int(more[-1]))
            if not new.all():
                yield out(0, g[~new], doc[~new], sub[~new], np.maximum(at[~new] - width + 1, 0), at[~new] + depth)
            g, doc, sub, at = (x[new] for x in (g, doc, sub, at))
            if over is not None:
                same = g == over
                if same.any():
                    yield out(2, g[same], doc[same], sub[same], at[same], at[same])
                g, doc, sub, at = (x[~same] for x in (g, doc, sub, at))
                if last[0] != over:
                    over = None
            held = [np.concatenate(x) for x in zip(held, (g, doc, sub, at), strict=True)]
            if not held[0].size:
                continue
            tail = held[0] == last[0]
            ended, held = [x[~tail] for x in held], [x[tail] for x in held]
            yield from several(ended)
            if held[0].size > hot:
                over = last[0]
                yield out(2, *held, held[3])
                held = [x[:0] for x in held]
        yield from several(held)

    def several(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not rows[0].size:
            return
        new = _first(rows[0])
        counts = np.diff(np.concatenate((np.flatnonzero(new), [new.size])))
        size = np.repeat(counts, counts)
        for kind, own in ((1, (size > 1) & (size <= hot)), (2, size > hot)):
            if own.any():
                yield out(kind, *(x[own] for x in rows), rows[3][own])

    schema = "doc long, sub long, lo int, hi int, gram long, kind byte"
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "gram").sortWithinPartitions("gram", "around", "more", "doc", "sub", "at").mapInArrow(lean(run), schema)


def _suffixes(base: DataFrame, left: DataFrame, depth: int, gram: int) -> DataFrame:
    """gram, doc, sub, begin, around, skip, first, last: the bytes around each anchor that is left, from place begin on.

    The anchor comes skip bytes later. The strings in question start at the offsets first to last.
    """
    width = depth - gram + 1
    lists = left.groupBy("doc", "sub").agg(F.collect_list(F.struct("gram", "lo")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2, CHUNK):
            rows: list[tuple] = []
            for doc, sub, text, places in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for p in places:
                    lo = max(0, p["lo"] - width + 1)
                    around, skip = text[lo : p["lo"] + depth], p["lo"] - lo
                    rows.append((p["gram"], doc, sub, lo, around, skip, 0, min(skip, len(around) - depth)))
                if len(rows) > 20_000:
                    yield _rows(rows, _SUFFIX)
                    rows = []
            if rows:
                yield _rows(rows, _SUFFIX)

    # all columns of base go in, so that every join can read the same exchange
    joined = base.join(lists, ["doc", "sub"]).select("doc", "sub", "text", "places", *[c for c in base.columns if c not in ("doc", "sub", "text")])
    return joined.mapInArrow(lean(run), "gram long, doc long, sub long, begin int, around binary, skip int, first int, last int")


_SUFFIX = {"gram": pa.int64(), "doc": pa.int64(), "sub": pa.int64(), "begin": pa.int32(), "around": pa.binary(), "skip": pa.int32(), "first": pa.int32(), "last": pa.int32()}
_RANGE = {"gram": pa.int64(), "near": pa.int32(), "far": pa.int32(), "skip": pa.int32(), "around": pa.binary(), "doc": pa.int64(), "sub": pa.int64(), "begin": pa.int32()}


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _ranges(rows: DataFrame, depth: int, ways: int) -> DataFrame:
    """The rows' ranges of distances (near to far bytes from string to anchor) cut into ways: a row per part that has strings, with the bytes of all of them.

    gram becomes a hash of the digit, i.e. of the bytes that all strings of the part share and their place; skip is the anchor's offset in the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                found = []
                for gram, near, far, skip, around, doc, sub, begin in zip(*(piece.column(c).to_pylist() for c in range(8)), strict=True):
                    step = -(-(far - near + 1) // ways)
                    for n in range(near, far + 1, step):
                        f = min(n + step - 1, far)
                        first, last = max(0, skip - f), min(skip - n, len(around) - depth)
                        if first <= last:
                            digit = xxhash.xxh3_64_intdigest(b"%d " % n + around[skip - n : skip - f + depth], gram & 0xFFFF_FFFF_FFFF_FFFF) - (1 << 63)
                            found.append((digit, n, f, skip - first, around[first : last + depth], doc, sub, begin + first))
                if found:
                    yield _rows(found, _RANGE)

    return rows.select(*_RANGE).mapInArrow(lean(run), "gram long, near int, far int, skip int, around binary, doc long, sub long, begin int")


def _hot(suffixes: DataFrame, depth: int, gram: int, hot: int, ways: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds over the suffixes of hot grams: (repeats as doc, sub, lo, hi; suffixes of the groups that became small)."""
    found, small = [], []
    rows = suffixes.select("gram", F.lit(0).alias("near"), F.lit(depth - gram).alias("far"), "skip", "around", "doc", "sub", "begin")
    span = depth - gram + 1
    same = ["gram", "near", "far", "skip", "around"]
    parts = checkpoint(_ranges(rows, depth, ways))
    while size := parts.count():
        span = -(-span // ways)
        each = parts.groupBy(*same).agg(F.min(F.struct("doc", "sub", "begin")).alias("first"), F.count("*").alias("n"))
        each = checkpoint(narrow(each, size, 20_000))
        later = parts.join(each.where("n > 1").select(*same, "first"), same).where(F.struct("doc", "sub", "begin") > F.col("first"))
        found.append(later.select("doc", "sub", F.col("begin").alias("lo"), (F.col("begin") + F.length("around")).alias("hi")))
        if span == 1:
            break
        open_ = each.join(each.groupBy("gram").agg(F.count("*").alias("several")).where("several > 1"), "gram").select(*same, "first.*", "several")
        small.append(open_.where(F.col("several") <= hot).select("gram", "doc", "sub", "begin", "around", "skip", F.lit(0).alias("first"), (F.length("around") - depth).alias("last")))
        parts = checkpoint(_ranges(narrow(open_.where(F.col("several") > hot), size, 20_000), depth, ways))
    return found, small


def equal_strings(gram: np.ndarray, doc: np.ndarray, sub: np.ndarray, begin: np.ndarray, around: list[bytes], skip: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each string of depth bytes in a row's bytes that equals an earlier one of its gram at the same distance from the anchor.

    skip: the anchor's offset in the row's bytes; the strings in question start at the offsets first to last. Rounds go over eight bytes each, and strings that are alone in their group leave.
    """
    sizes = np.array([len(x) for x in around], np.int64)
    strings = (last - first + 1).astype(np.int64)
    row = np.repeat(np.arange(sizes.size), strings)
    offset = np.arange(row.size) - np.repeat(np.cumsum(strings) - strings, strings) + first[row]
    data = np.frombuffer(b"".join(around) + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    base = (np.cumsum(sizes) - sizes)[row] + offset
    # the first digit: the gram and the distance from the anchor
    group = np.unique(gram, return_inverse=True)[1][row] * (2 * depth) + (skip[row] - offset)
    alive = np.arange(row.size)
    for at in [*range(0, depth - 8, 8), depth - 8]:
        digit = np.ascontiguousarray(words[base[alive] + at]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = _first(group, digit)
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        alive, group = alive[several], group[several]
        if not alive.size:
            break
    r, o = row[alive], offset[alive]
    order = np.lexsort((begin[r] + o, sub[r], doc[r], group))
    later = ~_first(group[order])
    return r[order][later], o[order][later]


def _compared(suffixes: DataFrame, depth: int) -> DataFrame:
    """doc, sub, lo, hi: repeats among the strings of grams that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            held.append(batch)
            if sum(b.num_rows for b in held) < 6000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = rows.column(0).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield from sort_out(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if held:
            yield from sort_out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def sort_out(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        g = rows.column(0).to_numpy()
        ends = np.flatnonzero(np.concatenate((_first(g)[1:], [True]))) + 1
        start = 0
        while start < g.size:  # whole grams, about 4000 rows at a time
            stop = int(ends[min(ends.size - 1, np.searchsorted(ends, start + 4000))])
            part = rows.slice(start, stop - start)
            start = stop
            doc, sub, begin, skip, first, last = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 5, 6, 7))
            r, o = equal_strings(part.column(0).to_numpy(), doc, sub, begin, part.column(4).to_pylist(), skip, first, last, depth)
            if not r.size:
                continue
            # runs of neighbouring strings of a row become one
            order = np.lexsort((o, r))
            r, o = r[order], o[order]
            new = _first(r)
            new[1:] |= o[1:] != o[:-1] + 1
            stop_at = np.concatenate((np.flatnonzero(new)[1:] - 1, [r.size - 1]))
            lo = begin[r[new]] + o[new]
            yield _batch(["doc", "sub", "lo", "hi"], doc[r[new]], sub[r[new]], lo.astype(np.int32), (begin[r[stop_at]] + o[stop_at] + depth).astype(np.int32))

    parts = max(1, int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return suffixes.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(lean(run), "doc long, sub long, lo int, hi int")


def _spans(docs: DataFrame, depth: int, gram: int, hot: int, ways: int = WAYS) -> DataFrame:
    """doc, sub, text, rest, empty, spans: rest holds the row's columns, empty says that its text is null; spans, or null, are lists of [lo, hi) that cover its repeats; they may overlap and go over the end."""
    small_batches(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("text"),
        packed(docs, "text").alias("rest"),
        F.col("text").isNull().alias("empty"),
    )
    if base.groupBy("doc").count().where(f"count > 1 or doc = {NO_ID}").isEmpty():
        base = base.withColumn("sub", F.lit(0).cast("long"))
        whole = base
    else:
        base = base.withColumn("sub", F.xxhash64("text"))
        whole = base.dropDuplicates(["doc", "sub"])
    rows = checkpoint(_sorted_out(_anchored(whole, depth, gram), depth, gram, hot))
    release(docs.sparkSession)
    left = lambda kind: rows.where(F.col("kind") == kind).select("doc", "sub", "gram", "lo")
    found = rows.where("kind = 0").select("doc", "sub", "lo", "hi")
    repeats, small = [], []
    if not left(2).isEmpty():
        repeats, small = _hot(_suffixes(likely(whole, left(2), "doc", "sub"), left(2), depth, gram), depth, gram, hot, ways)
    several = _suffixes(whole, left(1), depth, gram)
    for more in small:
        several = several.unionByName(more)
    for more in [_compared(several, depth), *repeats]:
        found = found.unionByName(more)
    spans = found.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return base.join(spans, ["doc", "sub"], "left").select("doc", "sub", "text", "rest", "empty", "spans")


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, the number that go and of how many runs."""
    if not spans:
        return text, 0, 0
    kept, at, runs = [], 0, 0
    end = -1
    for lo, hi in sorted((s["lo"], min(s["hi"], len(text))) for s in spans):
        if lo > end:  # not even touching
            kept.append(text[at:lo])
            runs += 1
        end = max(end, hi)
        at = end
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def removals(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 4 * CHUNK):
            sizes, gone, runs, digests = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, removed, n = cut(text, spans)
                sizes.append(len(text))
                gone.append(removed)
                runs.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
            columns = [pa.array(x, t) for x, t in ((sizes, pa.int64()), (gone, pa.int64()), (runs, pa.int64()), (digests, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _spans(docs.select("doc_id", "text"), depth, gram, hot)
    # rest and empty go in whole: if they were pruned here, the text would be shuffled once more for this join
    return found.select(F.col("rest.c0").cast("long").alias("doc_id"), "text", "spans", "rest", "empty").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs without the repeats: text holds the bytes that stay (broken characters at the seams are dropped), null stays null; a column n_chars follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 4 * CHUNK):
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(cut(text, spans)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3)], ["rest", "text", "empty"])

    found = _spans(docs, depth, gram, hot)
    kept = found.select("rest", "text", "spans", "empty").mapInArrow(lean(run), f"rest {found.schema['rest'].dataType.simpleString()}, text string, empty boolean")
    columns = dict(zip(docs.columns, unpacked(docs.columns, "text"), strict=True)) | {"text": F.when(~F.col("empty"), F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("empty"), columns["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*columns.values())
