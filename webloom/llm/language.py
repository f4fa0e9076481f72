"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product (binding) of its letters' vectors, each rotated
(permuted) by its distance from the n-gram's end. A text's profile is the sum (bundle) of the vectors of all n-grams of its words, and a
language's prototype the sum of the normalised profiles of its training texts. A text gets the language whose prototype has
the largest cosine with its profile; the mean of the prototypes is taken off first, as it tells no languages apart.

Words are runs of letters in lower case with a blank on each side. Prototypes come from at most ``PER_LANG`` training texts of each language,
taken by a hash of doc_id (a documented bound; every text is predicted, whole). Memory: texts are taken ``WINDOW`` letters at a time, and vectors of at most
``ROOM`` n-grams are made and kept, so a very long text with ever new n-grams takes no more.

Nulls: a text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from. Rows with a null lang or
doc_id teach nothing; a null doc_id counts as not held out. Ties go to the language that sorts first. Repeated rows stay repeated. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, chunks

DIM, N, PER_LANG, ROOM = 512, 3, 400, 20_000
#: Letters of a text that are taken at once.
WINDOW = 1 << 19
BROADCAST_BYTES = 16 << 20
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """The letters' vectors, by their code points alone."""
    return np.stack([np.random.default_rng(1_000_003 + int(c)).integers(0, 2, dim, np.int8) * 2 - 1 for c in codes]) if codes.size else np.zeros((0, dim), np.int8)


class Profiles:
    """Profiles of texts; keeps the vectors of the n-grams it has met."""

    def __init__(self, dim: int = DIM, n: int = N) -> None:
        self.dim, self.n, self.letters = dim, n, {}
        self.keys, self.grams = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)

    def codes(self, text: str) -> np.ndarray:
        """Code points in lower case, with one blank (32) for each run of what isn't a letter, and at both ends."""
        low, out, before = " " + text.lower() + " ", [], True
        for at in range(0, len(low), WINDOW):
            c = np.frombuffer(low[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = np.zeros(c.size, bool)
            near = c < _LETTER.size
            letter[near] = _LETTER[c[near]]
            far, where = np.unique(c[~near], return_inverse=True)
            letter[~near] = np.array([chr(x).isalpha() for x in far.tolist()], bool)[where]
            out.append(np.where(letter, c, 32).astype(np.uint32)[letter | np.concatenate(([before], letter[:-1]))])
            before = bool(letter[-1])
        return np.concatenate(out)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The places of the n-grams' vectors; keys are sorted and distinct."""
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if new.size:
            if self.keys.size + new.size > ROOM:
                self.keys, self.grams, new = np.zeros(0, np.int64), np.zeros((0, self.dim), np.float32), keys
            vectors = np.ones((new.size, self.dim), np.int8)
            for i in range(self.n):
                code = new >> (21 * i) & 0x1F_FFFF
                own, where = np.unique(code, return_inverse=True)
                for c in own.tolist():
                    if c not in self.letters:
                        self.letters[c] = _vectors(np.array([c]), self.dim)[0]
                vectors *= np.stack([np.roll(self.letters[c], i) for c in own.tolist()])[where]
            self.keys, self.grams = np.concatenate((self.keys, new)), np.concatenate((self.grams, vectors.astype(np.float32)))
            order = np.argsort(self.keys)
            self.keys, self.grams = self.keys[order], self.grams[order]
        return np.searchsorted(self.keys, keys)

    def _bundle(self, key: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
        """Adds the vectors of the n-grams to their texts' rows, at most ROOM n-grams at a time."""
        grams, column = np.unique(key, return_inverse=True)
        pairs, counts = np.unique(column * len(out) + text, return_counts=True)  # by n-gram, then text
        for lo in range(0, grams.size, ROOM):
            some = grams[lo : lo + ROOM]
            first, last = np.searchsorted(pairs, [lo * len(out), (lo + some.size) * len(out)])
            dense = np.zeros((len(out), some.size), np.float32)
            dense[pairs[first:last] % len(out), pairs[first:last] // len(out) - lo] = counts[first:last]
            where = self.lookup(some)
            out += dense @ self.grams[where]

    def of(self, texts: list[str | None]) -> np.ndarray:
        """A row of length 1 for each text, or of zeros if it has no letter."""
        codes = [self.codes(t or "") for t in texts]
        sizes = np.array([c.size if c.size > 2 else 0 for c in codes])  # two blanks: no letter
        flat = np.concatenate([c for c, s in zip(codes, sizes.tolist(), strict=True) if s] or [np.zeros(0, np.uint32)])
        out = np.zeros((len(texts), self.dim), np.float32)
        ends = np.cumsum(sizes)
        for at in range(0, max(0, flat.size - self.n + 1), WINDOW):
            part = flat[at : at + WINDOW + self.n - 1].astype(np.int64)
            text = np.searchsorted(ends, np.arange(at, at + part.size), "right")
            key = np.zeros(part.size - self.n + 1, np.int64)
            for i in range(self.n):
                key |= part[self.n - 1 - i : part.size - i] << (21 * i)
            inside = text[: key.size] == text[self.n - 1 :]
            self._bundle(key[inside], text[: inside.size][inside], out)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text, 1 << 19):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Each language's prototype."""
    teach = docs.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    turn = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    # first within 64 parts of each language, then within eight, so that a common one isn't gathered
    few = teach.distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", "lang"), F.lit(64))).withColumn("turn", turn("part")).where(F.col("turn") <= PER_LANG)
    few = few.withColumn("some", F.col("part") % 8).withColumn("turn", turn("some")).where(F.col("turn") <= PER_LANG)
    picked = few.withColumn("turn", turn()).where(F.col("turn") <= PER_LANG).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(dim), {}
        for batch in _slices(batches, 1):
            for lang, row in zip(batch.column(0).to_pylist(), profiles.of(batch.column(1).to_pylist()), strict=True):
                total[lang] = total.get(lang, 0) + row.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["lang", "total"])

    picked = checkpoint(picked)
    # a few hundred rows a language: sent to all tasks unless there are very many languages
    size = picked.agg(F.coalesce(F.sum(F.octet_length("lang") + 32), F.lit(0)).alias("bytes")).first()["bytes"]
    side = F.broadcast(picked) if size <= BROADCAST_BYTES else picked
    texts = docs.select("doc_id", "lang", "text").join(side, ["doc_id", "lang"]).select("lang", "text")
    places = texts.mapInArrow(run, "lang string, total array<double>").selectExpr("lang", "posexplode(total) as (place, x)")
    rows = places.groupBy("lang", "place").agg(F.sum("x").alias("x")).collect()  # DIM numbers a language
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dim))[r["place"]] = r["x"]
    return {k: np.round(v, 6) for k, v in sorted(out.items())}  # rounded: sums may come in any order


def predictions(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 if negative): a row per row of docs."""
    found = prototypes(docs, dim)
    names = list(found)
    unit = lambda x: x / max(1e-12, float(np.linalg.norm(x)))
    each = np.stack([unit(x) for x in found.values()]) if names else np.zeros((0, dim))
    mean = each.mean(axis=0) if len(names) > 1 else np.zeros(dim)
    matrix = np.stack([unit(x - mean) for x in each]).astype(np.float32).T if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dim)
        for batch in _slices(batches, 2):
            rows = profiles.of(batch.column(2).to_pylist())
            some = (rows != 0).any(axis=1)
            if matrix is None:
                langs, scores = [UNKNOWN] * len(rows), np.zeros(len(rows))
            else:
                rows = rows - mean.astype(np.float32)
                cosines = (rows @ matrix) / np.maximum(1e-12, np.linalg.norm(rows, axis=1, keepdims=True))
                best = cosines.argmax(axis=1)
                langs = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores = np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
