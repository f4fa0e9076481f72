"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w.x - t_k): all thresholds t_1 < t_2 < ... share the weights w. Features are the distinct words (letters only,
lower case) and their beginnings of 4 to 7 letters; x counts the distinct words of the whole text that carry a feature. The score of a
text is thus a sum over its distinct words, each looked up in a bounded cache.

Grades of the training rows: 0 for toxic = 0; toxic rows are divided by how many distinct telling words they have (words with features
that are far more frequent in toxic rows), at the quantiles of ``GRADES``. The labels hold no severity, so this is what orders them.

Training: at most ``PER_CLASS`` labelled rows of each class, taken by a hash of doc_id, with all distinct words of each, and of near copies
only one (a documented bound; all documents are scored). The model has ``MAX_FEATURES`` weights at most, which bounds what
the tasks get.

Nulls: a null or empty text has no features and gets the grade of none; a null doc_id stays null and can't be a training row; labels that are null
count for nothing; with labels of one class only, or none, nothing is toxic. Repeated rows stay repeated. Several labels of one doc_id: the largest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import chunks, lean, packed, unpacked

PER_CLASS, MAX_FEATURES = 3000, 20_000
PREFIXES = (4, 5, 6, 7)
BUCKETS, CHANCE = 1 << 20, 0.5
GRADES = (0.5,)
L2, STEPS = 1e-5, 500
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [8.0, 9.0])

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def _apart(rows: list[np.ndarray], size: int) -> list[int]:
    """Rows without those that share a good part of their rarer words with an earlier one (16 minima of hashes)."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 62, (16, max(1, size)))
    df = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=max(1, size))
    rare = df <= max(2, len(rows) // 20)
    seen: list[dict[int, list[int]]] = [{} for _ in hashes]
    kept = []
    for i, words in enumerate(rows):
        if rare[words].any():
            words = words[rare[words]]
        elif not words.size:
            continue
        minima = hashes[:, words].min(axis=1).tolist()
        votes: dict[int, int] = {}
        for at, x in zip(seen, minima, strict=True):
            for j in at.get(x, ()):
                votes[j] = votes.get(j, 0) + 1
        if max(votes.values(), default=0) < 5:
            kept.append(i)
            for at, x in zip(seen, minima, strict=True):
                at.setdefault(x, []).append(i)
    return kept


def fit_rows(words: list[list[str]], toxic: list[int], l2: float = L2, steps: int = STEPS) -> Model:
    """The model from rows given as lists of distinct words."""
    return _fit_coded(*_coded(words), toxic, l2, steps)


def _coded(rows: Iterable[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words in order, and each row as numbers of its words; rows are read once, so that one list of words is held at a time."""
    seen: dict[str, int] = {}
    coded = [np.array([seen.setdefault(w, len(seen)) for w in row], np.int32) for row in rows]
    names = sorted(seen)
    place = np.zeros(len(names), np.int32)
    place[[seen[w] for w in names]] = np.arange(len(names), dtype=np.int32)
    return names, [place[row] for row in coded]


def _fit_coded(names: list[str], coded: list[np.ndarray], toxic: list[int], l2: float, steps: int) -> Model:
    kept = _apart(coded, len(names))
    coded, y = [coded[i] for i in kept], np.array([toxic[i] for i in kept], np.int64)
    if len(set(y.tolist())) < 2:
        return Model()
    # counts of rows by hashed features find the candidates, which are then counted by name
    hashed = np.full((len(names), 1 + len(PREFIXES)), -1, np.int64)
    for i, w in enumerate(names):
        for j, f in enumerate(features(w)):
            hashed[i, j] = xxhash.xxh3_64_intdigest(f) % BUCKETS
    df = np.zeros((2, BUCKETS + 1), np.int32)  # the last place takes the -1
    for row, t in zip(coded, y.tolist(), strict=True):
        df[t, np.unique(hashed[row])] += 1
    df = df[:, :BUCKETS]
    share, rows_with = float(np.mean(y)), df.sum(axis=0)
    # the proof that one feature needs, so that chance gives CHANCE ones among those that could reach it at all (Tarone's correction)
    fewest = next(k for k in range(1, len(coded) + 2) if np.count_nonzero(rows_with >= k) * share**k <= CHANCE)
    least = float(np.log(max(1, np.count_nonzero(rows_with >= fewest)) / CHANCE))

    def proof(clean: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Chernoff's bound for so many toxic rows among those with a feature, 0 if it isn't far more frequent in them."""
        k = np.maximum(1, clean + bad)
        q = bad / k
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = k * (np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0))
        return np.where((q >= 0.8) & (q > share), bound, 0)

    likely = np.zeros(BUCKETS, bool)
    some = np.flatnonzero(df[1])  # without a toxic row there is no proof
    likely[some] = proof(*df[:, some].astype(np.int64)) > least
    del df, rows_with
    of_word = {i: fs for i in np.flatnonzero(np.append(likely, False)[hashed].any(axis=1)).tolist() if (fs := [f for f, h in zip(features(names[i]), hashed[i].tolist(), strict=False) if likely[h]])}
    exact: dict[str, list[int]] = {}
    for row, t in zip(coded, y.tolist(), strict=True):
        for f in {f for i in row.tolist() if i in of_word for f in of_word[i]}:
            exact.setdefault(f, [0, 0])[t] += 1
    # so many that chance would hardly give one such feature among all
    proofs = dict(zip(exact, proof(*np.array(list(exact.values()), np.int64).reshape(-1, 2).T).tolist(), strict=True))
    chosen = sorted((f for f, x in proofs.items() if x > least), key=lambda f: (-proofs[f], f))[:MAX_FEATURES]
    at = {f: i for i, f in enumerate(chosen)}
    # the design matrix, in coordinate form
    r, c = [], []
    hits = np.zeros(y.size)
    for i, row in enumerate(coded):
        for w in row.tolist():
            own = [at[f] for f in of_word.get(w, ()) if f in at]
            hits[i] += bool(own)
            r += [i] * len(own)
            c += own
    r, c = np.array(r, np.int64), np.array(c, np.int64)
    cuts = np.quantile(hits[y == 1], GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, hits, "right"), 0)
    levels = len(GRADES) + 1
    w, t = np.zeros(len(chosen)), 1.0 + np.arange(levels, dtype=float)
    m, v = np.zeros(w.size + levels), np.zeros(w.size + levels)
    above = (grade[:, None] > np.arange(levels)[None, :]).astype(float)
    for step in range(1, steps + 1):
        score = np.bincount(r, w[c], y.size) if r.size else np.zeros(y.size)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -30, 30)))
        g = (p - above) / y.size  # the likelihood's slope, for each threshold
        of_w = np.bincount(c, g.sum(axis=1)[r], w.size) + l2 * w
        slope = np.concatenate((of_w, -g.sum(axis=0)))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, t = np.maximum(w - move[: w.size], 0), np.maximum.accumulate(t - move[w.size :] + 1e-6 * np.arange(levels))
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if x > 1e-3}, t.tolist())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a bounded sample of labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = None
    for side in (0, 1):
        part = known.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 4 << 20):
            rows = [sorted(set(WORD.findall((t or "").lower()))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([" ".join(x) for x in rows], pa.string())], ["doc_id", "toxic", "words"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    # at most 2 x PER_CLASS doc_ids; of rows that repeat one, the first text counts
    rows = sample.mapInArrow(lean(run), "doc_id long, toxic int, words string").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("words").alias("words"))
    found = sorted(rows.collect(), key=lambda x: x["doc_id"])
    toxic, texts = [x["toxic"] for x in found], [x["words"] for x in found][::-1]
    del found
    names, coded = _coded(texts.pop().split() for _ in toxic)  # each text goes once it is read
    return _fit_coded(names, coded, toxic, L2, STEPS)


def _scored(docs: DataFrame, model: Model, room: int = 150_000) -> DataFrame:
    """rest (the row's columns but text), text, p_toxic, severity, grade."""
    names, kinds = ["p_toxic", "severity", "grade"], [pa.float64(), pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in chunks(batches, 1, 1 << 20):
            if len(known) > room:
                known = {}
            scores = []
            for text in batch.column(1).to_pylist():
                words = set(WORD.findall((text or "").lower()))
                for w in words:
                    if w not in known:
                        known[w] = model.word(w)
                scores.append(sum(map(known.__getitem__, words)))
            over = model.grades(np.array(scores, float))
            each = np.concatenate((np.ones((len(scores), 1)), over), axis=1) - np.concatenate((over, np.zeros((len(scores), 1))), axis=1)
            columns = (over[:, 0], over.sum(axis=1), each.argmax(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["rest", "text", *names])

    ready = docs.select(packed(docs, "text").alias("rest"), "text")
    return ready.mapInArrow(lean(run), f"rest {ready.schema['rest'].dataType.simpleString()}, text string, p_toxic double, severity double, grade int")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p_toxic (of any grade above 0), severity (the expected grade) and grade (the likeliest), in place of columns of these names."""
    names = ["p_toxic", "severity", "grade"]
    return _scored(docs, model).select(*unpacked([c for c in docs.columns if c not in names], "text", of=docs.columns), *names)


def judged(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """doc_id, toxic, grade, severity, p_toxic: a row per row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (F.col("p_toxic") >= at).alias("toxic"), "grade", "severity", "p_toxic")


def accepted(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """docs without those that are toxic, with all their columns."""
    return _scored(docs, fit(docs, labels)).where(F.col("p_toxic") < at).select(*unpacked(docs.columns, "text"))
