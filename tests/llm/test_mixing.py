"""Mixing by blocks: targets, permutations, spans and texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.llm import mixing

DOCS = "doc_id long, source string, text string, size long, nr string"


def docs_of(seed, n=120):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        source = dice.choice(["a", "a", "a", "b", "c", "Z", "é", None, ""])
        text = dice.choice([None, "", " \n ", " ".join(f"d{i}w{j}" for j in range(dice.choice([1, 3, 20, 90])))])
        rows.append((i, source, text, 5, "x"))
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(rows):
    """Shares by weight, and what is above a source's cap to the others again and again."""
    size = Counter()
    for _, source, text, *_ in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size.values())
    while open_ and left > 1e-9:
        total, extra = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=order.index):
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= 2 * size[s]:
                extra += target[s] - 2 * size[s]
                target[s] = float(2 * size[s])
                open_.discard(s)
        left = extra
    return size, target


@pytest.mark.parametrize(("seed", "block"), [(1, 8), (2, 3), (3, 512), (4, 1)])
def test_mix(spark, seed, block):
    rows = docs_of(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    size, target = plain_targets(rows)
    got = {r.doc_id: r for r in mixing.digests(df, block, 5, 4).collect()}
    assert len(got) == len(rows)
    taken = Counter()
    for doc_id, source, text, *_ in rows:
        r = got[doc_id]
        assert r.size == len(words(text)) and r.source_size == size[source] and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) < 1 + 1e-6
    # the spans tell the same, and no block is longer than it may be
    spans = mixing.spans(df, block, 5, 4).collect()
    by_doc = Counter()
    for s in spans:
        by_doc[s.doc_id] += s.length
        assert s.offset >= 0 and s.length > 0 and s.offset + s.length <= got[s.doc_id].size and s.at + s.length <= block
    assert {d: r.taken for d, r in got.items() if r.taken} == dict(by_doc)
    again = {r.doc_id: r.taken for r in mixing.digests(df.repartition(2), block, 5, 4).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_texts(spark):
    """Blocks hold just the words that their spans name, and each word twice at most."""
    rows = docs_of(9)
    df = spark.createDataFrame(rows, DOCS)
    blocks = mixing.texts(df, 8, 5, 4).collect()
    assert all(1 <= len(b.text.split(" ")) <= 8 for b in blocks)
    uses = Counter(w for b in blocks for w in b.text.split(" "))
    assert max(uses.values()) <= 2 and set(uses) <= {w for _, _, t, *_ in rows for w in words(t)}
    taken = {r.doc_id: r.taken for r in mixing.digests(df, 8, 5, 4).collect()}
    assert Counter(int(w[1:].split("w")[0]) for w in uses.elements()) == {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(spark, n):
    """Each pass is a permutation of its own, and the reversed keys lead back."""
    one = spark.createDataFrame([(3, n)], "nr long, n long").select("nr", "n", F.array(*[mixing._keys(p) for p in range(2)]).alias("keys"))
    rows = one.select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("x")).select("x", "keys", "n", mixing.permuted("x", "keys[0]").alias("a"), mixing.permuted("x", "keys[1]").alias("b"))
    got = rows.select("x", "a", "b", mixing.permuted("a", "reverse(keys[0])").alias("back")).collect()
    assert sorted(r.a for r in got) == sorted(r.b for r in got) == list(range(n)) and all(r.back == r.x for r in got)
    if n >= 64:
        assert sum(r.a == r.x for r in got) < n / 8 and [r.a for r in got] != [r.b for r in got]


def test_shards_draw_at_random(spark):
    """Shards' counts of a source vary as draws do, and add up."""
    rows = [(i, "a", " ".join(["w"] * 50), 0, "") for i in range(400)]
    sized = mixing.sizes(spark.createDataFrame(rows, DOCS))
    owed = mixing.plan(mixing.targets(sized), 5)
    counts = [r["count"] for r in mixing._dealt(owed, 16).collect()]
    assert sum(counts) == owed.first().slots == 6000 and len(set(counts)) > 5 and all(250 < c < 500 for c in counts)


def test_odd_rows(spark):
    """Repeated rows and null ids are documents of their own; tables without words, or rows, have nothing to take."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a", text, 0, "")] * 3 + [(None, "a", text, 0, "")] * 2 + [(2, None, None, 0, "")]
    got = mixing.digests(spark.createDataFrame(rows, DOCS), 7, 3, 2).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == [(False, 1, 30)] * 3 + [(False, 2, 0), (True, 0, 30), (True, 0, 30)]
    assert sum(r.taken for r in got) == 225 and max(r.taken for r in got) <= 60
    none = mixing.digests(spark.createDataFrame([(1, "a", "", 0, ""), (2, None, None, 0, "")], DOCS)).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2
    assert mixing.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_native(spark):
    plan = mixing.digests(spark.createDataFrame(docs_of(1), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
