"""The filter audit against the filters applied one after the other."""

import random
import re
from itertools import permutations

from webloom.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string, part string, fails int", "doc_id long, quality int, toxic int, part string"


def failing(docs):
    out = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in docs)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": again}
        out.append({k for k, v in bad.items() if v})
    return out


def plain(docs, labels):
    fails = failing(docs)
    good, toxic = ({d for d, q, t, *_ in labels if (q, t)[i] == 1 and d is not None} for i in (0, 1))
    out = []
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        rows, shares = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                counts = (len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                rows.append((part, order, i + 1, *counts))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_against_plain_filters(spark):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(70)]
    docs = []
    for i in range(160):
        n = dice.choice([0, 3, 49, 50, 60, 80])
        text = dice.choice([" ", "\t", "\n", "\x0b"]).join(dice.choices(words[: dice.choice([5, 70])], k=n))
        text = dice.choice([text, text, text.upper(), text + " a#b", "é" * 30 + text])
        docs.append((i if i % 11 else None, text if i % 9 else None, dice.choice(["s1", "s2", None, ""]), "x", 99))
    docs += dice.sample(docs, 25) + [(1000 + i, docs[5][1], "s1", "x", 0) for i in range(20)]
    labels = [(i % 150, dice.choice([0, 1, None]), dice.choice([0, 1, None]), "y") for i in range(170)] + [(None, 1, 1, "y")] * 3
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    rows = filter_audit.audit(spark.createDataFrame([(1, "x", None, "", 0)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows if r.filter_order[r.step - 1] == "A") == 120


def test_long_texts_in_pieces(monkeypatch):
    """A text cut into pieces is judged as a whole; words are never cut."""
    texts = ["", " ", "a" * 40 + " b" * 60, "one two\nthree " * 30 + "#", "É" * 50 + " A" * 9, "word" * 100]
    whole = [filter_audit.judge(t.encode()) for t in texts]
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    assert [filter_audit.judge(t.encode()) for t in texts] == whole
    assert [f for f, _ in whole] == [sum(1 << "ABCDE".index(k) for k in bad) for bad in failing([(None, t) for t in texts])]


def test_many_parts_and_bitmaps(spark, monkeypatch):
    """Each part starts a byte of its own, however many there are."""
    docs = [(i, ("w " * 60 if i % 3 else "x"), f"s{i % 37}", "", 0) for i in range(300)]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(3, 1, 0, "")], LABELS))
    assert sorted(map(tuple, got.collect())) == plain(docs, [(3, 1, 0)])
