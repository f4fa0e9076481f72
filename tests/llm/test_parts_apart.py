"""Items whose question and answer stand far apart in a text are leaks like others."""

import random

from webloom.llm import decontaminate

VOCABULARY = [f"w{i}" for i in range(400)]


def said(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_question_and_answer_far_apart(spark):
    rng = random.Random(17)
    items = [(i, said(rng, rng.randint(3, 12)) + "\n" + said(rng, rng.randint(1, 14))) for i in range(60)]
    texts = []
    for _, item in items:
        q, a = item.split("\n")
        texts.append(f"{said(rng, 50)} {q} {said(rng, rng.randint(200, 900))} {a} {said(rng, 40)}")
        texts.append(f"{said(rng, 50)} {a} {said(rng, 500)} {q}")
        texts.append(f"{said(rng, 300)} {a}")
        w = q.split(" ")
        w[rng.randrange(len(w))] = "other"
        texts.append(f"{' '.join(w)} {said(rng, 300)} {a}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["overlap"]) for r in decontaminate.judged(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    leaked = 0
    for d, text in enumerate(texts):
        words = decontaminate.WORD.findall(text)
        seen = set().union(*(decontaminate.shingles(words, k) for k in range(1, 6)))
        want, most = [], 0.0
        for i, item in items:
            q, a = decontaminate.parts(item)
            if len(q) + len(a) < 5:
                continue
            sets = [decontaminate.shingles(q) | decontaminate.shingles(a)] + ([decontaminate.shingles(q)] if len(q) >= decontaminate.QUESTION else [])
            share = max(len(s & seen) / len(s) for s in sets)
            if share >= 0.8 - 1e-9:
                want.append(i)
                most = max(most, share)
        assert got[d] == (want, most), (d, text)
        leaked += len(want)
    assert leaked >= 120
