"""Operators against plain versions of their definitions: tiles, word pieces with a real vocabulary, language profiles, severity scores."""

import random

import numpy as np
import pytest
from test_llm import SCHEMA, components, sentence

from webloom.llm import common, language, simhash, toxicity, wordpieces
from webloom.llm.queries import word_tokenizer


@pytest.mark.parametrize("tile", [4, 16])
def test_tiles_by_population_count(spark, tile):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 150:  # chains of near values, so that buckets are large
        base = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 2, 3, 4, 9])):
            base ^= 1 << rng.randrange(64)
        fps.add(base)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.connected(simhash.links(df, 3, tile)).collect()}
    want = components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [roots.get(x, x) for x in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def greedy(word, pieces):
    """The number of greedy longest pieces of a word, built one by one; 1 if there is no way on."""
    word, at, n = word + wordpieces.END, 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts_with_the_real_vocabulary(spark):
    pieces = set(wordpieces.vocabulary(word_tokenizer()))
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").unionByName(spark.createDataFrame([(-1, "naïve 日本語 x_1 ½ Ünder", "en", "s", 9), (-2, None, "en", "s", 0)], SCHEMA))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known: dict = {}
    for r in wordpieces.counts(docs, word_tokenizer()).collect():
        words = wordpieces.WORD.findall((texts[r["doc_id"]] or "").lower())
        for w in set(words) - known.keys():
            known[w] = greedy(w, pieces)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
    assert len(known) > 1000


def test_profiles_by_hand(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 30) for _ in range(6)] + ["Ünï 12 çode", "", "a"]
    made = language.Profiles()
    got = made.of(texts)
    for text, row in zip(texts, got, strict=True):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        codes = [ord(c) for c in " " + " ".join(letters.split()) + " "] if letters.split() else []
        vectors = {c: language._vectors(np.array([c]), language.DIM)[0].astype(int) for c in set(codes)}
        total = np.zeros(language.DIM)
        for i in range(len(codes) - language.N + 1):
            bound = np.ones(language.DIM)
            for k in range(language.N):
                bound = bound * np.roll(vectors[codes[i + k]], language.N - 1 - k)
            total += bound
        cosine = float(total @ row) / max(1e-9, np.linalg.norm(total) * np.linalg.norm(row))
        assert (not total.any() and not row.any()) or cosine > 0.99, text


def test_severity_by_hand(spark):
    model = toxicity.Model({"scum": 4.0, "idio*": 3.0, "idiot": 1.5}, [2.0, 5.0])
    texts = ["you scum", "IDIOT idiot idiotic", "clean words", None, "scum, idiots! scum"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(texts):
        words = {w.lower() for w in (t or "").replace(",", " ").replace("!", " ").split()}
        score = sum(sum(model.weights.get(f, 0.0) for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k)]) for w in words)
        over = [1 / (1 + np.exp(-(score - x))) for x in model.thresholds]
        assert got[i]["p_toxic"] == pytest.approx(over[0]) and got[i]["severity"] == pytest.approx(sum(over))
        assert got[i]["grade"] == int(np.argmax([1 - over[0], over[0] - over[1], over[1]]))
