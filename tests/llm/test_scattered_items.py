"""Items whose shingles are scattered over a text are leaks; very long texts take bounded memory."""

import random
import re
import resource

import numpy as np
import pytest

from webloom.llm import decontaminate, language


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs, items):
    """(text, item) pairs by definition: 0.8 of an item's shingles, or of its question's, anywhere in the text."""
    out = set()
    for d, text in enumerate(docs):
        words = re.findall(r"\w+", text.lower())
        seen = {tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1)}
        for i, item in enumerate(items):
            lines = [x for x in (re.findall(r"\w+", line) for line in item.lower().split("\n")) if x]
            q, a = ([w for x in lines[:-1] for w in x], lines[-1]) if len(lines) > 1 else (lines[0], [])
            whole = shingles(q) | shingles(a)
            part = len(whole & seen) / len(whole)
            if len(q) >= 10:
                part = max(part, len(shingles(q) & seen) / len(shingles(q)))
            if len(q) + len(a) >= 5 and part >= 0.8 - 1e-9:
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scattered_items(seed):
    dice = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    items = []
    for _ in range(40):
        q, a = dice.choices(vocabulary, k=dice.choice([8, 30, 60])), dice.choices(vocabulary, k=dice.choice([0, 3, 12]))
        items.append(" ".join(q) + ("\n" + " ".join(a) if a else ""))
    docs = []
    for i, item in enumerate(items):
        words = item.replace("\n", " ").split()
        cuts = sorted(dice.sample(range(1, len(words)), min(len(words) - 1, i % 4)))
        pieces = [words[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(words)], strict=True)]
        dice.shuffle(pieces)
        text = []
        for p in pieces:
            text += [*p, *dice.choices(vocabulary, k=dice.choice([0, 400]))]
        docs.append(" ".join(text))
    # every shingle by itself, far from the others
    words = items[2].split()
    docs.append(" ".join(" ".join([*words[i : i + 5], *dice.choices(vocabulary, k=90)]) for i in range(len(words) - 4)))
    docs += [" ".join(dice.choices(vocabulary, k=5000)), "", "v1"]
    index = decontaminate.Index.build(list(enumerate(items)))
    got = {(d, index.items[i]) for d, i, _, _ in index.leaks(docs)}
    assert got == plain(docs, items) and len(got) > 20 and (len(items), 2) in got


def test_long_text_of_ever_new_letters():
    """20 MB of text with very many n-grams: bounded memory, and the profile of the plain sum."""
    dice = np.random.default_rng(3)
    codes = dice.integers(0x4E00, 0x9FFF, 7_000_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    profiles = language.Profiles(dim=64)
    row = profiles.of(["".join(map(chr, codes[:700_000].tolist()))])
    assert profiles.keys.size <= language.ROOM and row.shape == (1, 64) and abs(float(np.linalg.norm(row)) - 1) < 1e-5
    text = codes.astype(np.uint32).tobytes().decode("utf-32-le")
    assert len(text.encode()) > 20_000_000
    assert profiles.codes(text).size == len(text) + 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024


def test_windows_change_nothing(monkeypatch):
    """The same profiles whatever is taken at once, against n-gram vectors multiplied one by one."""
    texts = ["Hello, hello world", None, "", "12 !", "αβγ ΣΑΣ", "日本語 テキスト", "a" * 300 + " ß", "x y z " * 50]
    whole = language.Profiles().of(texts)
    monkeypatch.setattr(language, "WINDOW", 11)
    monkeypatch.setattr(language, "ROOM", 7)
    assert np.allclose(language.Profiles().of(texts), whole, atol=1e-5)
    one = language.Profiles()
    for text, row in zip(texts, whole, strict=True):
        words = " " + re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()) + " "
        words = re.sub(" +", " ", words)
        total = np.zeros(language.DIM)
        if words.strip():
            for i in range(len(words) - 2):
                total += np.prod([np.roll(language._vectors(np.array([ord(words[i + j])]), language.DIM)[0].astype(int), 2 - j) for j in range(3)], axis=0)
            total /= np.linalg.norm(total)
        assert np.allclose(row, total, atol=1e-4)
    assert one.of([]).shape == (0, language.DIM)
