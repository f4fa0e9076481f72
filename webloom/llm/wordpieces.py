"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary becomes a trie. Each state also has a failure link and the number of pieces that are popped on taking it: if no edge
fits, the greedy longest pieces of what has been read are counted, never built, and the state is the one that holds the rest.
Every character is thus read once and each failure follows from finished pieces, so time is linear in the text.

A text's words are runs of letters and digits in lower case and each other visible character alone. The end of a word is the symbol
``END``; pieces with it can only stand last. A word counts as one (unknown) token if the greedy match gets stuck in it.

Nulls: null and empty texts have no tokens; a null doc_id stays null; repeated rows stay repeated; an empty table gives no rows. Other
columns are ignored. Counts of words are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import chunks

END = "\0"
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """The trie with failure links. Pieces are strings; those that end a word carry END."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        depth, ends = [0], [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    depth.append(depth[at] + 1)
                    ends.append(False)
                at = to
            ends[at] = bool(at)
        # fail[s]: the state after the longest pieces of s are popped, or -1; popped[s]: how many
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                queue.append(to)
                if ends[to]:
                    self.fail[to], self.popped[to] = 0, 1
                    continue
                # what is left of at after its pieces are popped, then c
                rest, count = self.fail[at], self.popped[at]
                while rest >= 0 and c not in self.next[rest]:
                    count += self.popped[rest]
                    rest = self.fail[rest]
                if rest >= 0:
                    self.fail[to], self.popped[to] = self.next[rest][c], count

    def count(self, word: str) -> int:
        """The number of greedy longest pieces of a word; 1 if it can't be divided so."""
        at, count = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in [*word, END]:
            while (to := step[at].get(c)) is None:
                if fail[at] < 0 or at == 0:
                    return 1
                count += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return 1
            count += popped[at]
            at = fail[at]
        return count


def vocabulary(path: str, word_end: str = "</w>") -> list[str]:
    """The pieces of a tokenizer file whose word-final pieces end in word_end, in characters instead of byte letters."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    pieces = []
    for piece in model:
        last = piece.endswith(word_end)
        try:
            text = bytes(byte[c] for c in piece.removesuffix(word_end)).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character
        pieces.append(text + END if last else text)
    return pieces


_AUTOMATA: dict[str, Automaton] = {}


def counts(docs: DataFrame, path: str, room: int = 250_000) -> DataFrame:
    """doc_id, n_words, n_tokens: a row per row of docs. path: the vocabulary's file, which is on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in chunks(batches, 1, 4 << 20):
            if path not in _AUTOMATA:
                _AUTOMATA[path] = Automaton(vocabulary(path))
            count = _AUTOMATA[path].count
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                found = WORD.findall((text or "").lower())
                if len(known) > room:
                    known = {}
                try:
                    n = sum(map(known.__getitem__, found))
                except KeyError:
                    for w in found:
                        if w not in known:
                            known[w] = count(w)
                    n = sum(map(known.__getitem__, found))
                words.append(len(found))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
