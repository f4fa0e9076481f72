"""Lexical retrieval packing of documents into token sequences.

Each task packs its own part of the input, so no text is shuffled and a lost executor only repeats its parts. A part is
taken in shards of about ``SHARD`` tokens. A shard has a BM25 inverted index over token ids; the window's seed is the document
that the previous window cut, else the next unused one, and the index returns its unused neighbours, which fill the window greedily. A seed asks with its
``terms`` strongest distinct terms (``QUERY_TERMS``; 0: with all of them); this only orders the neighbours, as each document is packed whole, whether found or not.
A document that doesn't fit is cut, and its rest opens the next window. What is left at the end of a part is cut into sequences
whose lengths are powers of two, so nothing is padded.

Nulls: a null or empty text is a document of its end token alone; a null doc_id stays null. Repeated rows are documents of their own.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import chunks, lean

WINDOW, END, SHARD, QUERY_TERMS = 2048, 1, 1 << 21, 12
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Texts of these characters only are split here; lower case and NFC form don't change their kind. Others go to the tokenizer whole.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u017f]*")
_LETTER, _DIGIT, _BLANK = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: How the tokenizer divides a text into words.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")


def _byte_letters() -> list[str]:
    """For each byte the character that stands for it in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class Ids:
    """Token ids of texts. The ids of a word don't depend on what is around it, so they are kept for each word, up to a number of words."""

    def __init__(self, path: str, room: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.known = Tokenizer.from_file(path), room, {}
        self.tokenize, letters = self.tokenizer.model.tokenize, _byte_letters()
        self.spelt = lambda word: "".join([letters[b] for b in word.encode()])

    def word(self, word: str) -> bytes:
        found = self.tokenize(word if word.isascii() and word.isalpha() else self.spelt(word))
        ids = self.known[word] = np.array([x.id for x in found], "<u4").tobytes()
        return ids

    def of(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if "<|" in text or not _PLAIN.fullmatch(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if len(self.known) > self.room:
                self.known = {}
            words, known = _PIECE.findall(text.lower()), self.known
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:
                for w in set(words):
                    if w not in known:
                        self.word(w)
                out.append(b"".join(map(known.__getitem__, words)))
        return out


_IDS: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    """One for each Python worker, which serves several tasks."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


class Index:
    """BM25 over the documents of one shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], terms: int = QUERY_TERMS) -> None:
        n, sizes = len(docs), np.array([len(d) for d in docs], np.int64)
        width = 1 + max((int(d.max()) for d in docs if d.size), default=0)
        keys, counts = np.unique(np.repeat(np.arange(n), sizes) * width + np.concatenate(docs), return_counts=True)
        doc, term = keys // width, keys % width
        df = np.bincount(term, minlength=width)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[doc] / max(1.0, sizes.mean())))
        # the strongest terms of each document that occur elsewhere are its query
        strong = np.lexsort((term, -np.where(df[term] > 1, impact, 0), doc))
        rank = np.arange(keys.size) - np.searchsorted(doc, doc)
        best = strong[rank < terms] if terms else strong
        best = best[df[term[best]] > 1]
        self.ask = np.searchsorted(doc[best], np.arange(n + 1))
        self.asked = term[best]
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.concatenate(([0], np.cumsum(df)))
        self.free = np.ones(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first, ties to the earlier one."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.asked[self.ask[seed] : self.ask[seed + 1]].tolist()]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.impact[s] for s in spans]), self.free.size)
        score[~self.free] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows; pieces of closed ones go to rows."""

    def __init__(self, part: int, terms: int = QUERY_TERMS) -> None:
        self.terms = terms
        self.sequence, self.used, self.open, self.rows = part << 33, 0, [], []

    def close(self) -> None:
        self.rows += [(*piece, self.sequence) for piece in self.open]
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def add(self, doc_id: int | None, ids: bytes, room: int = WINDOW, start: int = 0, stop: int | None = None, total: int | None = None) -> bool:
        """Add a document or a piece of it; whether it was cut, so that its rest is in the open window."""
        total = len(ids) // 4 if total is None else total
        stop, was = total if stop is None else stop, False
        while start < stop:
            take = min(stop - start, room - self.used)
            self.open.append((doc_id, start, take, ids[4 * start : 4 * (start + take)], total, self.used))
            self.used, start = self.used + take, start + take
            if self.used == room:
                self.close()
                was = start < stop
        return was

    def shard(self, docs: list[tuple[int | None, bytes]]) -> None:
        index, at, seed = Index([np.frombuffer(b, "<u4").astype(np.int64) for _, b in docs], self.terms), 0, None
        while True:
            while at < len(docs) and not index.free[at]:
                at += 1
            if at == len(docs):
                return
            if seed is None:
                seed = at
                index.free[at] = False
                if self.add(*docs[at]):
                    continue  # its rest opened a window, for which it is the seed
            before, sequence = seed, self.sequence
            for k in index.neighbours(before).tolist():
                index.free[k] = False
                cut = self.add(*docs[k])
                if self.sequence != sequence:
                    seed = k if cut else None
                    break
            else:
                seed = None  # no neighbour is left: go on with the next document

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        room = 1 << max(0, left.bit_length() - 1)
        for doc_id, start, length, ids, total, _ in pieces:
            at = 0
            while at < length:
                take = min(length - at, room - self.used)
                self.open.append((doc_id, start + at, take, ids[4 * at : 4 * (at + take)], total, self.used))
                self.used, at, left = self.used + take, at + take, left - take
                if self.used == room:
                    self.close()
                    room = 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, tokenizer: str, shard: int = SHARD, terms: int = QUERY_TERMS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "offset", "sequence_id"]
    order = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def out(packer: Packer) -> Iterator[pa.RecordBatch]:
        if packer.rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*packer.rows, strict=True), kinds, strict=True)]
            packer.rows = []
            yield pa.RecordBatch.from_arrays(columns, names).select(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, held, tokens = None, Packer(TaskContext.get().partitionId(), terms), [], 0
        end = END.to_bytes(4, "little")
        for batch in chunks(batches, 1, 1 << 20):
            ids = ids or ids_by(tokenizer)
            for doc_id, b in zip(batch.column(0).to_pylist(), ids.of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                held.append((doc_id, b + end))
                tokens += len(b) // 4 + 1
            if tokens >= shard:
                packer.shard(held)
                held, tokens = [], 0
                yield from out(packer)
        if held:
            packer.shard(held)
        packer.finish()
        if ids:
            ids.known = {}  # the worker serves other tasks too
        yield from out(packer)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
