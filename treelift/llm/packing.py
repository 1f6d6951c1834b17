"""Packing by vector bin packing.

A sequence is a bin with three limits at once: tokens, segments and loss-bearing tokens.  The bin that is
being filled takes, of the pieces at hand that fit, the one whose demand has the largest dot product with
what the bin has left (both as shares of the limits).  When nothing fits any more, the longest piece is
cut to fill the bin exactly and its rest stays at hand, so only the last bin of a task is padded.

Each task tokenises and packs its own rows with a bounded number of pieces at hand: there is no shuffle,
and a source or text that makes up a third of the rows is spread like any other rows.  ``sequence_id``
holds the task's partition in its upper bits, so a task that is run again gives the same ids.

Token ids come from the vocabulary file, whose pre-tokeniser never joins anything over white space.  So
texts are split at spaces and newlines, and each distinct piece is encoded once per task while it stays
in a bounded memo, which goes with the task.  Texts of Latin letters are brought to lower case and parted before single marks first,
as the vocabulary does, so a word is one piece whatever its case and the mark after it.

Defined results: a null or empty text is the end token alone; rows that repeat are packed each; a null id
stays null; an empty table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: Pieces at hand in a task.
WINDOW = 192
MEMO_ENTRIES = 300_000
BLOCK_CHARS = 500_000
PUNCTUATION = string.punctuation
_BEYOND_LATIN = re.compile("[İɐ-\U0010ffff]")
#: A single mark between a letter or digit and a space; an apostrophe may belong to what follows it, and İ ends in a mark in lower case.
_MARK = re.compile(r"[,.;:!?](?<=[^\W_İ].) ")

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)
_NAMES = [part.split()[0] for part in _PIECES.split(", ")]


class _ByteLetters(dict):
    """For str.translate: a character to the letters that stand for its bytes in the vocabulary."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        letters = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        self[code] = letters
        return letters


class _Rows(dict):
    """Pieces by number; a new one gets the next and is noted in ``new``."""

    def __init__(self, rows: dict[str, int]) -> None:
        super().__init__(rows)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        row = self[piece] = len(self)
        return row


def word_pieces(text: str) -> list[str]:
    """Pieces of a text that are encoded apart; a special token is only one as it is written."""
    text = text.replace("\n", " ")
    if (text.isascii() or not _BEYOND_LATIN.search(text)) and "<|" not in text:
        text = text.lower()
    return _MARK.sub(r" \g<0>", text).split(" ")


class WordMemo:
    """Token ids of white-space separated pieces, encoded by the tokenizer when first seen."""

    def __init__(self, vocabulary: str, limit: int = MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(vocabulary)
        self.letters = _ByteLetters()
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at = _Rows({"": 0})  # piece to its row in ``parts``
        self.parts = np.zeros((1 << 12, 2), np.int32)  # rows of ``starts`` and ``lengths``; row 0 is empty
        self.known: dict[str, int] = {"": 0}  # encoded string to its row there
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        while n > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        return array

    def _encode(self, words: list[str], others: list[str]) -> None:
        """Encodes single words of lower-case Latin letters by the model alone, other strings by the whole tokenizer."""
        split, letters = self.encoder.model.tokenize, self.letters
        ids = [[t.id for t in split(w if w.isascii() else w.translate(letters))] for w in words]
        ids += [e.ids for e in self.encoder.encode_batch_fast(others, add_special_tokens=False)]
        strings = words + others
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total, n = int(lengths.sum()), len(self.known)
        self.starts = self._room(self.starts, n + len(ids))
        self.lengths = self._room(self.lengths, n + len(ids))
        self.flat = self._room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.lengths[n : n + len(ids)] = lengths
        self.starts[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.known.update(zip(strings, range(n, n + len(ids)), strict=True))

    def learn(self) -> None:
        """Encodes the pieces that ``at`` has noted; a Latin word is encoded in lower case and apart from the punctuation after it."""
        known, words = self.known, self.at.new
        self.at.new = []
        tails, others = [""] * len(words), set()
        for k in [k for k, w in enumerate(words) if not (w.isascii() and w.isalpha() and w.islower())]:
            piece = words[k]
            word = piece.rstrip(PUNCTUATION)
            if word.isalpha() and (word.isascii() or max(word) < "ɐ") and (low := word.lower()).isalpha():
                words[k], tails[k] = low, piece[len(word) :]
            else:
                others.add(piece)
        others.update(tails)
        self._encode(list(set(words).difference(known, others)), list(others.difference(known)))
        n = len(self.at) - len(words)
        self.parts = self._room(self.parts, n + len(words))
        self.parts[n : n + len(words), 0] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.parts[n : n + len(words), 1] = np.fromiter(map(known.__getitem__, tails), np.int32, len(tails))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, with the end token."""
        if len(self.at) > self.limit:
            self.clear()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            pieces += word_pieces(text)
            ends[k + 1] = len(pieces)
        rows = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        if self.at.new:
            self.learn()
        parts = self.parts[rows].reshape(-1)
        lengths = self.lengths[parts].astype(np.int64)
        reach = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(self.starts[parts] - reach[:-1], lengths) + np.arange(reach[-1])
        ids = self.flat[gather]
        cut = reach[2 * ends]
        end = np.array([END_ID], np.int32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class Packer:
    """Fills one bin after another from the pieces at hand."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int, window: int = WINDOW) -> None:
        self.limits = np.array(limits, np.int64)
        self.sequence = first_sequence
        self.window = window
        self.items: list[list] = [[]] * (window + 1)
        self.demand = np.zeros((window + 1, 3), np.int64)
        self.demand[:, 1] = 1
        self.alive = np.zeros(window + 1, bool)
        self.out: list[tuple] = []

    @staticmethod
    def _loss(mask: np.ndarray | None, start: int, stop: int) -> int:
        return stop - start if mask is None else int(mask[start:stop].sum())

    def _longest(self, mask: np.ndarray | None, start: int, stop: int, left: np.ndarray) -> int:
        """End of the longest part from start that the limits allow."""
        stop = min(stop, start + int(left[0]))
        if mask is None:
            return min(stop, start + int(left[2]))
        return start + int(np.searchsorted(np.cumsum(mask[start:stop]), left[2], side="right"))

    def _emit(self, doc_id, ids: np.ndarray, mask, start: int, stop: int, offset: int) -> None:
        crc = zlib.crc32(ids[start:stop].astype("<u4").tobytes())
        self.out.append(
            (doc_id, start, stop - start, crc, len(ids), self.sequence, offset, self._loss(mask, start, stop))
        )

    def add(self, doc_id, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        start = 0
        while len(ids) - start >= self.limits[0] or self._loss(mask, start, len(ids)) > self.limits[2]:
            stop = self._longest(mask, start, len(ids), self.limits)
            self._emit(doc_id, ids, mask, start, stop, 0)
            self.sequence += 1
            start = stop
        if start < len(ids):
            k = int(np.argmin(self.alive))
            self.items[k] = [doc_id, ids, mask, start]
            self.demand[k] = len(ids) - start, 1, self._loss(mask, start, len(ids))
            self.alive[k] = True
            if self.alive.sum() > self.window:
                while self.alive.sum() > self.window // 2:
                    self._fill()

    def _fill(self) -> None:
        left, offset = self.limits.copy(), 0
        share = self.demand / self.limits
        while self.alive.any():
            fits = self.alive & (self.demand <= left).all(1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (left / self.limits), -1.0)))
            doc_id, ids, mask, start = self.items[k]
            self._emit(doc_id, ids, mask, start, len(ids), offset)
            offset += len(ids) - start
            left -= self.demand[k]
            self.alive[k] = False
            self.items[k] = []
        if left[0] and left[1] and self.alive.any():
            k = int(np.argmax(np.where(self.alive, self.demand[:, 0], -1)))
            doc_id, ids, mask, start = self.items[k]
            stop = self._longest(mask, start, len(ids), left)
            if stop > start:
                self._emit(doc_id, ids, mask, start, stop, offset)
                self.items[k][3] = stop
                self.demand[k] = len(ids) - stop, 1, self._loss(mask, stop, len(ids))
        self.sequence += 1

    def finish(self) -> None:
        while self.alive.any():
            self._fill()

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * len(_NAMES)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def _pack_texts(vocabulary: str, limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = WordMemo(vocabulary)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars < BLOCK_CHARS):
                    chars += len(texts[stop] or "")
                    stop += 1
                block = memo.encode([t or "" for t in texts[at:stop]])
                for doc_id, tokens in zip(ids[at:stop], block, strict=True):
                    packer.add(doc_id, tokens)
                at = stop
            yield packer.take()
        packer.finish()
        yield packer.take()

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS),
) -> DataFrame:
    """One row per piece of a document's token ids, all of them loss-bearing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pack_texts(vocabulary, limits), _PIECES)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS)) -> DataFrame:
    """Packs examples that are tokens already: doc_id, ids array<int>, loss array<boolean> as long as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, ids, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(doc_id, np.array(ids or [], np.int32), np.array(loss or [], bool))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return examples.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "loss").mapInArrow(run, _PIECES)
