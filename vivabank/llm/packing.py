"""Packing of token streams into sequences, in order, by dynamic programming over window cuts.

The documents of a partition are one stream of tokens. A window may be cut behind a document, behind
a sentence, or, at a higher price, inside one. The cost of a window that ends at cut ``j`` is its
padding plus the price of ``j``:

    cost(j) = min over i, length(i..j) <= size, of cost(i) + size - (pos(j) - pos(i)) + price(j)

The part that depends on ``i`` is ``cost(i) + pos(i)``, so the minimum over the sliding range of ``i``
is the head of a monotone queue. Windows whose length is a power of two need no padding; those are
looked up by position. No shuffle: a partition is packed as it streams by, about ``BLOCK`` tokens at
a time, and what lies behind the block's best last cut begins the next block.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import slices, utf8
from .token_counts import byte_alphabet

#: Tokens packed at once.
BLOCK = 1 << 18
#: Prices in tokens of padding: behind a document, behind a sentence, inside a sentence; and of a window.
DOCUMENT, SENTENCE, INSIDE, WINDOW = 0, 8, 64, 1
#: Inside long sentences a cut is possible every so many tokens.
STRIDE = 64


def cuts(size: int, places: np.ndarray, prices: np.ndarray, last: bool) -> list[int]:
    """Best cuts: positions that end windows, among ``places`` (ascending, behind position 0).

    With ``last`` the final place ends a window; otherwise the best place within ``size`` of it does.
    """
    every = np.concatenate(([0], places))
    pos, price = every.tolist(), [0, *(prices + WINDOW).tolist()]
    first = np.searchsorted(every, every - size).tolist()
    # Windows of a power of two need no padding: for each place those that lie so far in front of it.
    even: list[list[int]] = [[] for _ in pos]
    for power in (1 << k for k in range(8, 31) if 1 << k < size):
        at = np.searchsorted(every, every - power)
        hit = np.nonzero(every[at] == every - power)[0]
        for j, k in zip(hit.tolist(), at[hit].tolist()):
            even[j].append(k)
    key, back = [0] * len(pos), [0] * len(pos)  # cost(i) + pos(i)
    queue: deque[int] = deque([0])  # places of rising key
    for j in range(1, len(pos)):
        here, low = pos[j], first[j]
        while queue[0] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - here
        for k in even[j]:
            if key[k] - pos[k] < best:
                best, i = key[k] - pos[k], k
        own = best + price[j] + here
        key[j], back[j] = own, i
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    j = len(pos) - 1
    if not last:
        j = min((k for k in range(1, len(pos)) if pos[k] > pos[-1] - size), key=lambda k: (key[k] - pos[k], -k))
    found = []
    while j:
        found.append(pos[j])
        j = back[j]
    return found[::-1]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places where a window may end, with their prices."""
    natural = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(natural, prepend=0)
    more = np.maximum(0, (gaps - 1) // STRIDE)
    inside = np.repeat(natural - gaps, more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.union1d(natural, inside)
    prices = np.full(len(places), INSIDE)
    prices[np.searchsorted(places, sentence_ends)] = SENTENCE
    prices[np.searchsorted(places, doc_ends)] = DOCUMENT
    return places, prices


def _halved(size: int, ends: list[int]) -> list[int]:
    """A last window far from full, as windows of powers of two where that wastes less."""
    begin = ends[-2] if len(ends) > 1 else 0
    rest = ends[-1] - begin
    if rest & (rest - 1) and (bin(rest).count("1") - 1) * (INSIDE + WINDOW) < size - rest:
        ends = ends[:-1]
        for k in reversed(range(rest.bit_length())):
            if rest >> k & 1:
                begin += 1 << k
                ends.append(begin)
    return ends


# Letters whose lower case is all there is to normalising them, and signs that are one token's text behind them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_SIGNS = b".,!?;:*%&$#"
_CHARACTERS = {b: c for c, b in byte_alphabet().items()}


class WordIds(dict):
    """Text between blanks -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its parts. It
    lower-cases and parts letters from other signs. So a new word of plain letters, with or without
    signs behind it, goes to the merges at once; any other word takes the tokenizer's whole way.
    """

    MOST, LONGEST = 600_000, 64

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and t[:-4].rstrip("\"')")[-1:] in tuple(".!?")]
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_sentence[ends] = True
        self.stems: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        stem = low.rstrip(_SIGNS)
        made = self.stems.get(stem) or (self._stem(stem) if _PLAIN(stem) else None)
        if made is None:
            made = self._ask(word)
        elif len(stem) < len(low):
            tail = low[len(stem) :]
            behind = self.stems.get(tail) or self._ask(tail)
            if len(tail) <= self.LONGEST:
                self.stems[tail] = behind
            made += behind
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = made
        return made

    def _stem(self, stem: bytes) -> bytes:
        """Ids of a word of plain letters."""
        # Letters of U+00DF to U+00FF are two bytes, each of them a character of the vocabulary.
        text = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(_CHARACTERS)
        ids = [t.id for t in self.model.tokenize(text)]
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(stem) <= self.LONGEST:
            if len(self.stems) >= self.MOST // 2:
                self.stems.clear()
            self.stems[stem] = made
        return made

    def _ask(self, word: bytes) -> bytes:
        made = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0]
        return np.asarray(made.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Takes documents in order and gives pieces; holds about one block of tokens."""

    def __init__(self, size: int, first: int, ends_sentence: np.ndarray):
        self.size, self.sequence, self.ends_sentence = size, first, ends_sentence
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece that is decided."""
        if not self.tokens:
            return []
        stream = np.concatenate([x[2] for x in self.waiting])
        doc_ends = np.cumsum([len(x[2]) for x in self.waiting])
        known = np.minimum(stream, len(self.ends_sentence) - 1)
        places, prices = candidates(doc_ends, np.nonzero(self.ends_sentence[known])[0] + 1)
        ends = cuts(self.size, places, prices, last)
        if last:
            ends = _halved(self.size, ends)
        done = ends[-1]
        breaks = np.union1d(ends, doc_ends[doc_ends < done])
        begins = np.concatenate(([0], breaks[:-1]))
        window = np.searchsorted(ends, begins, "right")
        window_begin = np.concatenate(([0], ends[:-1]))[window]
        owner = np.searchsorted(doc_ends, begins, "right")
        doc_begin = np.concatenate(([0], doc_ends[:-1]))
        pieces = []
        for a, b, w, wb, o in zip(begins.tolist(), breaks.tolist(), window.tolist(), window_begin.tolist(), owner.tolist()):
            doc_id, start, _, total = self.waiting[o]
            pieces.append((doc_id, start + a - int(doc_begin[o]), b - a, stream[a:b].tobytes(), total, self.sequence + w, a - wb))
        self.sequence += len(ends)
        rest = int(np.searchsorted(doc_ends, done, "right"))
        waiting = self.waiting[rest:]
        if waiting and done > doc_begin[rest]:
            doc_id, start, ids, total = waiting[0]
            skip = done - int(doc_begin[rest])
            waiting[0] = (doc_id, start + skip, ids[skip:], total)
        self.waiting, self.tokens = waiting, len(stream) - done
        return pieces


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row per piece (``PIECES``; ``ids`` are little-endian unsigned 32-bit numbers).

    Each document is its ids by the tokenizer file at ``tokenizer`` plus ``end_id``; a null or empty
    text is ``end_id`` alone. Repeated rows are packed each. Columns other than ``doc_id`` and ``text``
    are not read. Order is that of the rows in a partition; sequence ids are unique, not dense.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << 33, words.ends_sentence)
        end = np.array([end_id], "<u4").tobytes()

        def rows(last: bool) -> pa.RecordBatch:
            columns = list(zip(*packer.pack(last))) or [[]] * len(names)
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for start, length in slices(batch.column(1), 1 << 20):
                part = batch.slice(start, length)
                for doc_id, ids in zip(part.column(0).to_pylist(), words.ids(utf8(part.column(1)))):
                    packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                    if packer.tokens >= BLOCK:
                        yield rows(False)
        if packer.tokens:
            yield rows(True)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
