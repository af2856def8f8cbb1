"""Token counts by finite-state transducers whose transitions carry emitted-token counts.

Two machines are compiled from the tokenizer's JSON file.

* The *splitter* reads character classes and marks where pre-tokens begin. It has twelve states,
  so a chunk of text is a map state -> state. The maps of all chunks of a batch advance together,
  one column of characters per step, and a prefix scan by doubling composes them; after it every
  chunk knows its first state and all chunks mark their boundaries side by side.
* The *merger* reads the bytes of a pre-token. Its state is what byte-pair merging can still see:
  the longest suffix that begins a vocabulary entry, with the last token of every prefix in that
  window. A transition's count says how many tokens more the longer prefix has. Transitions are
  compiled when first met.

Byte-pair merging has two properties that make the merger exact: every leading part of an encoding
is the encoding of its own bytes, and a sequence of tokens is an encoding if every neighbouring
pair is one. So the last token of a prefix is the only suffix that merging leaves whole beside the
last token before it.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import DataFrame

from .batches import annotate

# Character classes of the splitter (the letters are those of the contractions).
_CLASSES = ["end", "apostrophe", "s t m d", "r v", "l", "e", "letter", "number", "space", "blank", "other"]
END, APOS, STMD, RV, LL, EE, LETTER, NUMBER, SPACE, BLANK, OTHER = range(len(_CLASSES))
# States: nothing open, in letters, in numbers, in other signs, one space, more blanks that end in a
# space, one other blank, more that end in another blank, apostrophe first in its pre-token,
# apostrophe + r or v (an "e" may complete it), apostrophe + l (an "l" may).
_STATES = ["open", "letters", "numbers", "signs", "space", "..space", "blank", "..blank", "'", "'r", "'l"]
OPEN, IN_L, IN_N, IN_P, SP1, SPN, BL1, BLN, AP, AP_RV, AP_L = range(len(_STATES))
# Emitted marks: a pre-token begins here, one character back.
HERE, BACK = 1, 2


def _fresh(c: int) -> tuple[int, int]:
    """State and mark for a character that begins a pre-token."""
    if c == END:
        return OPEN, 0
    state = {APOS: AP, NUMBER: IN_N, SPACE: SP1, BLANK: BL1, OTHER: IN_P}.get(c, IN_L)
    return state, HERE


def _step(state: int, c: int) -> tuple[int, int]:
    letter = c in (STMD, RV, LL, EE, LETTER)
    if state == OPEN:
        return _fresh(c)
    if state == IN_L:
        return (IN_L, 0) if letter else _fresh(c)
    if state == IN_N:
        return (IN_N, 0) if c == NUMBER else _fresh(c)
    if state == IN_P:
        return (IN_P, 0) if c in (OTHER, APOS) else _fresh(c)
    if state in (SP1, SPN, BL1, BLN):
        if c == SPACE:
            return SPN, 0
        if c == BLANK:
            return BLN, 0
        if c == END:
            return OPEN, 0
        # A visible character: the last blank leaves a longer run; a space joins the character.
        back = BACK if state in (SPN, BLN) else 0
        if state in (SP1, SPN):
            return (IN_L if letter else IN_N if c == NUMBER else IN_P), back
        following, mark = _fresh(c)
        return following, mark | back
    if state == AP:
        if c == STMD:
            return OPEN, 0
        if c == RV:
            return AP_RV, 0
        if c == LL:
            return AP_L, 0
        return (IN_P, 0) if c in (OTHER, APOS) else _fresh(c)
    # After 'r 'v or 'l: a contraction, or the apostrophe alone with a word behind it.
    if c == (EE if state == AP_RV else LL):
        return OPEN, 0
    following, mark = _step(IN_L, c)
    return following, mark | BACK


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks, indexed by state * classes + class."""
    both = [_step(s, c) for s in range(len(_STATES)) for c in range(len(_CLASSES))]
    return np.array([x[0] for x in both], np.uint8), np.array([x[1] for x in both], np.uint8)


@functools.lru_cache(maxsize=1)
def character_classes() -> bytes:
    """Class of every code point, as the tokenizer library's own expressions see it."""
    from tokenizers import Regex, normalizers

    mark = "\ue000"  # of private use, so in none of the classes
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != ord(mark)], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        seen = normalizers.Replace(Regex(pattern), mark).normalize_str(every)
        table[points[np.frombuffer(seen.encode("utf-32-le"), "<u4") == ord(mark)]] = kind
    for letters, kind in (("stmd", STMD), ("rv", RV), ("l", LL), ("e", EE), ("'", APOS), (" ", SPACE)):
        table[[ord(x) for x in letters]] = kind
    return table.tobytes()


class Splitter:
    def __init__(self, classes: bytes, chunk: int = 256):
        self.classes = np.frombuffer(classes, np.uint8)
        self.next, self.marks = _tables()
        self.chunk = chunk
        # Four steps in one, for the maps: indexed by state * classes ** 4 + the four classes.
        n = len(_CLASSES)
        state = np.repeat(np.arange(len(_STATES), dtype=np.uint8), n**4)
        four = np.tile(np.arange(n**4), len(_STATES))
        for power in (3, 2, 1, 0):
            state = self.next[state * np.uint8(n) + (four // n**power % n).astype(np.uint8)]
        self.four = state

    def begins(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Where a pre-token begins; ``ends`` are places of characters that end a text."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n, c = len(points), len(_CLASSES)
        rows = -(-n // self.chunk)
        kinds = np.zeros(rows * self.chunk, np.uint8)  # class END behind the last text
        kinds[:n] = self.classes[points]
        kinds[ends] = END
        columns = np.ascontiguousarray(kinds.reshape(rows, self.chunk).T)
        maps = np.tile(np.arange(len(_STATES), dtype=np.uint8), (rows, 1))
        for i in range(0, self.chunk, 4):
            a, b, d, e = (x.astype(np.intp) for x in columns[i : i + 4])
            maps = self.four.take(maps * np.intp(c**4) + (((a * c + b) * c + d) * c + e)[:, None])
        reach = 1
        while reach < rows:  # chunk i gets the map of chunks i - 2 * reach + 1 .. i
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
            reach *= 2
        states = np.concatenate(([OPEN], maps[:-1, OPEN])).astype(np.uint8)
        marks = np.empty_like(columns)
        for i, column in enumerate(columns):
            at = (states * np.uint8(c) + column).astype(np.intp)
            marks[i], states = self.marks.take(at), self.next.take(at)
        marks = marks.T.reshape(-1)
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BACK).astype(bool)
        return begins[:n]


_SINGLE = (b"", b"", -1)


class Merger:
    """Counts of byte-pair encodings; states and transitions are compiled as they are met."""

    #: Transitions and states kept; beyond it compiling begins again. Counts do not depend on it.
    MOST = 250_000

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.vocabulary, self.ranks = vocabulary, ranks
        self.begins = {t[:i] for t in vocabulary for i in range(len(t))}
        self.splits: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), rank in ranks.items():
            self.splits.setdefault(a + b, (a, b, rank))
        self._whole: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is (window of bytes, last token and count of each prefix in the window, relative to now).
        self.states = [(b"", (b"",), (0,))]
        self.ids = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """Byte-pair merging as the definition has it, for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        whole = self._whole.get(token)
        if whole is None:
            whole = self._whole[token] = self.merge(token) == [token]
        if not whole or not before:
            return whole
        # Undo the later of the two tokens' last merges, again and again. Their inner ends must not
        # have merged before that: a pair of equal rank further left goes first.
        limit = 1 << 60
        while True:
            if self.ranks.get((before, token), limit) < limit:
                return False
            _, right, left_rank = self.splits.get(before, _SINGLE)
            left, _, right_rank = self.splits.get(token, _SINGLE)
            if left_rank > right_rank:
                before, limit = right, left_rank
            elif right_rank >= 0:
                token, limit = left, right_rank + 1
            else:
                return True

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        window, lasts, counts = self.states[state]
        longer = window + bytes((byte,))
        for length in range(len(longer), 0, -1):
            token = longer[-length:]
            if token in self.vocabulary and self._follows(lasts[-length], token):
                break
        else:
            raise ValueError(f"byte {byte} has no entry in the vocabulary")
        delta = counts[-length] + 1
        size = len(longer)
        while longer[len(longer) - size :] not in self.begins:
            size -= 1
        lasts = (*lasts, token)[-size - 1 :]
        counts = tuple([x - delta for x in (*counts, delta)[-size - 1 :]])
        key = (longer[len(longer) - size :], lasts, counts)
        if (following := self.ids.get(key)) is None:
            following = self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = (following, delta)
        return following, delta

    def count(self, word: bytes) -> int:
        if len(self.moves) >= self.MOST:
            self._reset()
        state = total = 0
        moves = self.moves
        for byte in word:
            move = moves.get(state << 8 | byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return total


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: visible Latin-1 characters stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCounts(dict):
    """Pre-token -> tokens, filled by the merger."""

    MOST, LONGEST = 300_000, 64

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word.encode())
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    def __init__(self, tokenizer: str, classes: bytes):
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level tokenizers without normalizer are compiled")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.splitter = Splitter(classes)
        self.words = WordCounts(Merger(vocabulary, ranks))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token."""
        totals = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.special:
                parts = [y for x in parts for y in x.split(special)]
            totals[i] = len(parts) - 1
            pieces += parts
            owners += [i] * len(parts)
        if not pieces:
            return totals
        stream = "\0".join(pieces) + "\0"
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        begins = self.splitter.begins(stream, ends)
        starts = np.nonzero(begins)[0]
        if not len(starts):
            return totals
        owner = np.searchsorted(ends, starts)
        stops = np.minimum(np.append(starts[1:], len(stream)), ends[owner])
        words = [stream[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return totals + np.bincount(np.asarray(owners)[owner], weights=counts, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _counter(tokenizer: str, classes: bytes) -> TokenCounter:
    return TokenCounter(tokenizer, classes)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", keep=None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor has. A null text
    counts as the empty one, with zero tokens; repeated rows are counted each; columns of ``docs``
    with the names of the added ones are replaced. No shuffle: one pass over the texts.
    """
    classes = docs.sparkSession.sparkContext.broadcast(character_classes())  # one byte per code point

    def factory():
        counter = _counter(tokenizer, classes.value)

        def compute(texts: list[bytes]):
            n = counter.count([t.decode("utf-8", "replace") for t in texts])
            return [np.fromiter(map(len, texts), np.int64, len(texts)), n, n > limit]

        return compute

    return annotate(docs, factory, "n_bytes long, n_tokens long, over_limit boolean", text=text, keep=keep, slice_bytes=1 << 20)
