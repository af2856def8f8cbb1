"""Toxicity: a bag of subword embeddings, averaged, and a linear softmax, learnt together in numpy.

A word is the lower-case text between blanks without the punctuation around it. It stands for itself
and its 3- to 5-grams (with marks for its ends), all hashed into one table of vectors. A misspelling
that the model never saw shares most of its n-grams with the word it comes from.

One insult in a long text would vanish in a mean over all of it. So the mean and the softmax are
taken over windows of words that overlap by half and cover the whole text, and the most toxic window
speaks for the text. Learning does the same: the worst windows of both classes are learnt from, chosen
anew in every epoch.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32 as _hash

import numpy as np
from pyspark.sql import DataFrame

from .batches import annotate
from .labelled import Sample, sample

_AROUND = bytes(range(33, 48)) + b":;<=>?@[]^_`{|}~\\"

#: Words of a window.
WINDOW = 32


@dataclass
class Model:
    """``values``: what each bucket adds to the log-odds of label 1; ``buckets`` is their number."""

    values: np.ndarray
    bias: float
    known: np.ndarray | None = None  # buckets that took part in learning; others are as if not there


def subwords(word: bytes, buckets: int) -> list[int]:
    """Buckets of a word: itself and its 3- to 5-grams, by bytes."""
    core = b"<%b>" % (word.lower().strip(_AROUND) or word)
    grams = {core[i : i + n] for n in (3, 4, 5) for i in range(len(core) - n + 1)}
    grams.add(core)
    return [_hash(g) % buckets for g in grams]


def window_sums(words: np.ndarray) -> np.ndarray:
    """Sums over the windows of a text, WINDOW words each, every WINDOW / 2 words; a short text is one window."""
    total = np.concatenate(([0], np.cumsum(words)))
    first = np.arange(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)
    return total[np.minimum(first + WINDOW, len(words))] - total[first]


def _worst(sums: np.ndarray) -> tuple[float, int]:
    """Largest mean of a text's windows, and which window has it. The imaginary part counts subwords."""
    means = sums.real / np.maximum(sums.imag, 1)
    at = int(means.argmax())
    return float(means[at]), at


def _calibrate(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Scale, shift and loss of the logistic curve through (z, y), by damped Newton steps."""
    x = np.stack([z, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        # Labels drawn in a little, so that the curve keeps a finite slope when the classes part cleanly.
        g = x.T @ (w * (p - (0.98 * y + 0.01)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        beta -= np.clip(np.linalg.solve(h, g), -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-6, 1 - 1e-6)
    return float(beta[0]), float(beta[1]), float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())


class _Texts:
    """Training texts as numbers of words, and the buckets of every word."""

    def __init__(self, texts: list[bytes], buckets: int):
        numbers: dict[bytes, int] = {}
        self.texts = [
            np.fromiter((numbers.setdefault(w, len(numbers)) for w in t.split()), np.int64) for t in texts
        ]
        self.words = [np.array(subwords(w, buckets), np.int64) for w in numbers]

    def holders(self, rows: np.ndarray, buckets: int) -> np.ndarray:
        """How many of the texts hold each bucket."""
        n = np.zeros(buckets, np.int64)
        for r in rows:
            if len(self.texts[r]):
                n[np.unique(np.concatenate([self.words[w] for w in np.unique(self.texts[r])]))] += 1
        return n

    def keep(self, seen: np.ndarray) -> None:
        self.words = [w[seen[w]] for w in self.words]
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int64)])
        self.owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        self.sizes = np.bincount(self.owner, minlength=len(self.words))

    def sums(self, values: np.ndarray) -> list[np.ndarray]:
        """Window sums of each text under ``values`` of the buckets."""
        by_word = np.bincount(self.owner, weights=values[self.flat], minlength=len(self.words)) + 1j * self.sizes
        return [window_sums(by_word[t]) for t in self.texts]

    def window(self, row: int, at: int) -> np.ndarray:
        words = self.texts[row][at * (WINDOW // 2) : at * (WINDOW // 2) + WINDOW]
        return np.concatenate([*(self.words[w] for w in words), np.zeros(0, np.int64)])


def learn(
    data: Sample, buckets: int = 1 << 17, width: int = 8, epochs: int = 10, rate: float = 0.01, seed: int = 3,
    least: int = 3, shrink: float = 4.0, decay: float = 1e-4,
) -> Model:
    """Embeddings and softmax by Adam on batches of 64 windows. One class only, or none, gives a constant.

    The first coordinate of an embedding starts at the smoothed log ratio of the classes' shares of
    texts that hold the bucket, the others at small random numbers. Buckets of fewer than ``least``
    texts are left out: they would be learnt by heart. Every fifth text of a class is not learnt
    from: these choose the epoch and give the curve from window means to a probability.
    """
    y = np.asarray(data.labels)
    if len(set(data.labels)) < 2:
        return Model(np.zeros(buckets, np.float32), -20.0 if not len(y) or y[0] == 0 else 20.0)
    random = np.random.default_rng(seed)
    weights = np.asarray(data.weights, np.float64)
    texts = _Texts(data.texts, buckets)
    place = np.zeros(len(y), int)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    check = place % 5 == 4 if min(np.bincount(y)) >= 10 else np.ones(len(y), bool)
    fit = ~check if check.sum() < len(y) else check
    holds = [texts.holders(np.nonzero(fit & (y == k))[0], buckets) for k in (0, 1)]
    n0, n1 = ((fit & (y == k)).sum() for k in (0, 1))
    both = holds[0] + holds[1]
    texts.keep(both >= least)
    ratio = np.log((holds[1] + 1) / (n1 + 2)) - np.log((holds[0] + 1) / (n0 + 2))
    table = (random.standard_normal((buckets, width)) * 0.02).astype(np.float32)
    table[:, 0] = ratio * both / (both + shrink)
    out = (random.standard_normal((width, 2)) * 0.1).astype(np.float32)
    out[0] = (-2.0, 2.0)
    bias = np.zeros(2, np.float32)
    moments = [np.zeros_like(x) for x in (table, table, out, out, bias, bias)]
    best, step = None, 0
    train = np.nonzero(fit)[0]
    for _ in range(epochs + 1):
        values = table @ (out[:, 1] - out[:, 0])
        sums = texts.sums(values)
        z = np.array([_worst(s)[0] for s in sums])
        scale, shift, loss = _calibrate(z[check], y[check], weights[check])
        if best is None or loss < best[0]:
            best = (loss, Model((values * scale).astype(np.float32), shift, both >= least))
        # The worst window of each text; of texts of class 0 also one at random.
        chosen = [(r, _worst(sums[r])[1]) for r in train]
        chosen += [(r, int(random.integers(len(sums[r])))) for r in train if y[r] == 0]
        order = random.permutation(len(chosen))
        for begin in range(0, len(order), 64):
            step += 1
            picked = [chosen[i] for i in order[begin : begin + 64]]
            rows = np.array([r for r, _ in picked])
            bags = [texts.window(r, at) for r, at in picked]
            sizes = np.array([len(b) for b in bags])
            used, inverse = np.unique(np.concatenate(bags), return_inverse=True)
            mix = np.zeros((len(rows), len(used)), np.float32)  # the batch's bags over the buckets it uses
            np.add.at(mix, (np.repeat(np.arange(len(rows)), sizes), inverse), np.repeat(1 / np.maximum(1, sizes), sizes))
            hidden = mix @ table[used]
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p = (p * weights[rows, None] / len(rows)).astype(np.float32)
            gradients = (mix.T @ (p @ out.T) + decay * table[used], hidden.T @ p, p.sum(0))
            for k, (x, g) in enumerate(zip((table, out, bias), gradients)):
                at = used if k == 0 else slice(None)
                m, v = moments[2 * k], moments[2 * k + 1]
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                x[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
    # A mean of vectors before a linear layer is a mean of numbers behind it.
    return best[1]


_STEP = np.array([_hash(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def subwords_of_all(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, places in ``words``) of what ``subwords`` gives for words that are lower-case cores already.

    The checksums of all grams advance together, byte by byte. A gram that occurs before in its word is
    left out; equal longer grams begin with equal short ones, so only those are compared.
    """
    marked = [b"<%b>" % w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer(b"".join(marked) + bytes(4), np.uint8)
    total = len(flat) - 4
    owner = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    short = flat[:total].astype(np.uint32) | flat[1 : total + 1].astype(np.uint32) << 8 | flat[2 : total + 2].astype(np.uint32) << 16
    again = {n: np.zeros(total, bool) for n in (3, 4, 5)}
    here, shift = np.nonzero((left >= 3) & (place >= 1))[0], 1
    while len(here):
        same = here[short[here] == short[here - shift]]
        for n in (3, 4, 5):
            if n > 3:
                same = same[(left[same] >= n) & (flat[same + n - 1] == flat[same - shift + n - 1])]
            again[n][same] = True
        shift += 1
        here = here[place[here] >= shift]
    state = np.full(total, 0xFFFFFFFF, np.uint32)
    found, owners = [], []
    for n in range(1, 6):
        state = _STEP[(state ^ flat[n - 1 : n - 1 + total]) & 0xFF] ^ (state >> 8)
        if n >= 3:
            at = np.nonzero((left >= n) & ~again[n])[0]
            found.append((state[at] ^ 0xFFFFFFFF).astype(np.int64) % buckets)
            owners.append(owner[at])
    # A word of up to five bytes, marks included, is one of its own grams.
    whole = np.nonzero(sizes > 5)[0]
    found.append(np.fromiter((_hash(marked[i]) for i in whole), np.int64, len(whole)) % buckets)
    owners.append(whole)
    return np.concatenate(found), np.concatenate(owners)


class _Words:
    """Word -> (sum of its buckets' values, number of its buckets), as a complex number."""

    MOST, LONGEST, TOGETHER = 300_000, 64, 1 << 15

    def __init__(self, model: Model):
        known = np.ones(len(model.values), bool) if model.known is None else model.known
        self.values, self.counts = np.where(known, model.values, 0).astype(float), known.astype(float)
        self.words: dict[bytes, complex] = {}
        self.cores: dict[bytes, complex] = {}

    def lookup(self, words: set[bytes]) -> dict[bytes, complex]:
        """A table that holds all of ``words``. What it keeps is a cache: cleared when full, without effect on results."""
        if len(self.words) > self.MOST:
            self.words.clear()
        if len(self.cores) > self.MOST:
            self.cores.clear()
        new = [w for w in words if w not in self.words]
        cores = [w.lower().strip(_AROUND) or w.lower() for w in new]
        unseen = [c for c in set(cores) if c not in self.cores]
        for i in range(0, len(unseen), self.TOGETHER):
            part = unseen[i : i + self.TOGETHER]
            at, owner = subwords_of_all(part, len(self.values))
            sums = np.bincount(owner, self.values[at], len(part)) + 1j * np.bincount(owner, self.counts[at], len(part))
            self.cores.update(zip(part, sums.tolist()))
        self.words.update(zip(new, map(self.cores.__getitem__, cores)))
        return self.words

    def forget_long(self, words: set[bytes]) -> None:
        for w in words:
            if len(w) > self.LONGEST:
                self.words.pop(w, None)
                self.cores.pop(w.lower().strip(_AROUND) or w.lower(), None)


def scorer(model: Model):
    """Function from UTF-8 texts to probabilities of label 1."""
    words = _Words(model)

    def score(texts: list[bytes]) -> np.ndarray:
        z = np.empty(len(texts))
        split = [t.split() for t in texts]
        every = set().union(*split)
        value = words.lookup(every).__getitem__
        for i, own in enumerate(split):
            z[i] = model.bias + _worst(window_sums(np.fromiter(map(value, own), complex, len(own))))[0]
        words.forget_long(every)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from the bounded sample of ``labelled.sample``."""
    return learn(sample(docs, labels, label))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, keep=None, accept=None) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold``) to every row.

    Null and empty texts get the model's prior. Columns with the added names are replaced. With
    ``accept`` (a function of the scores) rows are filtered instead, columns as they were. The model
    goes out by broadcast: ``buckets`` numbers, whatever the corpus.
    """
    return _scored(docs, model, scorer, threshold, keep, accept)


def _scored(docs, model, make, threshold, keep, accept):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        score = make(sent.value)

        def compute(texts):
            s = score(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return compute

    return annotate(
        docs, factory, "score double, predicted int", keep=keep, accept=accept and (lambda made: accept(made[0]))
    )
