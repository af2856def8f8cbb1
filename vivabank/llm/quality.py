"""Quality: a convolution over bytes, in numpy.

A text is cut into chunks that overlap by the filters' width less one, so every window of bytes lies
in exactly one chunk. Filters over byte embeddings give a response at each place; each filter keeps
its largest response in the chunk (rectified). The chunk's values go through a hidden layer; the mean over chunks,
weighted by their bytes, gives one probability for the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .labelled import Sample, sample
from .toxicity import _scored

WIDTH, CHUNK = 6, 256


@dataclass
class Model:
    embedding: np.ndarray  # (256, e)
    filters: np.ndarray  # (WIDTH, e, f)
    shift: np.ndarray  # (f,)
    hidden: np.ndarray  # (f, h)
    hidden_shift: np.ndarray  # (h,)
    out: np.ndarray  # (h,)
    bias: np.ndarray  # (1,)


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of CHUNK windows (one row of bytes each) and the windows in each; short texts are padded with zeros."""
    n = max(1, len(text) - WIDTH + 1)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK + WIDTH - 1, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::CHUNK]
    sizes = np.full(rows, CHUNK)
    sizes[-1] = n - (rows - 1) * CHUNK
    return view, sizes


def pair_tables(model: Model) -> list[np.ndarray]:
    """For each two neighbouring bytes of the window: what the pair adds to every filter."""
    single = [model.embedding @ w for w in model.filters]
    return [
        np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1), dtype=np.float32)
        for a, b in zip(single[::2], single[1::2])
    ]


def responses(tables: list[np.ndarray], rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk and where it is."""
    pairs = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
    made = None
    for k, table in enumerate(tables):
        part = table.take(pairs[:, 2 * k : 2 * k + CHUNK], axis=0)
        made = part if made is None else np.add(made, part, out=made)
    for row in np.nonzero(sizes < CHUNK)[0]:
        made[row, sizes[row] :] = -np.inf
    where = made.argmax(1)
    return np.take_along_axis(made, where[:, None, :], 1)[:, 0], where


def _best(tables: list[np.ndarray], rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``responses``, without the places."""
    pairs = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
    made = tables[0].take(pairs[:, :CHUNK], axis=0)
    for k in range(1, len(tables)):
        made += tables[k].take(pairs[:, 2 * k : 2 * k + CHUNK], axis=0)
    for row in np.nonzero(sizes < CHUNK)[0]:
        made[row, sizes[row] :] = -np.inf
    return made.max(1)


def _combine(model: Model, best: np.ndarray, sizes: np.ndarray, first: np.ndarray):
    """Log-odds of texts whose chunks begin at ``first``; with the layers' values for the gradients."""
    a = np.maximum(best + model.shift, 0)
    h = np.maximum(a @ model.hidden + model.hidden_shift, 0)
    share = sizes / np.repeat(np.add.reduceat(sizes, first), np.diff([*first, len(sizes)]))
    mean = np.add.reduceat(h * share[:, None], first, axis=0)
    return mean @ model.out + model.bias[0], a, h, share, mean


def learn(data: Sample, e: int = 8, f: int = 16, h: int = 16, epochs: int = 10, rate: float = 0.01, seed: int = 5) -> Model:
    """All layers by Adam on batches of 16 texts. One class only, or none, gives a constant."""
    random = np.random.default_rng(seed)
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    model = Model(
        draw(256, e, scale=0.5), draw(WIDTH, e, f, scale=0.3), np.zeros(f, np.float32), draw(f, h, scale=0.3),
        np.zeros(h, np.float32), draw(h, scale=0.3), np.zeros(1, np.float32),
    )
    y = np.asarray(data.labels, np.float32)
    if len(set(data.labels)) < 2:
        model.out[:] = 0
        model.bias[:] = -20 if len(y) and y[0] == 0 else 20
        return model
    weights = np.asarray(data.weights, np.float32)
    cut = [chunks(t) for t in data.texts]
    names = list(vars(model))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(model).items()}
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(cut))
        for begin in range(0, len(order), 16):
            rows = order[begin : begin + 16]
            step += 1
            bytes_, sizes = np.concatenate([cut[r][0] for r in rows]), np.concatenate([cut[r][1] for r in rows])
            lengths = np.array([len(cut[r][1]) for r in rows])
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            # Single-byte tables: pair tables would have to be made anew for every batch.
            singles = [model.embedding @ w for w in model.filters]
            made = sum(t[bytes_[:, j : j + CHUNK]] for j, t in enumerate(singles))
            for row in np.nonzero(sizes < CHUNK)[0]:
                made[row, sizes[row] :] = -np.inf
            where = made.argmax(1)
            best = np.take_along_axis(made, where[:, None, :], 1)[:, 0]
            z, a, hid, share, mean = _combine(model, best, sizes, first)
            dz = (1 / (1 + np.exp(-z)) - y[rows]) * weights[rows] / len(rows)
            dh = np.repeat(dz, lengths)[:, None] * share[:, None] * model.out * (hid > 0)
            da = dh @ model.hidden.T * (a > 0)
            g = {"out": mean.T @ dz, "bias": dz.sum(keepdims=True), "hidden": a.T @ dh, "hidden_shift": dh.sum(0), "shift": da.sum(0)}
            g["embedding"], g["filters"] = np.zeros_like(model.embedding), np.zeros_like(model.filters)
            for j in range(WIDTH):
                at = np.take_along_axis(bytes_, where + j, 1)  # the byte under each filter's place
                for k in range(da.shape[1]):
                    by_byte = np.bincount(at[:, k], weights=da[:, k], minlength=256).astype(np.float32)
                    g["filters"][j, :, k] = by_byte @ model.embedding
                    g["embedding"] += np.outer(by_byte, model.filters[j, :, k])
            for k in names:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                getattr(model, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


#: Chunks whose responses are held at once: bounds the memory of a task, also for a very long text.
_TOGETHER = 256


def scorer(model: Model):
    """Function from UTF-8 texts to probabilities of label 1."""
    tables = pair_tables(model)

    def score(texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cut = [chunks(t) for t in texts]
        rows, sizes = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
        first = np.concatenate(([0], np.cumsum([len(c[1]) for c in cut])[:-1])).astype(int)
        best = np.concatenate([
            _best(tables, rows[i : i + _TOGETHER], sizes[i : i + _TOGETHER]) for i in range(0, len(rows), _TOGETHER)
        ])
        z = _combine(model, best, sizes, first)[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(float)))

    return score


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from the bounded sample of ``labelled.sample``."""
    return learn(sample(docs, labels, label))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, keep=None, accept=None) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold``) to every row.

    Null and empty texts are scored as a chunk of zeros. Columns with the added names are replaced.
    With ``accept`` (a function of the scores) rows are filtered instead, columns as they were.
    """
    return _scored(docs, model, scorer, threshold, keep, accept)
