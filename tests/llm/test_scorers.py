"""The scorers of toxicity and quality against loops over words and bytes."""

import math
import random

import numpy as np
from vivabank.llm import quality, toxicity

WORDS = ["the", "Ananan", "aaaaaaa", "abcabc", "été", "x", "--", "(nested)", "l'eau,", "日本語日本語", "a" * 90, "\x00\x01", "é" * 3]


def _texts():
    random.seed(7)
    made = [random.choice([" ", "\n", "\t  "]).join(random.choices(WORDS, k=random.randrange(150))) for _ in range(60)]
    return [t.encode() for t in [*made, "", "   ", "one", "word " * 5000, "é" * 20_000]]


def _toxicity(model, text):
    known = model.known if model.known is not None else [True] * len(model.values)
    words = []
    for w in text.split():
        ids = [i for i in toxicity.subwords(w, len(model.values)) if known[i]]
        words.append((sum(float(model.values[i]) for i in ids), len(ids)))
    half = toxicity.WINDOW // 2
    starts = range(0, max(1, len(words) - half), half)
    means = []
    for s in starts:
        part = words[s : s + toxicity.WINDOW]
        means.append(sum(v for v, _ in part) / max(1, sum(n for _, n in part)))
    return 1 / (1 + math.exp(-max(-40, min(40, model.bias + max(means)))))


def test_toxicity_equals_a_loop_over_words(monkeypatch):
    monkeypatch.setattr(toxicity._Words, "MOST", 3)  # the cache is cleared again and again
    monkeypatch.setattr(toxicity._Words, "TOGETHER", 4)
    random_ = np.random.default_rng(2)
    for known in (None, random_.random(1 << 10) < 0.7):
        model = toxicity.Model(random_.standard_normal(1 << 10).astype(np.float32), 0.3, known)
        texts = _texts()
        score = toxicity.scorer(model)
        got = np.concatenate([score(texts[i : i + 9]) for i in range(0, len(texts), 9)])
        assert np.allclose(got, [_toxicity(model, t) for t in texts], atol=1e-9)


def test_all_subwords_equal_those_of_each_word():
    random.seed(3)
    words = {bytes(random.choices(b"abc\xc3\xa9", k=random.randrange(1, 15))) for _ in range(2000)} | {b"ananan", b"a" * 200, b"\xff" * 4}
    words = [w for w in words if w.lower().strip(toxicity._AROUND) == w]
    at, owner = toxicity.subwords_of_all(words, 1 << 17)
    got = [[] for _ in words]
    for x, i in zip(at.tolist(), owner.tolist()):
        got[i].append(x)
    assert [sorted(g) for g in got] == [sorted(toxicity.subwords(w, 1 << 17)) for w in words]


def _quality(model, text):
    """One window at a time."""
    width, size = quality.WIDTH, quality.CHUNK
    n = max(1, len(text) - width + 1)
    data = text + bytes(width)
    total, hidden = 0, 0.0
    for begin in range(0, n, size):
        best = None
        for at in range(begin, min(begin + size, n)):
            here = sum(model.embedding[data[at + j]] @ model.filters[j] for j in range(width))
            best = here if best is None else np.maximum(best, here)
        windows = min(size, n - begin)
        a = np.maximum(best + model.shift, 0)
        hidden = hidden + windows * np.maximum(a @ model.hidden + model.hidden_shift, 0)
        total += windows
    return 1 / (1 + math.exp(-float(hidden / total @ model.out + model.bias[0])))


def test_quality_equals_a_loop_over_bytes():
    r = np.random.default_rng(4)
    draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    model = quality.Model(draw(256, 4), draw(quality.WIDTH, 4, 5), draw(5), draw(5, 6), draw(6), draw(6), draw(1))
    texts = [t for t in _texts() if len(t) < 500]
    got = quality.scorer(model)(texts)
    assert np.allclose(got, [_quality(model, t) for t in texts], atol=1e-4)
    assert quality.scorer(model)([]).shape == (0,)
