"""Source divergence against a plain version, and skybands against all pairs."""

import random
import re
from collections import Counter

import numpy as np
from vivabank.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank string"


def _terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def _plain(rows, least, k):
    docs = [(lang or "", source or "", _terms(text)) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        seen, whole = Counter(), Counter()
        groups = {s: Counter() for g, s, _ in docs if g == lang}
        for g, source, words in docs:
            if g == lang:
                seen.update(set(words))
                whole.update(words)
                groups[source].update(words)
        kept = [t for t in seen if seen[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(items[:most])]
    return sorted(out)


def _rows():
    random.seed(5)
    words = ["The", "tHe", "é", "É", "ß", "x1y", "a_b", "naïve", "日本", "zz", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(300):
        source = random.choice(["hot", "hot", "hot", "a", "b", "ö", "", None])
        text = random.choice([" ", "\n", "-", "\x00"]).join(random.choices(words, k=random.randrange(60)))
        rows.append((i, text, random.choice(["en", "en", "de", None, ""]), source, "t", "r"))
    rows += [rows[0], rows[0], (None, None, "fr", "only", None, None), (1, "", "fr", "other", None, None)]
    rows.append((7, "long " * 300_000 + "x" * 70_000, "en", "hot", None, None))
    return rows


def test_audit_equals_the_plain_version(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, k in ((30, 50), (3, 4), (1000, 5)):
        got = sorted(map(tuple, divergence.audit_sources(docs, least, k).collect()))
        assert got == _plain(rows, least, k)
    # Small tiles and slices give the same.
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "SLICE", 5)
    assert sorted(map(tuple, divergence.audit_sources(docs, 3, 4).collect())) == _plain(rows, 3, 4)
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_skyband_equals_all_pairs():
    random.seed(9)
    for n, k in ((1, 1), (40, 3), (900, 7)):
        rows = [(random.randrange(12), random.randrange(12), b"t%04d" % i) for i in random.sample(range(5000), n)]
        beats = lambda u, t: u[0] >= t[0] and u[1] <= t[1] and u[2] < t[2]
        want = [i for i, t in enumerate(rows) if sum(beats(u, t) for u in rows) < k]
        got = divergence.skyband(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], k)
        assert got.tolist() == want


def test_held_terms_are_handed_on(spark, monkeypatch):
    held = divergence._Held()
    for text in (b"a b a", b"b", b""):
        held.add(b"en", b"s", text)
    rows = [r for b in held.batches() for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows) == [("en", "s", " s", 0, 0), ("en", "s", "a", 2, 1), ("en", "s", "b", 2, 2)] and not held.groups
