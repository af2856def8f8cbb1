"""License scan: phrases, and an exact set-similarity join of text blocks with license notices.

A block is BLOCK words of a document, or twice as many as the notice has where that is more; blocks
overlap by half and cover all of it, so a notice lies whole in some block. It is found in a block that
holds at least the share ``containment`` of its distinct words. The join is exact:

* global order: the words of all notices, rarest in the corpus first, counted over every document;
* prefix: a block that holds ``ceil(c * |T|)`` words of T holds one of its ``|T| - ceil(c * |T|) + 1`` rarest;
* length: the block must have that many distinct words in all;
* position: after a prefix hit, what T still has behind it bounds the overlap;
* then the words are counted.

The notices are a fixed list, so their index goes out with the code; documents are never shuffled.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import annotate

#: Least words of a block.
BLOCK = 96

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening notices of public licenses, and paragraphs that stand without them.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
    " with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
    " public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to"
    " the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties"
    " including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2.0-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is"
    " distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}

# Everything but ASCII letters, digits and non-ASCII bytes is a blank; A-Z become lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Index:
    """Notices with their words in global order, and the prefix index over them."""

    def __init__(self, notices: dict[str, str], counts: dict[bytes, int], containment: float):
        self.containment = containment
        self.sets = {label: sorted(set(words_of(t.encode())), key=lambda w: (counts.get(w, 0), w)) for label, t in notices.items()}
        self.block = {label: max(BLOCK, 2 * len(words_of(t.encode()))) for label, t in notices.items()}
        self.needed = {label: max(1, math.ceil(containment * len(ws) - 1e-9)) for label, ws in self.sets.items()}
        self.rank = {label: {w: i for i, w in enumerate(ws)} for label, ws in self.sets.items()}
        # By size of block: word -> notices that have it in their prefix, and its place there.
        self.prefix: dict[int, dict[bytes, list[tuple[str, int]]]] = {}
        for label, ws in self.sets.items():
            for i, w in enumerate(ws[: len(ws) - self.needed[label] + 1]):
                self.prefix.setdefault(self.block[label], {}).setdefault(w, []).append((label, i))

    def matches(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(first word, label, containment) of every block of a document and notice that reach the threshold."""
        return [m for size, prefix in self.prefix.items() if not prefix.keys().isdisjoint(words) for m in self._in_blocks(words, size, prefix)]

    def _in_blocks(self, words: list[bytes], size: int, prefix: dict[bytes, list[tuple[str, int]]]) -> list[tuple[int, str, float]]:
        half = size // 2
        last = max(0, -(-(len(words) - 2 * half) // half)) if len(words) > 2 * half else 0
        blocks = {b for i, w in enumerate(words) if w in prefix for b in (i // half - 1, i // half) if 0 <= b <= last}
        found = []
        for b in sorted(blocks):
            own = set(words[b * half : (b + 2) * half])
            tried = set()
            for w in own & prefix.keys():
                for label, place in prefix[w]:
                    need, ws = self.needed[label], self.sets[label]
                    # Length and position: w may not be the block's first word of T, so count what came before it too.
                    if label in tried or len(own) < need:
                        continue
                    earlier = sum(x in own for x in ws[:place])
                    if earlier + len(ws) - place < need:
                        continue
                    tried.add(label)
                    overlap = sum(x in own for x in ws)
                    if overlap >= need:
                        found.append((b * half, label, overlap / len(ws)))
        return found


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """Starts of every phrase, ascending."""
    out = []
    for phrase in phrases:
        first, n = phrase[0], len(phrase)
        out.append([i for i, w in enumerate(words) if w == first and words[i : i + n] == phrase])
    return out


def word_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of a bounded set of words; counted over every document."""
    order = sorted(words)

    def factory():
        wanted = frozenset(order)

        def compute(texts):
            held = [wanted.intersection(words_of(t)) for t in texts]
            return [pa.array([[bisect.bisect_left(order, w) for w in h] for h in held], pa.list_(pa.int32()))]

        return compute

    marked = annotate(docs, factory, "held array<int>", keep=[])
    counted = marked.select(F.explode("held").alias("w")).groupBy("w").count()
    return {order[r.w]: r["count"] for r in counted.collect()}  # at most one row per word of the notices


def scan_licenses(
    docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, containment: float = 0.8, keep=None
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``blocks`` to every row.

    ``n_base`` counts all places of phrases; first and last word are the smallest and largest start.
    ``labels`` has the phrases' labels and the notices'. ``score`` is 1 where a phrase stands, else the
    largest containment reached by a block, else 0. ``blocks``: first word, label and containment of
    each block found. A null or empty text has no words, null places and empty labels. Repeated rows are
    scanned each; columns with the added names are replaced.
    """
    every = {w for t in notices.values() for w in words_of(t.encode())}
    index = Index(notices, word_counts(docs, every), containment)
    split = [p.encode().split() for p in phrases]
    names = list(phrases.values())

    def factory():
        heads = frozenset(p[0] for p in split)

        def compute(texts):
            n, n_base, first, last, base, labels, score, blocks = [], [], [], [], [], [], [], []
            for text in texts:
                words = words_of(text)
                places = [[] for _ in split] if heads.isdisjoint(words) else phrase_places(words, split)
                starts = [i for p in places for i in p]
                own = {name for name, p in zip(names, places) if p}
                found = index.matches(words)
                n.append(len(words))
                n_base.append(len(starts))
                first.append(min(starts, default=None))
                last.append(max(starts, default=None))
                base.append(",".join(sorted(own)))
                labels.append(",".join(sorted(own | {label for _, label, _ in found})))
                score.append(1.0 if starts else max((c for _, _, c in found), default=0.0))
                blocks.append([{"first_word": at, "label": label, "containment": c} for at, label, c in found])
            return [np.array(n), np.array(n_base), first, last, base, labels, score, blocks]

        return compute

    return annotate(
        docs, factory,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " blocks array<struct<first_word: long, label: string, containment: double>>",
        keep=keep,
    )
