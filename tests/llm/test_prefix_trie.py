"""The trie of conversations against a plain version."""

import hashlib
import random
from zlib import crc32

from vivabank.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, name string"


def _plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own_saved + sum(saved[x] for x in below)
    return sorted(
        (
            members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p)).encode()).hexdigest(),
        )
        for p in members
    )


def _got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def _rows():
    random.seed(4)
    rows = []
    for c in [*range(60), 10**12, 10**12 + 1, *range(9000, 9012), *range(20_000, 20_040)]:
        if c in (10, 15):
            continue
        alike = c >= 20_000  # one conversation that many repeat
        n = 5 if alike else random.choice([1, 2, 3, 8, 8, 9, 17, 40])
        for t in range(n):
            text = f"copy {t}" if alike else random.choice(["hi", "é", "", None, f"own {c} {t}", "x" * 1000])
            rows.append((c, None if t == 0 and c % 4 == 0 else t, "user" if t % 2 == 0 else random.choice(["assistant", None, ""]), text, 1, "n"))
    rows += [(None, 0, "user", "no conversation", 1, "n"), (7, 99, "user", "same turn", 1, "n"), (7, 99, "user", "same turn", 1, "n")]
    random.shuffle(rows)
    return rows


def test_trie_equals_the_plain_version(spark):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA)
    assert _got(prefix_trie.conversation_trie(table.repartition(5))) == _plain(rows)
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0


def test_one_conversation_and_one_without_turns(spark, monkeypatch):
    # Rows of neighbouring numbers are split everywhere.
    monkeypatch.setattr(prefix_trie, "CHUNK", 1)
    monkeypatch.setattr(prefix_trie, "IDS", 1)
    bare = next(c for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9 > 2)
    rows = [(bare, t, "user", "gone", 1, "n") for t in range(2)]  # its base is absent, and its own turns are skipped
    one = spark.createDataFrame(rows, SCHEMA)
    assert _got(prefix_trie.conversation_trie(one)) == _plain(rows)
    assert len(_plain(rows)) == 1
    rows += [(1005, t, "user", f"t{t % 3}", 1, "n") for t in range(70)]
    assert _got(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)
