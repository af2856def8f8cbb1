"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vivabank.llm import chat, components, embeddings, inner_products, labelled, licenses, mixing, packing, quality, simhash, toxicity
from vivabank.llm.token_counts import count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["'s", "'re", "'", " ", "  ", "\n", "\t", " ", "a", "LL", "12", "٣", "!", "...", "É", "é.", "é.", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "😀", "\x1c", "n't."]


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    made = ["".join(random.choices(BITS, k=random.randint(0, 25))) for _ in range(400)]
    return [None, "", " ", "a" * 5000, " " * 3000, "ab " * 9000, "same text here", "same text here", *made]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", f"s{i % 3}" if i % 7 else None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, source string, n_tokens int").repartition(3)


def test_token_counts(spark, docs, texts):
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in count_tokens(docs, BYTE, limit=10).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 10), t
    assert count_tokens(docs.limit(0), BYTE).count() == 0


def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _reach(nodes, links):
    low = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not changed:
            return low


def test_simhash(spark, docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, keep=["doc_id"]).collect()}
    prints = {i: _print(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    low = _reach(prints, links)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", low[i]) for i in prints}
    kept = simhash.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values())) and kept.columns == docs.columns


def test_hamming_join_of_dense_prints(spark):
    random.seed(9)
    centre = random.getrandbits(64)
    values = {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for _ in range(250)}
    values = [v - (1 << 64) if v >> 63 else v for v in values | {random.getrandbits(64) for _ in range(200)}]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long").repartition(4)
    got = sorted((r.a, r.b) for r in simhash.hamming_links(frame).collect())
    mask = (1 << 64) - 1
    assert got == sorted((a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3)


def test_allocation_is_least():
    cost, thresholds = simhash.allocate([[0, 5, 9, 30, 99], [0, 1, 50, 90, 99], [0, 2, 3, 80, 99]], 4)
    assert sum(t + 1 for t in thresholds) == 4 and cost == 5 + 1 + 3


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (7, 8)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}


def test_embeddings(spark):
    random_ = np.random.default_rng(1)
    base = random_.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + random_.standard_normal(16) * random_.choice([0.02, 0.1, 0.2])).astype("f4").tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)]  # repeated vectors
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, rows[0][1], None), (404, [None] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.link_vectors(frame).collect()}
    usable = [(i, np.asarray(v, "f8"), y) for i, v, y in rows if i < 400]
    links = [
        (a, b) for a, v, y in usable for b, w, z in usable if a != b and y == z and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93
    ]
    found = sum(r.n_links for r in got.values())
    assert found <= len(links) and found >= 0.95 * len(links)
    wanted = {i: sum(a == i for a, _ in links) for i, _, _ in rows}
    assert all(r.n_links <= wanted[i] for i, r in got.items())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 405))


def test_embedding_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    v = np.random.default_rng(2).standard_normal((90, 8)) * 0.01 + 1
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v.astype("f4"))], "vec_id long, embedding array<float>, label int")
    got = embeddings.link_vectors(frame).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_inner_products(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "CANDIDATES", 32)
    x = np.random.default_rng(3).standard_normal((300, 12)) * np.random.default_rng(4).uniform(0.1, 3, (300, 1))
    x[40:70] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype("f4"))] + [(1000, None), (1020, [float("inf")] * 12)]
    got = inner_products.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, k=7)
    q = np.floor(64 * x.astype("f4").astype("f8"))
    want = set()
    for i in range(0, 300, 20):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:7]
        want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(order, 1)}
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def _labelled(spark, n=240):
    random.seed(5)
    plain = ["the", "ation", "ering", "lich", "thes", "oned", "ouly", "tion"]
    rows = []
    for i in range(n):
        words = ["".join(random.choices(plain, k=2)) for _ in range(random.randint(20, 400))]
        bad = i % 4 == 0
        if bad:
            words[random.randrange(len(words))] = random.choice(["slimeball", "slimebal", "slimeballs"])
        shout = i % 5 == 0
        rows.append((i, "!! ".join(words).upper() if shout else " ".join(words), int(bad), int(not shout)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")


def test_classifiers_on_held_out_rows(spark):
    rows = _labelled(spark)
    labels = rows.select("doc_id", "toxic", "quality")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 300_000)], "doc_id long, text string")
    docs = rows.select("doc_id", "text").unionByName(extra)
    truth = {r.doc_id: r for r in labels.collect()}
    for module, label, threshold in ((toxicity, "toxic", 0.3), (quality, "quality", 0.7)):
        model = module.train(docs, labels)
        score = module.score_toxicity if module is toxicity else module.score_quality
        got = score(docs, model, threshold).collect()
        assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
        test = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
        assert sum(r.predicted == truth[r.doc_id][label] for r in test) >= 0.9 * len(test)
        kept = score(docs, model, accept=lambda s: s < 2)
        assert kept.count() == 243 and kept.columns == docs.columns
    used = labelled.sample(docs, labels, "toxic")
    held = {r.text.encode() for r in docs.collect() if r.text and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert not held & set(used.texts)
    assert toxicity.train(docs, labels.limit(0)).bias == -20


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack_documents(docs, WORD, end_id=2, size=4096).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes()
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(ids)}
    waste = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        used = sum(p.length for p in own)
        assert used <= 4096 and [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        waste += 0 if used & (used - 1) == 0 else 4096 - used
    assert waste < 0.1 * sum(p.length for p in pieces)


def test_cuts_are_least():
    random.seed(6)
    for _ in range(60):
        places = np.array(sorted(random.sample(range(1, 200), 14)))
        places = np.union1d(places, np.arange(20, 201, 20))
        prices = np.array([random.choice([0, 8, 64]) for _ in places])
        pos, price = [0, *places.tolist()], [0, *prices.tolist()]
        best = [0.0] + [np.inf] * len(places)
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 40 - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 40) + price[j] + packing.WINDOW
        ends = packing.cuts(40, places, prices, last=True)
        at = dict(zip(pos, price))
        assert sum(40 - (b - a) + at[b] + packing.WINDOW for a, b in zip([0, *ends], ends)) == best[-1]


def test_mixing(spark):
    rows = [(i, "w " * (i % 9), ["b", "a", None][i % 3] if i < 900 else "tiny", 5) for i in range(903)] + [(7, "x y", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs)
    got = mixed.select("source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    totals = {}
    for r in got:
        totals.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.size * r.copies
    # a, b, tiny, null weigh 1, 2, 3, 1; tiny stops at three times its size.
    left = sum(t[0] for t in totals.values()) - 3 * totals["tiny"][0]
    assert totals["tiny"][1] == 3 * totals["tiny"][0]
    assert totals["b"][1] == pytest.approx(left / 2) and totals["a"][1] == totals[None][1] == pytest.approx(left / 4)
    assert all(abs(taken - target) <= 9 for _, target, taken in totals.values()) and max(r.copies for r in got) <= 3
    emitted = mixing.emit(mixed, docs.columns)
    assert emitted.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.NOTICES["mit"]
    filler = " ".join(f"w{i}" for i in range(500))
    near = " ".join(w for i, w in enumerate(mit.split()) if i % 9)  # about nine words in ten
    rows = [
        (1, None), (2, ""), (3, f"{filler}. {mit.upper()}; {filler}"), (4, f"{filler} {near} {filler}"),
        (5, "CC-BY cc by, cc by! General public license"), (6, filler * 3), (7, "the software of any person"),
    ]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].first_word is None and got[2].labels == ""
    assert got[3].labels == "mit" and got[3].score == 1.0 and 0.8 <= got[4].score < 1 and got[4].labels == "mit"
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (4, 0, 6, "cc-by,gpl")
    assert got[6].labels == got[7].labels == "" and got[6].n_base == 0


def test_set_join_is_exact():
    random.seed(8)
    words = [f"w{i}" for i in range(40)]
    notices = {f"n{k}": " ".join(random.sample(words, random.randint(3, 14))) for k in range(12)}
    index = licenses.Index(notices, {w.encode(): random.randint(0, 9) for w in words}, 0.7)
    for _ in range(40):
        text = [w.encode() for w in random.choices(words + ["z"] * 60, k=random.randint(0, 400))]
        want = set()
        for label, notice in notices.items():
            half = max(licenses.BLOCK, 2 * len(notice.split())) // 2
            t = set(notice.encode().split())
            for b in range(max(1, -(-(len(text) - 2 * half) // half) + 1)):
                if len(t & set(text[b * half : (b + 2) * half])) / len(t) >= 0.7 - 1e-9:
                    want.add((b * half, label))
        assert {(at, label) for at, label, _ in index.matches(text)} == want


def test_long_notices_and_phrases_in_random_texts(spark):
    random.seed(15)
    long = " ".join(f"law{i}" for i in range(400))
    words = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "x", "é", "cc-by", "by,"]
    texts = [" ".join(random.choices(words, k=random.randrange(40))) for _ in range(200)]
    texts += [" ".join(["x"] * k + [long] + ["y"] * 700) for k in (0, 130, 399, 777)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs.unionByName(docs), notices={"long": long}).collect()}
    assert all((got[i].score, got[i].labels) == (1.0, "long") for i in range(200, 204))
    for i, text in enumerate(texts[:200]):
        own = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
        places = [
            (k, label) for p, label in licenses.PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()
        ]
        starts = [k for k, _ in places]
        want = (len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want


def test_repeated_vectors_and_other_dimensions(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [3.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = inner_products.top_products(frame, k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == [(20, 1, 1, 64 * 192), (20, 2, 2, 64 * 32 + 128 * 32)]
    assert inner_products.top_products(frame.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0], 1), (3, [2.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_vectors(mixed).collect()} == {1: (1, 1), 2: (0, 2), 3: (1, 1)}
    assert embeddings.link_vectors(mixed.limit(0)).count() == 0


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM", 8)
    docs = spark.createDataFrame([(None, f"w {i} " * (i % 5), "a") for i in range(400)] + [(1, "x y", "b")], "doc_id long, text string, source string")
    sizes = mixing.mix(docs).where("source = 'a'").groupBy("size").agg(F.countDistinct("copies").alias("n")).collect()
    assert len(sizes) == 5
    whole = mixing.mix(docs).where("source = 'a'").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("w")).first()
    assert abs(whole.t - whole.w) <= 10 * (400 // 8 + 1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, fingerprint string, component_id long")
    assert simhash.near_duplicates(docs).count() == simhash.keep_one(docs).count() == 0
    assert licenses.scan_licenses(docs).count() == 0
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    model = quality.learn(labelled.Sample([b"a", b"b"], [1, 1], [1.0, 1.0]))
    assert quality.score_quality(docs, model).count() == 0 and quality.scorer(model)([b"", b"x"]).tolist() == pytest.approx([1.0, 1.0])


def test_reply_trees(spark):
    rows = [
        (1, 0, None, "user", "q </s>\\ <|im_end|>", 0.0), (1, 1, 0, "assistant", "poor", 1.0), (1, 2, 0, "assistant", "good <\\|x [INST]", 5.0),
        (1, 3, 2, "user", None, 0.0), (1, 4, 99, "user", "lost parent", None),
        (2, 0, 1, "user", "circle", 1.0), (2, 1, 0, "user", "circle", 1.0), (None, 5, None, None, "", 1.0), (None, 5, None, None, "", 1.0),
        *[(3, i, i - 1 if i else None, "assistant", str(i), 1.0) for i in range(70)],
    ]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    made = chat.format_paths(chat.best_paths(frame))
    got = {
        r.tree: r for r in made.select("tree", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()
    }
    assert set(got) == {1, 3, None}  # tree 2 is a circle
    assert [tuple(x) for x in got[1].t] == [("user", rows[0][4]), ("assistant", rows[2][4]), ("user", "")]
    assert got[1].m == [rows[2][4]] and got[1].formatted.count("<|im_end|>") == 3 and "[INST]" not in got[1].formatted
    assert [x.text for x in got[3].t] == [str(i) for i in range(70)] == got[3].m
    assert [tuple(x) for x in got[None].t] == [("", "")]
    two = chat.best_paths(frame.where("tree = 1"), branches=2).where("branch = 2").orderBy("position").collect()
    assert [r.text for r in two] == [rows[0][4], "poor"]
