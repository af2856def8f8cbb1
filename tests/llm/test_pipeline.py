"""The stages of the pipeline on planted toxic, low-quality, exact and near copies."""

import random
from collections import Counter

import corpus_pipeline
from vivabank.llm import mixing, quality, simhash, toxicity
from vivabank.llm.queries import table
from vivabank.sources.durable import durable


def _kept(rows):
    """Smallest id of each component of fingerprints within 3 bits, by all pairs."""
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    low = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and low[a] != low[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {i: new if x == old else x for i, x in low.items()}
    return set(low.values())


def _write(spark, folder):
    random.seed(6)
    draw = lambda n: ["".join(random.choices(["the", "ation", "ering", "lich", "oned", "tion"], k=3)) for _ in range(n)]
    rows, labels = [], []
    for i in range(160):
        own, bad, low = draw(120), i % 4 == 0, i % 5 == 0
        if bad:
            own[random.randrange(120)] = "slimeball"
        rows.append("!! ".join(own).upper() if low else " ".join(own))
        labels.append((i, int(not low), int(bad)))
    clean = [i for i in range(160) if i % 4 and i % 5]
    for i in clean[:10]:
        rows.append(rows[i])
        near = rows[i].split()
        near[60] = "changed"
        rows.append(" ".join(near))
    made = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_every_stage_keeps_what_it_should(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    clean = durable(stages["toxicity"](spark, docs, folder), "test")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), threshold=0.3)
    assert ids(clean) == ids(scored.where("score < 0.3")) and clean.columns == docs.columns
    assert sum(i % 4 == 0 for i in ids(clean) if i < 160) <= 4

    good = durable(stages["quality"](spark, clean, folder), "test")
    scored = quality.score_quality(clean, quality.train(clean, labels), threshold=0.3)
    assert ids(good) == ids(scored.where("score >= 0.3")) and good.columns == docs.columns
    assert sum(i % 5 == 0 for i in ids(good) if i < 160) <= 3 and len(ids(good)) >= 90

    single = durable(stages["simhash"](spark, good, folder), "test")
    assert ids(single) == sorted(_kept([(r.doc_id, r.text) for r in good.collect()])) and single.columns == docs.columns
    assert len(ids(single)) < len(ids(good))

    mixed = durable(stages["mixing"](spark, single, folder), "test")
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    assert Counter(ids(mixed)) == copies and mixed.columns == docs.columns

    packed = stages["packing"](spark, mixed, folder)
    whole = corpus_pipeline.run(spark, folder)
    assert packed.count() and sorted(map(str, whole.collect())) == sorted(map(str, packed.collect()))
