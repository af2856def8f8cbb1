"""Labels that cover far more than the documents at hand."""

from vivabank.llm import labelled


def test_sample_is_drawn_from_the_documents_at_hand(spark):
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    # Every tenth odd document and every fortieth even one is left; some texts are null or too long.
    docs = spark.range(4000).where("id % 20 = 1 or id % 80 = 0").selectExpr(
        "id as doc_id", "case when id % 3 = 0 then null when id % 7 = 0 then repeat('x', 40000) else concat('t', id) end as text"
    )
    usable = {r.doc_id for r in docs.where(~labelled.held_out(docs["doc_id"]) & (docs["text"].isNotNull())).collect() if r.doc_id % 7}
    own = {y: {f"t{i}".encode() for i in usable if i % 2 == y} for y in (0, 1)}
    got = labelled.sample(docs, labels, "toxic", per_class=20)
    for y in (0, 1):
        texts = [t for t, label in zip(got.texts, got.labels) if label == y]
        assert len(texts) == len(set(texts)) == min(20, len(own[y])) and set(texts) <= own[y]
    total = {y: sum(w for w, label in zip(got.weights, got.labels) if label == y) for y in (0, 1)}
    assert abs(total[1] / total[0] - len(own[1]) / len(own[0])) < 1e-9
