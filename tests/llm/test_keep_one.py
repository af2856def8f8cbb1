"""Ids that repeat with different texts."""

import random

from vivabank.llm import simhash


def test_one_id_with_two_texts_keeps_a_row_of_each_group(spark):
    random.seed(3)
    a, b, c = (" ".join(f"w{random.randrange(9000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b, "s"), (None, a, "t"), (None, c, "u"), (None, c, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.source for r in simhash.keep_one(docs).collect()) == ["p", "q", "u"]
