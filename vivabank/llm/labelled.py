"""Bounded samples of labelled documents, for classifiers that learn on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable

#: Labelled rows of each class that a classifier learns from, at most, and bytes of one such text.
PER_CLASS, TEXT_BYTES = 1200, 32 << 10


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Sample:
    texts: list[bytes]
    labels: list[int]
    weights: list[float]  # so that the classes weigh what they do among all rows that may be learnt from


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Sample:
    """Up to ``per_class`` texts of each class, by smallest hash of the id; held-out rows are left out.

    Ids or labels that are null, and texts that are null or over TEXT_BYTES bytes, teach nothing.
    Several labels of one document count as the largest. Only labels with such a text in ``docs`` are
    drawn from and counted, so labels of other documents neither take places nor change the weights.
    """
    spark = docs.sparkSession
    texts_of = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id", F.lit(7)).alias("h")
    )
    usable = usable.join(texts_of.select("doc_id"), "doc_id", "left_semi")
    usable = durable(usable.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("h").alias("h")), "labelled")
    share = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    ids = {r.doc_id: (r.y, r.h) for r in picked.collect()}  # at most 2 * per_class rows
    if not ids:
        return Sample([], [], [])
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # as bounded as ids
    rows = texts_of.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    texts, ys = [], []
    for y in (0, 1):
        own = sorted((ids[r.doc_id][1], r.doc_id, bytes(r.text)) for r in rows if ids[r.doc_id][0] == y)
        texts += [t for _, _, t in own]
        ys += [y] * len(own)
    weights = [share.get(y, 0) / max(1, ys.count(y)) for y in ys]
    mean = sum(weights) / max(1, len(weights))
    return Sample(texts, ys, [w / mean for w in weights])
