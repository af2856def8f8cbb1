"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on random Gaussian directions, shifted and quantised; ``k`` such
numbers name a bucket, and there are several tables of buckets. Vectors that share a bucket are
compared exactly, in double precision. Unit vectors with cosine c are sqrt(2 - 2c) apart, which fixes
each hash's chance of a hit; from it, and from the number of vectors, follow ``k`` and the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable
from .components import components

#: Rows of a bucket that are compared at once; larger buckets are dealt to pairs of blocks.
BLOCK = 1024


def hit_chance(distance: float, width: float) -> float:
    """Chance that a quantised projection of step ``width`` does not part two points."""
    c = width / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def parameters(n: int, cosine: float, width: float, recall: float) -> tuple[int, int]:
    """Hashes per table so that about 64 unrelated vectors of ``n`` meet by chance, and tables for the recall."""
    near, far = hit_chance(math.sqrt(2 - 2 * cosine), width), hit_chance(math.sqrt(2), width)
    k = max(8, math.ceil(math.log(max(1, n) / 64) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the dimension of their vectors, with these as a matrix."""
    sizes = np.asarray(pc.list_value_length(batch.column(column)))
    for d in np.unique(sizes):
        part = batch.filter(pa.array(sizes == d))
        yield part, np.asarray(part.column(column).flatten()).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(vectors: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, k, dtype=np.int64) | 1
        for batch in batches:
            pieces = (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048))
            for part, x in (found for piece in pieces for found in _by_dimension(piece, 2)):
                x = _unit(x)
                d = x.shape[1]
                if d not in planes:
                    random = np.random.default_rng(seed)
                    planes[d] = random.standard_normal((d, tables * k)), random.uniform(0, width, tables * k)
                a, b = planes[d]
                h = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, k)
                with np.errstate(over="ignore"):
                    buckets = (h * mix).sum(2)  # wraps around: a hash of the k numbers
                flat = pa.array(buckets.reshape(-1))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, flat)], names=[*batch.schema.names, "buckets"])

    schema = "label int, rep long, embedding array<float>, copies long, buckets array<long>"
    return vectors.select("label", "rep", "embedding", "copies").mapInArrow(run, schema)


def _lowest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number that each row and column reaches over the marked places of ``near``."""
    none = np.iinfo(np.int64).max
    while True:
        to_left = np.minimum(left, np.where(near, right[None, :], none).min(1, initial=none))
        to_right = np.minimum(right, np.where(near, to_left[:, None], none).min(0, initial=none))
        if (to_left == left).all() and (to_right == right).all():
            return left, right
        left, right = to_left, to_right


def _compare(cosine: float):
    """For each row of a group: the links that first show there, and the smallest row it reaches in it.

    Rows come sorted by group. A dense group gives one row per vector, not one per link.
    """
    names = ["rep", "n", "low"]

    def links(rows: list[dict]) -> pa.RecordBatch:
        rep, copies = np.array([r["rep"] for r in rows]), np.array([r["copies"] for r in rows])
        side = np.array([r["block"] for r in rows])
        buckets = np.array([r["buckets"] for r in rows])
        x = _unit(np.array([r["embedding"] for r in rows], np.float64))
        low, high, table = rows[0]["low"], rows[0]["high"], rows[0]["table"]
        left = np.nonzero(side == low)[0]
        right = left if low == high else np.nonzero(side == high)[0]
        near = x[left] @ x[right].T >= cosine
        near &= rep[left][:, None] != rep[right][None, :]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        for at, numbers in zip((left, right), _lowest(near, rep[left], rep[right])):
            least[at] = np.minimum(least[at], numbers)
        i, j = np.nonzero(near)
        # A pair that meets in several tables counts in the first; inside a block both rows see it.
        first = (buckets[left[i]] == buckets[right[j]]).argmax(1) == table
        i, j = left[i[first]], right[j[first]]
        n = np.bincount(i, copies[j], len(rows))
        if low != high:
            n += np.bincount(j, copies[i], len(rows))
        linked = (least < rep) | (n > 0)
        return pa.RecordBatch.from_arrays([pa.array(v[linked]) for v in (rep, n.astype(np.int64), least)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["label"], r["d"], r["table"], r["bucket"], r["low"], r["high"])
                if key != group:
                    if len(rows) > 1:
                        yield links(rows)
                    group, rows = key, []
                rows.append(r)
        if len(rows) > 1:
            yield links(rows)

    return run


def link_vectors(vectors: DataFrame, cosine: float = 0.93, width: float = 2.0, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors with the same label link when their cosine is at least ``cosine``. A row whose label or
    vector is null, whose vector is zero or holds a null or non-finite component, links with nothing.
    Vectors of different dimensions do not link. Equal vectors are one row for the search and link with
    each other. ``recall`` is the chance to find a pair right at the threshold; closer ones are surer.
    """
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    rows = durable(own.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = durable(
        rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vector-classes",
    )
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = parameters(most, cosine, width, recall)
    hashed = durable(_hashed(classes, k, tables, width, seed), "vector-buckets").withColumn("d", F.size("embedding"))
    key = ["label", "d", "table", "bucket"]
    keys = hashed.select("label", "d", F.posexplode("buckets").alias("table", "bucket"))
    large = durable(
        keys.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).alias("blocks")), "vector-hot"
    )
    # Row r of block i meets every block j: it goes to the groups (min(i, j), max(i, j)).
    dealt = (
        hashed.select("*", F.posexplode("buckets").alias("table", "bucket"))
        .join(large, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("label", "rep", "embedding", "copies", "buckets", "d", "table", "bucket", "block",
                F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    group = [*key, "low", "high"]
    links = durable(
        dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(cosine), "rep long, n long, low long"), "vector-links"
    )
    degrees = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    facts = classes.join(degrees, "rep", "left").join(found, "rep", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = rows.where("usable").join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
