"""Exact top-k inner products: candidates by descending length, pruned by Cauchy-Schwarz bounds.

All vectors are turned by the eigenvectors of their Gram matrix (the right singular vectors), so the
first coordinates hold most of their length. Candidates are sorted by length and packed into blocks;
queries are packed too. A block of queries meets the candidate blocks of a lane in order of length:

* when |q| |x| falls below the k-th score so far for every query, the lane is done;
* else the first coordinates' partial product plus the product of the residual lengths bounds the
  score, and only what may still reach the k-th score is multiplied out, in integers.

The lanes' results meet in one ranking per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable

#: Candidates and queries of a block, and queries that are multiplied at once.
CANDIDATES, QUERIES, TILE = 1024, 4096, 256


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, x (whole numbers as doubles): floor(scale * component). Rows with null or non-finite parts go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"),
    )


def _stack(column: pa.Array, dimension: int) -> np.ndarray:
    out = np.zeros((len(column), dimension))
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def rotation(vectors: DataFrame, dimension: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, strongest first. dimension ** 2 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _stack(batch.column(0).slice(i, 4096), dimension)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "v"])

    rows = vectors.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(dimension * dimension)
    for r in rows:
        gram[r["at"]] = r["v"]
    return np.linalg.eigh(gram.reshape(dimension, dimension))[1][:, ::-1]


_BLOCK = "block long, longest double, ids binary, xs binary"


def _packed(vectors: DataFrame, dimension: int, size: int | None) -> DataFrame:
    """One row per ``size`` vectors in the order of the partition; without ``size``, one per partition, named by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(ids: list, xs: list) -> pa.RecordBatch:
            x = np.concatenate(xs)
            longest = float(np.sqrt((x * x).sum(1).max()))
            raw = np.concatenate(ids).astype("<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() if size is None else int(raw[0])]), pa.array([longest]), pa.array([raw.tobytes()], pa.binary()), pa.array([x.astype("<f4" if np.abs(x).max() < 1 << 24 else "<f8").tobytes()], pa.binary())],
                names=["block", "longest", "ids", "xs"],
            )

        ids, xs, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at) if size is None else batch.slice(at, size - held)
                at += part.num_rows
                held += part.num_rows
                ids.append(np.array(part.column(0).to_pylist()))
                xs.append(_stack(part.column(1), dimension))
                if held == size:
                    yield pack(ids, xs)
                    ids, xs, held = [], [], 0
        if held:
            yield pack(ids, xs)

    return vectors.select("vec_id", "x").mapInArrow(run, _BLOCK)


def _unpack(row: dict, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    kind = "<f4" if len(row["xs"]) == 4 * dimension * len(ids) else "<f8"
    return ids, np.frombuffer(row["xs"], kind).reshape(len(ids), dimension).astype(np.float64)


class Search:
    """A block of queries on its way through the candidate blocks of a lane."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, head: int):
        self.ids, self.x, self.k, self.head, self.turn = ids, x, k, head, turn
        self.turned = x @ turn
        self.length = np.sqrt((x * x).sum(1))
        self.residual = np.sqrt(np.maximum(0, (self.turned[:, head:] ** 2).sum(1)))
        self.least = np.full(len(ids), -np.inf)  # the k-th score so far
        self.best = [np.zeros(0, np.int64)] * 3  # query row, vec_id, score
        self.over = False

    def meet(self, ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        # A little slack covers rounding of the bounds; scores themselves are exact.
        slack = 1e-6 * (1 + self.length * longest)
        open_ = np.nonzero(self.length * longest + slack >= self.least)[0]
        if not len(open_):
            self.over = True  # later blocks are no longer
            return
        turned = x @ self.turn
        residual = np.sqrt(np.maximum(0, (turned[:, self.head :] ** 2).sum(1)))
        found = [self.best]
        for i in range(0, len(open_), TILE):
            rows = open_[i : i + TILE]
            bound = self.turned[rows, : self.head] @ turned[:, : self.head].T + np.outer(self.residual[rows], residual)
            may = bound + slack[rows, None] >= self.least[rows, None]
            columns = np.nonzero(may.any(0))[0]
            if not len(columns):
                continue
            score = np.where(may[:, columns], self.x[rows] @ x[columns].T, -np.inf)
            score[self.ids[rows, None] == ids[None, columns]] = -np.inf  # the query itself
            floor = self.least[rows]
            if len(columns) > self.k:
                floor = np.maximum(floor, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])
            r, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            found.append([rows[r], ids[columns[c]], score[r, c].astype(np.int64)])
        row, vec, score = (np.concatenate(p) for p in zip(*found))
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        keep = place < self.k
        self.best = [row[keep], vec[keep], score[keep]]
        full = place == self.k - 1
        self.least[row[full]] = score[full]

    def result(self) -> pa.RecordBatch:
        row, vec, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row.astype(int)]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, lanes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query with all other rows.

    Vectors (vec_id, embedding) become floor(scale * component). Queries are the rows whose vec_id is
    divisible by ``every``. Ties go to the smaller vec_id. Rows without id, or whose vector is null or
    holds null or non-finite components, take no part; shorter vectors count as filled with zeros. Rows
    that repeat an id and its vector count once; an id with several vectors is a candidate with each.
    Scores are exact while they fit in 53 bits. Queries are copied to every lane, candidates to every
    block of QUERIES queries: that is the stated set of queries against all rows, in blocks.
    """
    spark = vectors.sparkSession
    rows = durable(quantised(vectors, scale).dropDuplicates(["vec_id", "x"]), "products")
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    facts = rows.agg(F.max(F.size("x")).alias("d"), F.count_if(is_query).alias("q")).first()
    dimension = max(1, facts.d or 0)
    turn = spark.sparkContext.broadcast(rotation(rows, dimension))  # dimension ** 2 numbers
    head = max(1, dimension // 2)
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    by_length = rows.withColumn("length", length).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    candidates = durable(_packed(by_length, dimension, CANDIDATES), "products-candidates")
    asked = max(1, -(-facts.q // QUERIES))
    queries = durable(_packed(rows.where(is_query).repartition(asked), dimension, None), "products-queries")
    lane = F.pmod(F.xxhash64("block", "longest"), F.lit(lanes)).cast("int")
    met = candidates.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("query_block"), lane.alias("lane"),
        F.lit(1).alias("kind"), "longest", "ids", "xs",
    )
    sent = queries.select(
        F.col("block").alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(0).alias("kind"), "longest", "ids", "xs",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = group = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if group != (row["query_block"], row["lane"]):
                    if search:
                        yield search.result()
                    group, search = (row["query_block"], row["lane"]), None
                if row["kind"] == 0:
                    search = Search(*_unpack(row, dimension), turn.value, k, head)
                elif search and not search.over:
                    search.meet(*_unpack(row, dimension), row["longest"])
        if search:
            yield search.result()

    merged = (
        sent.unionByName(met).repartition("query_block", "lane")
        .sortWithinPartitions("query_block", "lane", "kind", F.desc("longest"))
        .mapInArrow(run, "query_id long, vec_id long, score long")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
