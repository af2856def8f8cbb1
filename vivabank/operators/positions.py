"""Positions of rows in an order, without a window over one partition.

A window without a partition, or with a group that holds a large share of the
rows, runs in one task. Here the rows are range-partitioned by (group, order),
sorted inside the partitions and written once; a small table of counts per
(group, partition) then gives every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable


def _sorted_once(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows sorted by range partition; ``_row`` is (partition, place in it) in one long.

    The written table fixes the ranges: counting and numbering see the same ones
    even when an executor is lost in between.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return durable(ranged.withColumn("_row", F.monotonically_increasing_id()), label).withColumn(
        "_part", F.shiftright("_row", 33)
    )


def with_position(
    df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """Add the 0-based place of every row inside its group.

    ``order_by`` must tell the rows of a group apart.
    """
    rows = _sorted_once(df, [*group_by, *order_by], "positions")
    parts = rows.groupBy(*group_by, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # At most one row per (group, range partition).
    before = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group_by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    placed = _join_parts(rows, offsets, group_by)
    return placed.withColumn(out, F.col("_row") - F.col("_first") + F.col("_offset")).drop(
        "_row", "_part", "_first", "_offset"
    )


def with_running_total(
    df: DataFrame,
    order_by: Sequence[str],
    weight: str,
    group_by: Sequence[str] = (),
    out: str = "before",
    total: str = "total",
) -> DataFrame:
    """Add the sum of ``weight`` over the rows that come earlier in the group, and over the whole group."""
    rows = _sorted_once(df, [*group_by, *order_by], "running")
    parts = rows.groupBy(*group_by, "_part").agg(F.sum(weight).alias("_n"))
    group = Window.partitionBy(*group_by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group_by, "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias(total),
    )
    inside = (
        Window.partitionBy(*group_by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        _join_parts(local, offsets, group_by)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_row", "_part", "_local", "_offset")
    )


def _join_parts(rows: DataFrame, offsets: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Null-safe join on (group, partition); group keys may be null."""
    renamed = offsets.withColumnsRenamed({c: f"_k_{i}" for i, c in enumerate(group_by)}).withColumnRenamed(
        "_part", "_k_part"
    )
    on = rows["_part"] == renamed["_k_part"]
    for i, c in enumerate(group_by):
        on &= rows[c].eqNullSafe(renamed[f"_k_{i}"])
    return rows.join(renamed, on).drop("_k_part", *[f"_k_{i}" for i in range(len(group_by))])


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], group_by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one array ``quantiles`` and ``n`` per group.

    Null and NaN are left out. Equal values are counted first, so a value that fills the table is one row;
    no task ever holds a group's values.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group_by, value).agg(
        F.count(F.lit(1)).alias("_weight")
    )
    placed = with_running_total(counted, [value], "_weight", group_by, "before", "_total")
    aggregates = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("before") <= place) & (place < F.col("before") + F.col("_weight"))
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*group_by, "_total").agg(*aggregates)
    out = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        share = rank - F.floor(rank)
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(low + (high - low) * share)
    return picked.select(*group_by, F.col("_total").alias("n"), F.array(*out).alias("quantiles"))
