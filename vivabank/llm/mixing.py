"""Mixing of sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import with_position
from ..sources.durable import durable

#: Documents of a source that are drawn from together.
STRATUM = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """A number from 0 to 2**32 - 1 made from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, cap: int = 3) -> DataFrame:
    """source, source_size, source_docs, target of every source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... The targets share the sum of all
    sizes by weight; none is above ``cap`` times its source, the rest is shared by weight again: each
    target is min(cap * size, level * weight) for one level. The level is found by sums over the
    sources, a few times; only sums reach the driver.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    ranked = with_position(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out="_rank")
    ranked = durable(ranked.withColumn("_weight", F.col("_rank") % 3 + 1), "mix-sources")
    most, weight = F.lit(cap) * F.col("source_size"), F.col("_weight")
    level, capped = 0.0, -1
    while True:
        full = most < F.lit(level) * weight
        r = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, most).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(weight)).alias("open"), F.count_if(full).alias("n"),
        ).first()
        if not r.all or r.n == capped:
            break
        level, capped = (r.all - r.given) / r.open, r.n
    share = F.lit(level) * weight
    return ranked.select("source", "source_size", "source_docs", F.when(most < share, most.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", cap: int = 3) -> DataFrame:
    """Add size, source_size, target and ``copies`` to every row of docs (doc_id, text, source, ...).

    A source's rate is target / size (1 for a source without words). Each document is taken
    floor(rate) times, and once more by a hash-seeded draw whose probability is the fraction. The
    draws of about STRATUM documents of a source, sorted by size, share one hash-seeded start and step
    by the fraction, so every document's chance is exact and their sum misses by less than one copy.
    Strata split a source of any size over tasks. Null texts have size 0; a null source is a source;
    repeated rows are drawn each. Columns with the added names are replaced.
    """
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", words(F.col("text")))
    # One row per source; small or not is for Spark's own size check to say.
    targets = source_targets(sized.select("source", "size"), cap).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    # Ids may be null or repeat: the text tells such rows apart.
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = (
        sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
        .join(targets.drop("source"), "_key")
        .withColumn("_rate", rate)
        .withColumn("_h", _number(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)))
        .withColumn("_stratum", F.col("_h") % F.ceil(F.col("source_docs") / F.lit(STRATUM)))
    )
    place = F.row_number().over(Window.partitionBy("_key", "_stratum").orderBy(F.desc("size"), "_h", "doc_id"))
    start = _number(F.concat_ws(":", F.lit(seed), "_key", F.col("_stratum").cast("string"))) / F.lit(2.0**32)
    fraction = F.col("_rate") - F.floor("_rate")
    drawn = F.floor(start + place * fraction) - F.floor(start + (place - 1) * fraction)
    return rows.withColumn("copies", (F.floor("_rate") + drawn).cast("long")).drop("_key", "_rate", "_h", "_stratum", "source_docs")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every row as often as ``copies`` says, with ``columns``."""
    times = F.when(F.col("copies") > 0, F.array_repeat(F.lit(0), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("_copy", F.explode(times)).select(*columns)
