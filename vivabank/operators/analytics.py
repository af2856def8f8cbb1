"""Counts over the question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import LEVELS
from ..functions.labels import level_order
from ..functions.text import core_question, text_or
from .positions import with_position


def with_core(bank: DataFrame) -> DataFrame:
    """Add ``core``, the key of a distinct question; a missing question counts as ``nan``."""
    return bank.withColumn("core", core_question(text_or(F.col("Question"), "nan")))


def bank_cells(bank: DataFrame) -> DataFrame:
    """Distinct questions per (domain, level); rows without either key are left out."""
    keyed = with_core(bank.where(F.col("Domain").isNotNull() & F.col("Difficulty_Level").isNotNull()))
    return keyed.groupBy(F.col("Domain").alias("domain"), F.col("Difficulty_Level").alias("level")).agg(
        F.count_distinct("core").alias("unique_q")
    )


def bank_cube(bank: DataFrame) -> DataFrame:
    """Rows and distinct questions for every grouping of domain and level.

    ``gid`` tells the grouping: 0 cell, 1 domain, 2 level, 3 all. A group whose
    key is missing in the data is dropped; the overall counts keep every row.

    A distinct count over a cube would send every question text four times. Here
    the texts meet once, as distinct (domain, level, question) rows; marks on the
    first row of a question in each grouping are then summed over the cube.
    """
    keys = ["Domain", "Difficulty_Level"]
    cells = (
        with_core(bank).groupBy(*keys, "core").agg(F.count(F.lit(1)).alias("n")).repartition("core")
    )

    def first_of(*by: str) -> Column:
        """1 for one row of every question (and key), else 0."""
        order = [k for k in keys if k not in by] or keys
        return (F.row_number().over(Window.partitionBy("core", *by).orderBy(*order)) == 1).cast("int")

    flagged = cells.select(
        *keys, "n", first_of("Domain").alias("d"), first_of("Difficulty_Level").alias("l"), first_of().alias("a")
    )
    gid = F.grouping_id().cast("long")
    cubed = flagged.cube(*keys).agg(
        gid.alias("gid"),
        F.sum("n").alias("rows"),
        F.when(gid == 0, F.count(F.lit(1)))
        .when(gid == 1, F.sum("d"))
        .when(gid == 2, F.sum("l"))
        .otherwise(F.sum("a"))
        .alias("unique_q"),
    )
    domain_ok = F.col("Domain").isNotNull() | F.col("gid").isin(2, 3)
    level_ok = F.col("Difficulty_Level").isNotNull() | F.col("gid").isin(1, 3)
    groups = cubed.where(domain_ok & level_ok).select(
        F.col("Domain").alias("domain"), F.col("Difficulty_Level").alias("level"), "gid", "rows", "unique_q"
    )
    # An empty bank has a total, too.
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    empty = bank.sparkSession.range(1).select(
        none.alias("domain"), none.alias("level"), F.lit(3).cast("long").alias("gid"), zero.alias("rows"), zero.alias("unique_q")
    )
    return groups.unionByName(empty).groupBy("domain", "level", "gid").agg(
        F.sum("rows").alias("rows"), F.sum("unique_q").alias("unique_q")
    )


def bank_stats(bank: DataFrame) -> DataFrame:
    """The statistics record as rows (metric, key, ord, value).

    Everything comes out of one cube; the three levels are always listed.
    """
    cube = bank_cube(bank)
    per = F.when(F.col("gid") == 3, F.lit("total")).when(F.col("gid") == 1, F.lit("per_domain")).when(
        F.col("gid") == 2, F.lit("per_level")
    ).otherwise(F.lit("unique_per_cell"))
    key = F.when(F.col("gid") == 0, F.concat_ws(" | ", "domain", "level")).otherwise(
        F.coalesce("domain", "level", F.lit(""))
    )
    value = F.when(F.col("gid") == 0, F.col("unique_q")).otherwise(F.col("rows"))
    one = F.struct(per.alias("metric"), key.alias("key"), value.alias("value"))
    concepts = F.struct(F.lit("unique_q").alias("metric"), F.lit("").alias("key"), F.col("unique_q").alias("value"))
    base = cube.select(F.inline(F.when(F.col("gid") == 3, F.array(one, concepts)).otherwise(F.array(one))))
    # The three levels with 0, so that one that does not occur still gets its line.
    zeros = bank.sparkSession.range(1).select(
        F.lit("per_level").alias("metric"),
        F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("key"),
        F.lit(0).cast("long").alias("value"),
    )
    merged = base.unionByName(zeros).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    place = F.when(F.col("metric") == "per_level", F.coalesce(level_order(F.col("key")), F.lit(4))).otherwise(F.lit(0))
    return merged.select("metric", "key", place.alias("ord"), "value")


def bank_pivot(bank: DataFrame) -> DataFrame:
    """Rows per domain and level, 0 where a level does not occur."""
    keyed = bank.where(F.col("Domain").isNotNull() & F.col("Difficulty_Level").isNotNull())
    wide = keyed.groupBy("Domain").pivot("Difficulty_Level", LEVELS).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select(F.col("Domain").alias("domain"), *[F.col(x).alias(x.lower()) for x in LEVELS])


def domain_list(bank: DataFrame) -> DataFrame:
    """The sorted distinct domains with their 1-based menu number."""
    domains = bank.where(F.col("Domain").isNotNull()).select(F.col("Domain").alias("domain")).distinct()
    return with_position(domains, ["domain"], out="_place").select(
        (F.col("_place") + 1).alias("ord"), "domain"
    )


def first_seen_domains(bank: DataFrame, order: str = "ID") -> DataFrame:
    """The distinct domains in the order they occur first: (ord, domain), from 1.

    Domains meet as one row each, so the order is over as many rows as there are names.
    """
    first = bank.where(F.col("Domain").isNotNull()).groupBy(F.col("Domain").alias("domain")).agg(F.min(order).alias("_seen"))
    return with_position(first, ["_seen", "domain"], out="_place").select((F.col("_place") + 1).alias("ord"), "domain")


def stats_lines(bank: DataFrame) -> DataFrame:
    """The statistics text: a total line, then one line per cell in key order, out of one cube.

    Order by (section, domain, level) to read or write the lines.
    """
    total = F.col("gid") == 3
    line = F.when(total, F.format_string("Total rows: %d", "rows")).otherwise(
        F.format_string("%s | %s | %d unique", "domain", "level", "unique_q")
    )
    return bank_cube(bank).where("gid in (0, 3)").select(
        F.when(total, F.lit(0)).otherwise(F.lit(1)).alias("section"), "domain", "level", line.alias("line")
    )


def summary_lines(bank: DataFrame) -> DataFrame:
    """The aligned summary a build prints, one line per cell."""
    return bank_cells(bank).select(
        "domain", "level",
        F.format_string("  %-38s %-8s %4d unique questions", "domain", "level", "unique_q").alias("line"),
    )
