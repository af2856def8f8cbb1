"""Quality and latency of a scorer, and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import STEPS_PER_EPOCH, TIERS
from ..functions.labels import loss_reduction, predicted_tier, tier_expected, tier_is_correct
from .positions import exact_quantiles


def tier_metrics(cases: DataFrame) -> DataFrame:
    """Cases, mean absolute error, tier accuracy and mean score, overall (null tier) and per tier."""
    tier, score = F.col("tier"), F.col("score")
    judged = cases.where(tier.isin(TIERS)).select(
        "tier",
        "score",
        F.abs(score - tier_expected(tier)).alias("miss"),
        tier_is_correct(tier, score).cast("int").alias("ok"),
    )
    return judged.rollup("tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("miss").alias("mae"),
        (F.avg("ok") * 100).alias("accuracy"),
        F.avg("score").alias("mean_score"),
    )


def confusion(cases: DataFrame) -> DataFrame:
    """Actual tier by predicted tier, 0 where a prediction does not occur."""
    wide = (
        cases.where(F.col("tier").isNotNull())
        .withColumn("pred", predicted_tier(F.col("score")))
        .groupBy("tier")
        .pivot("pred", TIERS)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
    return wide.select("tier", *[F.col(t).alias(t.lower()) for t in TIERS])


def score_histogram(cases: DataFrame) -> DataFrame:
    """Cases per tier and unit bin 0..10; the last bin is closed at 11."""
    score = F.col("score")
    counted = (
        cases.where(score.between(0, 11))
        .groupBy("tier", F.least(F.floor(score), F.lit(10)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # 3 tiers by 11 bins, built from literals.
    bins = cases.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")).select(
        "tier", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("bin")
    )
    return bins.join(counted, ["tier", "bin"], "left").select("tier", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def latency_quantiles(cases: DataFrame) -> DataFrame:
    """Exact median and 95th percentile of the latency over all cases."""
    q = exact_quantiles(cases, "latency_ms", [0.5, 0.95])
    return q.select("n", F.col("quantiles")[0].alias("median_ms"), F.col("quantiles")[1].alias("p95_ms"))


def latency_box(cases: DataFrame) -> DataFrame:
    """Box-plot numbers per tier: quartiles, whiskers within 1.5 IQR, points beyond them."""
    cases = cases.where(F.col("tier").isin(TIERS))
    q = exact_quantiles(cases, "latency_ms", [0.25, 0.5, 0.75], ["tier"])
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
    fences = q.select(
        F.col("tier").alias("_tier"),
        q1.alias("q1"),
        F.col("quantiles")[1].alias("median"),
        q3.alias("q3"),
        (q1 - 1.5 * (q3 - q1)).alias("_low"),
        (q3 + 1.5 * (q3 - q1)).alias("_high"),
    )
    # Equal latencies as one row: the tier's rows never meet in one task.
    counted = cases.where(F.col("latency_ms").isNotNull() & ~F.isnan(F.col("latency_ms").cast("double"))).groupBy("tier", "latency_ms").agg(F.count(F.lit(1)).alias("_n"))
    value = F.col("latency_ms").cast("double")
    inside = value.between(F.col("_low"), F.col("_high"))
    joined = counted.join(F.broadcast(fences), F.col("tier") == F.col("_tier"))  # three rows
    ends = joined.groupBy("tier", "q1", "median", "q3").agg(
        F.min(F.when(inside, value)).alias("_min"),
        F.max(F.when(inside, value)).alias("_max"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(F.lit(0))).alias("outliers"),
    )
    return ends.select(
        "tier", "q1", "median", "q3",
        F.least("_min", "q1").alias("whisker_low"),
        F.greatest("_max", "q3").alias("whisker_high"),
        "outliers",
    )


def loss_summary(log: DataFrame, run: str = "run") -> DataFrame:
    """First and last loss, logged steps, last step and reduction in percent per training run."""
    ends = log.groupBy(run).agg(
        F.min_by("loss", "step").alias("first"),
        F.max_by("loss", "step").alias("last"),
        F.count(F.lit(1)).alias("steps"),
        F.max("step").alias("last_step"),
    )
    return ends.withColumn("reduction", loss_reduction(F.col("first"), F.col("last")))


def loss_by_epoch(log: DataFrame, run: str = "run", steps_per_epoch: int = STEPS_PER_EPOCH) -> DataFrame:
    """Logged steps and last loss per training run and epoch."""
    epoch = F.ceil(F.col("step") / steps_per_epoch)
    return log.groupBy(run, epoch.alias("epoch")).agg(
        F.count(F.lit(1)).alias("steps"), F.max_by("loss", "step").alias("last")
    )
