"""Marks, verdicts, tiers and the texts shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    BAND_PASS_FROM, BAND_SIGNAL_FROM, EASY_DONE, HARD_DONE, LEANING_HIRE, LEANING_HIRE_ADVICE, LEANING_HIRE_FROM, LEVELS,
    MEDIUM_DONE, MEDIUM_FAILED, MEDIUM_PASSED, NO_HIRE, NO_HIRE_ADVICE, PASS_THRESHOLD, PHASE_LIMITS, STRONG_HIRE,
    STRONG_HIRE_ADVICE, STRONG_HIRE_FROM, TIER_EXPECTED, TIER_M_FROM, TIER_NAMES, TIER_P_FROM, TIER_RIGHT,
)


def percentage(total: Column, possible: Column) -> Column:
    """Unrounded percentage, 0 when nothing was asked."""
    return F.when(possible > 0, total / possible * F.lit(100.0)).otherwise(F.lit(0.0))


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def _by_percentage(pct: Column, strong: str, leaning: str, no: str) -> Column:
    return F.when(pct >= STRONG_HIRE_FROM, F.lit(strong)).when(pct >= LEANING_HIRE_FROM, F.lit(leaning)).otherwise(F.lit(no))


def verdict(pct: Column) -> Column:
    """Verdict on the unrounded percentage."""
    return _by_percentage(pct, STRONG_HIRE, LEANING_HIRE, NO_HIRE)


def verdict_advice(pct: Column) -> Column:
    """The verdict with its advice, as the session overview prints it."""
    return _by_percentage(pct, STRONG_HIRE_ADVICE, LEANING_HIRE_ADVICE, NO_HIRE_ADVICE)


def places(x: Column, n: int) -> Column:
    """A number with ``n`` decimal places, half to even."""
    return F.format_string(f"%.{n}f", F.bround(x, n))


def overall_line(total: Column, possible: Column) -> Column:
    """The result line of the session overview; null if nothing was asked."""
    line = F.concat(
        F.lit("Overall Result: "), places(total.cast("double"), 1), F.lit(" / "), possible.cast("string"), F.lit(" ("),
        places(percentage(total, possible), 1), F.lit("%)"),
    )
    return F.when(possible > 0, line)


def lost_line(question: Column, score: Column) -> Column:
    """The two lines of the session overview on a question that lost marks."""
    marks = F.lit(10) - score
    return F.concat(
        F.lit("- Q: "), question, F.lit("\n  Score: "), score.cast("string"), F.lit("/10 (-"), marks.cast("string"), F.lit(" marks)")
    )


def grouped(n: Column) -> Column:
    """A whole number with separators between thousands."""
    return F.format_number(n, 0)


def score_band(score: Column) -> Column:
    return (
        F.when(score >= BAND_PASS_FROM, F.lit("pass")).when(score >= BAND_SIGNAL_FROM, F.lit("signal")).otherwise(F.lit("fail"))
    )


def predicted_tier(score: Column) -> Column:
    return F.when(score >= TIER_P_FROM, F.lit("P")).when(score >= TIER_M_FROM, F.lit("M")).otherwise(F.lit("W"))


def tier_is_correct(tier: Column, score: Column) -> Column:
    """Wider bounds than ``predicted_tier``: 7 passes as P, 3 counts for M and W."""
    (best, _), (low, high), (_, worst) = TIER_RIGHT["P"], TIER_RIGHT["M"], TIER_RIGHT["W"]
    return (
        F.when(tier == "P", score >= best)
        .when(tier == "M", score.between(low, high))
        .when(tier == "W", score <= worst)
        .otherwise(F.lit(False))
    )


def lookup(values: dict, key: Column) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def tier_expected(tier: Column) -> Column:
    return lookup(TIER_EXPECTED, tier)


def tier_name(tier: Column) -> Column:
    return lookup(TIER_NAMES, tier)


def phase_limit(level: Column) -> Column:
    return lookup(PHASE_LIMITS, level)


def level_order(level: Column) -> Column:
    """1, 2, 3 for Easy, Medium, Hard."""
    return lookup({name: place for place, name in enumerate(LEVELS, 1)}, level)


def phase_tag(level: Column) -> Column:
    return F.upper(F.substring(level, 1, 3))


def level_letter(level: Column) -> Column:
    return F.substring(level, 1, 1)


def ordinal(n: Column, width: int = 2) -> Column:
    """Zero-padded number; wider numbers are not cut."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def whole_percent(ratio: Column) -> Column:
    """A ratio as a percentage without decimals, half to even."""
    return F.concat(F.bround(ratio * F.lit(100.0), 0).cast("int").cast("string"), F.lit("%"))


def medium_done(ratio: Column, passed: Column) -> Column:
    head, tail = MEDIUM_DONE.split("{ratio}")
    failed = MEDIUM_FAILED.format(threshold=f"{PASS_THRESHOLD * 100:.0f}%")
    outcome = F.when(passed, F.lit(MEDIUM_PASSED)).otherwise(F.lit(failed))
    return F.concat(F.lit(head), whole_percent(ratio), F.lit(tail), outcome)


def loss_reduction(first: Column, last: Column) -> Column:
    return (first - last) / F.nullif(first, F.lit(0.0)) * F.lit(100.0)
