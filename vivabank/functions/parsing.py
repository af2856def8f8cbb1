"""Scores and feedback out of model replies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import FEEDBACK_DEFAULT, FEEDBACK_NO_SCORE, MAX_MARKS
from .text import BLANK_CLASS, strip

_FEEDBACK_RE = r"(?is)<feedback>(.*?)</feedback>"
_SCORE_RE = rf"(?iU)<score>{BLANK_CLASS}*(\d+){BLANK_CLASS}*</score>"
_LABELLED_RE = rf"(?iU)score{BLANK_CLASS}*:?{BLANK_CLASS}*(\d+)"
# A whole-word number of value 0..10, leading zeros allowed.
_SMALL_NUMBER_RE = r"(?U)\b0*(10|\d)\b"
_DIGITS_RE = r"(?U)(\d+)"


#: Decimal digits of other scripts, and the ASCII digits they stand for.
_DECIMALS = [chr(c) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None]
_FROM, _TO = "".join(_DECIMALS), "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)


def ascii_digits(text: Column) -> Column:
    """``text`` with every decimal digit as 0 to 9."""
    return F.translate(text, _FROM, _TO)


def clamp_digits(digits: Column, top: int = MAX_MARKS) -> Column:
    """A run of digits of any length as an int in ``0..top``; digits that cannot be read give 0."""
    significant = F.ltrim(ascii_digits(digits), F.lit("0"))
    value = F.coalesce(F.concat(F.lit("0"), significant).try_cast("int"), F.lit(0))
    return F.when(F.length(significant) > 9, F.lit(top)).otherwise(F.least(value, F.lit(top)))


def parse_tagged(reply: Column, top: int = MAX_MARKS) -> tuple[Column, Column]:
    """(score, feedback) of a reply in ``<feedback>…</feedback><score>n</score>`` form.

    Without a readable score the answer gets 0 and a fixed text, whatever the
    feedback tag said; an empty feedback tag is kept as empty text.
    """
    digits = F.regexp_extract(reply, _SCORE_RE, 1)
    scored = digits != ""
    said = F.when(
        reply.rlike(_FEEDBACK_RE), strip(F.regexp_extract(reply, _FEEDBACK_RE, 1))
    ).otherwise(F.lit(FEEDBACK_DEFAULT))
    score = F.when(scored, clamp_digits(digits, top)).otherwise(F.lit(0))
    feedback = F.when(scored, said).otherwise(F.lit(FEEDBACK_NO_SCORE))
    return score, feedback


def parse_numeric(reply: Column, top: int = MAX_MARKS) -> Column:
    """Score of a free reply: a labelled score, else the last number in 0..10,
    else the first run of digits, else 0."""
    reply = ascii_digits(reply)
    labelled = F.regexp_extract(reply, _LABELLED_RE, 1)
    small = F.try_element_at(F.regexp_extract_all(reply, F.lit(_SMALL_NUMBER_RE), F.lit(1)), F.lit(-1))
    first = F.regexp_extract(reply, _DIGITS_RE, 1)
    return (
        F.when(labelled != "", clamp_digits(labelled, top))
        .when(small.isNotNull(), small.try_cast("int"))
        .when(first != "", clamp_digits(first, top))
        .otherwise(F.lit(0))
    )
