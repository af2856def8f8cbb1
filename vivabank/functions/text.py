"""Text normal forms and word functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import EVAL_STOPWORDS, QUESTION_PREFIXES

# The characters Python's str.strip() and str.split() treat as blank.
_BLANK_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
BLANKS = "".join(map(chr, _BLANK_CODES))
# The same set for Java regular expressions; needs the (?U) flag.
BLANK_CLASS = r"[\s\x1c-\x1f]"

_PREFIX_RE = (
    "(?iU)^(?:" + "|".join(QUESTION_PREFIXES) + f"){BLANK_CLASS}*:{BLANK_CLASS}*"
)


def text_or(c: Column, default: str) -> Column:
    """The value as text, with ``default`` standing for null."""
    return F.coalesce(c.cast("string"), F.lit(default))


def strip(c: Column) -> Column:
    """Remove blanks at both ends (all Unicode blanks, not just spaces)."""
    return F.btrim(c, F.lit(BLANKS))


def display_question(q: Column) -> Column:
    """The question without blanks around it and without one leading prefix."""
    return strip(F.regexp_replace(strip(q), _PREFIX_RE, ""))


def core_question(q: Column) -> Column:
    """Key under which variants of one question count as the same concept."""
    return F.lower(display_question(q))


def dedup_key(q: Column) -> Column:
    """Key of the bank build. Unlike ``core_question`` it keeps the prefix."""
    return F.regexp_replace(F.lower(strip(q)), f"(?U){BLANK_CLASS}+", " ")


def chat_parts(text: Column, mode: str = "charset") -> tuple[Column, Column]:
    """Question and answer of the first ``[INST] q [/INST] a`` in a chat text.

    Both are null when the text has no such pair. The answer runs to the end of
    the text. ``mode='charset'`` trims the *characters* of ``<s>`` and ``</s>``
    as the bank is defined; ``mode='tag'`` removes just the tags.
    """
    begin = F.position(F.lit("[INST]"), text)
    body = begin + F.lit(6)
    end = F.position(F.lit("[/INST]"), text, body)
    found = (begin > 0) & (end > 0)
    question = strip(F.substr(text, body, end - body))
    answer = strip(F.substr(text, end + F.lit(7)))
    if mode == "charset":
        question = F.ltrim(question, F.lit("<s>"))
        answer = F.rtrim(answer, F.lit("</s>"))
    elif mode == "tag":
        question = F.regexp_replace(question, "^(?:<s>)+", "")
        answer = F.regexp_replace(answer, r"(?:</s>)+\z", "")
    else:
        raise ValueError(f"unknown trim mode {mode!r}")
    return F.when(found, strip(question)), F.when(found, strip(answer))


def word_count(c: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def has_three_words(stripped: Column) -> Column:
    """``word_count >= 3`` on stripped text, stopping at the third word."""
    word = r"[^\s\x1c-\x1f]+"
    return stripped.rlike(f"(?U)^{word}{BLANK_CLASS}+{word}{BLANK_CLASS}+[^\\s\\x1c-\\x1f]")


def keywords(c: Column) -> Column:
    """Distinct lower-case ``a-z`` words of three or more letters, stop words left out."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in EVAL_STOPWORDS])
    return F.array_except(words, stop)


def overlap_ratio(reference_words: Column, answer_words: Column) -> Column:
    """Share of the reference's words found in the answer; null without words."""
    n = F.size(reference_words)
    common = F.size(F.array_intersect(reference_words, answer_words))
    return F.when(n > 0, common / n)
