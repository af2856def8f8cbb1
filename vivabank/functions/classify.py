"""Domain and level of a question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DEFAULT_DOMAIN, DEFAULT_LEVEL, DOMAIN_LEXICON, LEVEL_ALIASES
from .text import strip


def keyword_hits(lowered: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` occur in the text as substrings (presence only).

    A plain sum stays in generated code; a lambda over the word list takes three
    times as long.
    """
    hits = F.lit(0)
    for word in words:
        hits += F.contains(lowered, F.lit(word)).cast("int")
    return hits


def infer_domain(
    text: Column,
    lexicon: Mapping[str, Sequence[str]] = DOMAIN_LEXICON,
    default: str = DEFAULT_DOMAIN,
) -> Column:
    """Domain with the most keyword hits; a tie goes to the one listed first."""
    lowered = F.lower(text)
    ranked = [
        F.struct(
            keyword_hits(lowered, words).alias("hits"),
            F.lit(-place).alias("place"),
            F.lit(domain).alias("domain"),
        )
        for place, (domain, words) in enumerate(lexicon.items())
    ]
    # A no-hit entry ahead of every domain with zero hits.
    ranked.append(F.struct(F.lit(0).alias("hits"), F.lit(1).alias("place"), F.lit(default).alias("domain")))
    return F.array_max(F.array(*ranked))["domain"]


def map_level(
    raw: Column,
    aliases: Mapping[str, str] = LEVEL_ALIASES,
    default: str = DEFAULT_LEVEL,
) -> Column:
    """Bank level of a source's level text."""
    entries = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(strip(raw))), F.lit(default))
