"""Text templates rendered as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import EVAL_PROMPT, LIVE_PROMPT, SFT_TEMPLATE
from .text import text_or


def render(template: str, **values: Column) -> Column:
    """``{name}`` slots of the template filled from columns, in one concat."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*columns)


def live_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return render(LIVE_PROMPT, question=question, reference=reference, answer=answer)


def eval_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return render(EVAL_PROMPT, question=question, reference=reference, answer=answer)


def sft_text(domain: Column, level: Column, question: Column, answer: Column) -> Column:
    """One training text; a missing value prints as ``nan``."""
    return render(
        SFT_TEMPLATE,
        domain=text_or(domain, "nan"),
        level=text_or(level, "nan"),
        question=text_or(question, "nan"),
        answer=text_or(answer, "nan"),
    )
