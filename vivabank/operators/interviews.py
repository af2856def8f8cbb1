"""Whole interviews in batch: plan the questions, pair and score the answers, fold the sessions.

``phases`` and ``blank`` are those of ``sessions``: one value goes through plan, pairing, scores and fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PHASE_LIMITS
from ..sources.durable import durable
from .pools import question_plan, question_text, validate_starts
from .scoring import ModelFactory, guard_live, score_routed
from .sessions import (
    Phases, close_sessions, first_answers, is_quit, place_answers, plan_limits, session_report, usable_rows, used_answers,
)


@dataclass(frozen=True)
class Interviews:
    """``scored``: session, seq, level, q_num, id, question, reference, answer, route, score, feedback of every answer
    that counts; ``limits``: session, easy, medium, hard; ``quits``: session, seq, answer of rows that say quit."""

    scored: DataFrame
    limits: DataFrame
    quits: DataFrame


def pair_answers(
    answers: DataFrame, plan: DataFrame, bank: DataFrame, quit_ends: bool = False, blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
) -> DataFrame:
    """The question each usable answer belongs to.

    ``answers``: session, seq, answer. Adds level, q_num, id, question and reference.
    """
    first = first_answers(answers, quit_ends, blank, phases)
    return with_questions(place_answers(first, plan_limits(plan), phases=phases), plan, bank)


def with_questions(placed: DataFrame, plan: DataFrame, bank: DataFrame) -> DataFrame:
    """Adds id, question and reference to placed answers (session, level, q_num)."""
    keys = plan.select("session", "level", "q_num", "id")
    return placed.join(keys, ["session", "level", "q_num"]).join(question_text(bank), "id")


def hold_interviews(
    starts: DataFrame,
    answers: DataFrame,
    bank: DataFrame,
    factory: ModelFactory,
    *,
    seed: int = 0,
    quit_ends: bool = False,
    blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
    **model_options,
) -> Interviews:
    """Pair and score the answers of all valid sessions.

    Questions are planned for sessions that answer. Hard answers are scored only for sessions that passed
    Medium: the model call is the dear part. Answers are paired and routed once and scores written once, so
    no model call is repeated.
    """
    rows = durable(usable_rows(answers, blank, phases), "interview-answers")
    quits = rows.where(is_quit(F.col("answer"))) if quit_ends else rows.limit(0)
    valid = validate_starts(starts, bank).where("accepted").select("session", "domain")
    valid = valid.join(rows.select("session").distinct(), "session", "left_semi")
    plan = durable(question_plan(valid, bank, seed, phases), "interview-plan")
    limits = durable(plan_limits(plan), "interview-limits")
    first = first_answers(rows.drop("pos"), quit_ends, blank, phases)
    paired = with_questions(place_answers(first, limits, phases=phases), plan, bank)
    routed = durable(guard_live(paired), "interview-routes")
    early = durable(score_routed(routed.where("level <> 'Hard'"), factory, **model_options), "scores-early")
    passed = used_answers(first_answers(early, False, blank, phases), limits, phases=phases).where("_passed")
    hard = routed.where("level = 'Hard'").join(passed.select("session").distinct(), "session", "left_semi")
    late = durable(score_routed(hard, factory, **model_options), "scores-late")
    return Interviews(early.unionByName(late), limits, quits.select("session", "seq", "answer"))


def score_sessions(starts: DataFrame, answers: DataFrame, bank: DataFrame, factory: ModelFactory, **options) -> tuple[DataFrame, DataFrame]:
    """Scored answers of all valid sessions, and the phase limits they were folded with; see ``hold_interviews``."""
    held = hold_interviews(starts, answers, bank, factory, **options)
    return held.scored, held.limits


def run_interviews(
    starts: DataFrame, answers: DataFrame, bank: DataFrame, factory: ModelFactory, *, blank: str = "skip",
    phases: Phases = PHASE_LIMITS, **options,
) -> DataFrame:
    """Last state of every session that answered, in the columns of ``session_fold``."""
    held = hold_interviews(starts, answers, bank, factory, blank=blank, phases=phases, **options)
    log = held.scored.select("session", "seq", "score", "answer")
    return close_sessions(used_answers(first_answers(log, False, blank, phases), held.limits, phases=phases))


def interview_report(
    starts: DataFrame, answers: DataFrame, bank: DataFrame, factory: ModelFactory, *, quit_ends: bool = False,
    blank: str = "skip", phases: Phases = PHASE_LIMITS, **options,
) -> DataFrame:
    """Wrap-up record of every session that answered, with questions, answers and feedback; see ``session_report``."""
    held = hold_interviews(starts, answers, bank, factory, quit_ends=quit_ends, blank=blank, phases=phases, **options)
    log = held.scored.select("session", "seq", "score", "answer", "question", "feedback")
    if quit_ends:
        log = log.unionByName(held.quits, allowMissingColumns=True)
    return session_report(log, held.limits, quit_ends=quit_ends, blank=blank, phases=phases)
