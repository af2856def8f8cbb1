"""Assessment sessions: ordered answers folded through Easy, Medium and Hard.

A session never uses more answers than the lengths of its phases add up to. The
log is cut to that many rows per session before the shuffle (Spark pushes the row
number limit there), so everything after it works on small groups, and a session
that holds a large share of the log costs no more than any other.

Tables: ``log`` has session, seq, score and may have answer; ``limits`` has
session, easy, medium, hard — the questions a session can get per phase, when a
pool may run out. ``phases`` are the full lengths of the phases, the same for all
sessions and for every function that works on one log; ``blank`` tells whether a
blank answer is skipped or counts with no marks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.fixed_values import LEVELS, MAX_MARKS, PASS_THRESHOLD, PHASE_LIMITS, QUIT_WORD
from ..functions.text import strip, text_or

Phases = Mapping[str, int]


def medium_full(phases: Phases = PHASE_LIMITS) -> int:
    """Marks of a full Medium phase: its average counts every question, asked or not."""
    return phases["Medium"] * MAX_MARKS


def medium_pass(phases: Phases = PHASE_LIMITS) -> int:
    """Least marks that pass Medium."""
    return math.ceil(round(PASS_THRESHOLD * medium_full(phases), 6))


def _phases() -> tuple[Column, Column, Column]:
    """Phase lengths of the session, as columns."""
    return F.col("_e"), F.col("_m"), F.col("_h")


def is_quit(answer: Column) -> Column:
    return F.lower(strip(text_or(answer, ""))) == QUIT_WORD


def is_blank(answer: Column) -> Column:
    return strip(text_or(answer, "")) == ""


def usable_rows(log: DataFrame, blank: str = "skip", phases: Phases = PHASE_LIMITS) -> DataFrame:
    """The first rows of every session that ``blank`` leaves, as many as a session can use."""
    if blank not in ("skip", "score"):
        raise ValueError(f"unknown choice {blank!r} for blank")
    if "answer" in log.columns:
        if blank == "skip":
            log = log.where(~is_blank(F.col("answer")))
        elif "score" in log.columns:
            log = log.withColumn("score", F.when(is_blank(F.col("answer")), F.lit(0)).otherwise(F.col("score")))
    order = Window.partitionBy("session").orderBy("seq")
    return log.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= sum(phases.values()))


def first_answers(
    log: DataFrame, quit_ends: bool = False, blank: str = "skip", phases: Phases = PHASE_LIMITS
) -> DataFrame:
    """The answers a session can use, with their 1-based ``pos``.

    Blank answers are ignored, or count with no marks (``blank="score"``). With ``quit_ends``
    the word quit ends the session: that row and all later ones are dropped.
    """
    first = usable_rows(log, blank, phases)
    if quit_ends:
        so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        quitting = F.max(is_quit(F.col("answer")).cast("int")).over(so_far)
        first = first.withColumn("_quit", quitting).where("_quit = 0").drop("_quit")
    return first


def _with_limits(first: DataFrame, limits: DataFrame | None, on_empty_easy: str, phases: Phases) -> DataFrame:
    """Add the phase lengths _e, _m, _h of every session."""
    if limits is None:
        return first.withColumns({c: F.lit(phases[x]) for c, x in zip(("_e", "_m", "_h"), LEVELS)})
    capped = limits.select(
        "session",
        *[F.least(F.col(x.lower()), F.lit(phases[x])).cast("int").alias(c) for c, x in zip(("_e", "_m", "_h"), LEVELS)],
    )
    if on_empty_easy == "reject":
        capped = capped.where("_e > 0")
    elif on_empty_easy != "advance":
        raise ValueError(f"unknown choice {on_empty_easy!r} for on_empty_easy")
    return first.join(capped, "session")


def _level_and_place(df: DataFrame) -> DataFrame:
    """Add level and q_num of the answer at ``pos``."""
    easy, med, _ = _phases()
    level = (
        F.when(F.col("pos") <= easy, F.lit("Easy"))
        .when(F.col("pos") <= easy + med, F.lit("Medium"))
        .otherwise(F.lit("Hard"))
    )
    before = F.when(F.col("level") == "Easy", F.lit(0)).when(F.col("level") == "Medium", easy).otherwise(easy + med)
    return df.withColumn("level", level).withColumn("q_num", (F.col("pos") - before).cast("int"))


def place_answers(
    first: DataFrame, limits: DataFrame | None = None, on_empty_easy: str = "reject", phases: Phases = PHASE_LIMITS
) -> DataFrame:
    """Level and q_num of answers not scored yet, as far as the phases go."""
    easy, med, hard = _phases()
    placed = _with_limits(first, limits, on_empty_easy, phases).where(F.col("pos") <= easy + med + hard)
    return _level_and_place(placed).drop("_e", "_m", "_h", "pos")


def used_answers(
    first: DataFrame, limits: DataFrame | None = None, on_empty_easy: str = "reject", phases: Phases = PHASE_LIMITS
) -> DataFrame:
    """Answers that count, with level, q_num and the state of the Medium gate.

    Medium is passed on the sum of its scores against the full phase, so a pool
    that ran out counts as zero marks for the questions it could not ask.
    """
    easy, med, hard = _phases()
    session = Window.partitionBy("session")
    medium = F.col("pos").between(easy + 1, easy + med)
    gated = (
        _with_limits(first, limits, on_empty_easy, phases)
        .withColumn("_medium_sum", F.coalesce(F.sum(F.when(medium, F.col("score"))).over(session), F.lit(0)))
        .withColumn("_n", F.count(F.lit(1)).over(session))
    )
    passed = (F.col("_n") >= easy + med) & (F.col("_medium_sum") >= medium_pass(phases))
    gated = gated.withColumn("_passed", passed)
    last = F.when(F.col("_passed"), easy + med + hard).otherwise(easy + med)
    return _level_and_place(gated.where(F.col("pos") <= last))


def session_turns(used: DataFrame, extra: Sequence[str] = (), phases: Phases = PHASE_LIMITS) -> DataFrame:
    """State of the session after each used answer.

    next_level and next_q_num describe the next question; next_q_num is null
    when the session is complete. ``message`` is the phase message of the turn.
    """
    run = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    easy, med, hard = _phases()
    pos = F.col("pos")
    ends_easy = pos == easy
    # Easy may end with no Medium question to ask: Medium then ends in the same turn.
    ends_medium = pos == easy + med
    ends_hard = (pos == easy + med + hard) & F.col("_passed")
    ratio = F.col("_medium_sum") / F.lit(float(medium_full(phases)))
    message = (
        F.when(ends_hard, F.lit(labels.HARD_DONE))
        .when(ends_medium, labels.medium_done(ratio, F.col("_passed")))
        .when(ends_easy, F.lit(labels.EASY_DONE))
        .otherwise(F.lit(""))
    )
    done = ends_hard | (ends_medium & ~F.col("_passed"))
    next_level = (
        F.when(ends_medium & F.col("_passed"), F.lit("Hard"))
        .when(ends_easy, F.lit("Medium"))
        .otherwise(F.col("level"))
    )
    moved = next_level != F.col("level")
    return used.select(
        "session", "seq", "pos", "level", "q_num", "score",
        F.sum("score").over(run).cast("long").alias("total"),
        (pos * MAX_MARKS).cast("long").alias("possible"),
        message.alias("message"),
        next_level.alias("next_level"),
        F.when(~done, F.when(moved, F.lit(1)).otherwise(F.col("q_num") + 1)).alias("next_q_num"),
        done.alias("done"),
        *extra,
    )


def session_fold(
    log: DataFrame,
    limits: DataFrame | None = None,
    *,
    quit_ends: bool = False,
    on_empty_easy: str = "reject",
    blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
) -> DataFrame:
    """Last state of every session with an answer: (session, difficulty, answered, total,
    possible, pct, done, verdict). The verdict is null while a session is open.

    With ``quit_ends`` there is also ``ended`` (done, or the session quit): a session that quit
    gets its verdict on what it answered, and one that quit at once stays, without a verdict.
    """
    folded = close_sessions(used_answers(first_answers(log, quit_ends, blank, phases), limits, on_empty_easy, phases))
    if not quit_ends:
        return folded
    quitting = _quitting(log, blank, limits, on_empty_easy, phases)
    quits = quitting.select(
        "session", (F.col("_e") > 0).alias("_quit_easy"), (F.col("_e") + F.col("_m") == 0).alias("_quit_done")
    ).distinct()
    # Both sides are grouped by session already.
    state = folded.join(quits, "session", "full_outer")
    # Without an answer a session is done only if it had nothing to ask.
    done = F.coalesce("done", "_quit_done")
    ended = done | F.col("_quit_done").isNotNull()
    pct = labels.percentage(F.col("total"), F.col("possible"))
    none = F.lit(0).cast("long")
    return state.select(
        "session",
        F.coalesce("difficulty", F.when(F.col("_quit_easy"), F.lit("Easy")).otherwise(F.lit("Medium"))).alias("difficulty"),
        F.coalesce("answered", none).alias("answered"),
        F.coalesce("total", none).alias("total"),
        F.coalesce("possible", none).alias("possible"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
        done.alias("done"),
        ended.alias("ended"),
        F.when(ended & (F.col("answered") > 0), labels.verdict(pct)).alias("verdict"),
    )


def _quitting(log: DataFrame, blank: str, limits: DataFrame | None, on_empty_easy: str, phases: Phases) -> DataFrame:
    """Rows with the word quit, among those that a session can use."""
    return _with_limits(usable_rows(log, blank, phases).where(is_quit(F.col("answer"))), limits, on_empty_easy, phases)


def _end_state() -> tuple[Column, Column]:
    """(difficulty, done) from the answer count and the gate, grouped by session."""
    easy, med, hard = _phases()
    n = F.col("answered")
    done = F.when(F.col("_passed"), n >= easy + med + hard).otherwise(n >= easy + med)
    difficulty = (
        F.when(n < easy, F.lit("Easy")).when(F.col("_passed"), F.lit("Hard")).otherwise(F.lit("Medium"))
    )
    return difficulty, done


def close_sessions(used: DataFrame, *aggregates: Column) -> DataFrame:
    """Fold used answers to one row per session; further aggregates are added at the end."""
    folded = used.groupBy("session", "_e", "_m", "_h", "_passed").agg(
        F.count(F.lit(1)).alias("answered"),
        F.sum("score").cast("long").alias("total"),
        F.max("_medium_sum").alias("_medium_sum"),
        *aggregates,
    )
    difficulty, done = _end_state()
    possible = F.col("answered") * MAX_MARKS
    exact = labels.percentage(F.col("total"), possible)
    named = [a for a in folded.columns if a not in {"session", "_e", "_m", "_h", "_passed", "answered", "total", "_medium_sum"}]
    return (
        folded.withColumn("possible", possible)
        .withColumn("_pct", exact)
        .withColumn("done", done)
        .select(
            "session",
            difficulty.alias("difficulty"),
            "answered",
            "total",
            "possible",
            labels.round_half_even(F.col("_pct"), 1).alias("pct"),
            "done",
            F.when(F.col("done"), labels.verdict(F.col("_pct"))).alias("verdict"),
            *named,
        )
    )


def history_items(*more: str) -> Column:
    """Used answers of a session in order, as an array of structs (at most 18)."""
    fields = ["pos", *more, "score", "level"]
    return F.array_sort(F.collect_list(F.struct(*fields)))


def lost_items(*more: str) -> Column:
    """Answers that lost marks, in order, with the marks lost."""
    lost = (F.lit(MAX_MARKS) - F.col("score")).alias("lost")
    item = F.struct("pos", *more, "score", lost, "level")
    return F.array_sort(F.collect_list(F.when(F.col("score") < MAX_MARKS, item)))


def session_report(
    log: DataFrame,
    limits: DataFrame | None = None,
    *,
    quit_ends: bool = False,
    on_empty_easy: str = "reject",
    blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
) -> DataFrame:
    """Wrap-up record per session: fold, last score and message, history and lost marks.

    Items carry question, answer and feedback where the log has them. With ``quit_ends`` a session
    that quit has ``ended`` and its verdict; one that quit at once has an empty history.
    """
    used = used_answers(first_answers(log, quit_ends, blank, phases), limits, on_empty_easy, phases)
    more = [c for c in ("question", "answer", "feedback") if c in used.columns]
    last = F.max_by("score", "pos").alias("last_score")
    phase = F.max("_medium_sum").alias("medium_score")
    report = close_sessions(
        used, last, phase, history_items(*more).alias("history"),
        lost_items(*[c for c in more if c == "question"]).alias("lost_marks"),
    )
    closing = F.when(F.col("difficulty") == "Hard", F.lit(labels.HARD_DONE)).otherwise(
        labels.medium_done(F.col("medium_score") / F.lit(float(medium_full(phases))), F.lit(False))
    )
    report = report.withColumn("message", F.when(F.col("done"), closing))
    if not quit_ends:
        return report
    ended = session_fold(
        log, limits, quit_ends=True, on_empty_easy=on_empty_easy, blank=blank, phases=phases
    )
    details = report.select("session", "last_score", "medium_score", "history", "lost_marks", "message")
    whole = ended.join(details, "session", "left")
    kinds = {f.name: f.dataType for f in report.schema.fields}
    return whole.withColumns({
        c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in ("history", "lost_marks")
    })


def wrapup_stats(report: DataFrame) -> DataFrame:
    """Figures of the wrap-up page.

    ``passed_overall`` and ``phases_shown`` follow the overall percentage, as the
    page shows them; ``passed_medium`` is the gate the session really took.
    """
    overall = F.col("pct") >= PASS_THRESHOLD * 100
    return report.select(
        "session",
        F.size("history").cast("long").alias("questions"),
        F.aggregate("lost_marks", F.lit(0), lambda acc, x: acc + x["lost"]).cast("long").alias("marks_lost"),
        overall.alias("passed_overall"),
        F.when(overall, F.lit(3)).otherwise(F.lit(2)).alias("phases_shown"),
        (F.col("difficulty") == "Hard").alias("passed_medium"),
    )


def session_status(
    starts: DataFrame,
    log: DataFrame,
    limits: DataFrame | None = None,
    plan: DataFrame | None = None,
    *,
    blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
) -> DataFrame:
    """Snapshot of every started session, with or without answers.

    ``progress`` is the share of the phase already answered. A complete session
    keeps its last phase and points one past its end. With a question plan the
    open question is added as ``question_id``.
    """
    turns = session_turns(used_answers(first_answers(log, False, blank, phases), limits, phases=phases), phases=phases)
    last = turns.groupBy("session").agg(
        F.max_by(F.struct("next_level", "next_q_num", "total", "possible", "done"), "pos").alias("s")
    )
    state = starts.join(last.select("session", "s.*"), "session", "left").withColumn(
        "difficulty", F.coalesce("next_level", F.lit("Easy"))
    )
    return open_status(state, starts.columns, plan, phases)


def open_status(
    state: DataFrame, keep: Sequence[str], plan: DataFrame | None = None, phases: Phases = PHASE_LIMITS
) -> DataFrame:
    """The snapshot out of last states (difficulty, next_q_num, total, possible, done; null before an answer)."""
    total = labels.lookup(phases, F.col("difficulty"))
    q_num = F.when(F.col("done"), total + 1).otherwise(F.coalesce("next_q_num", F.lit(1)))
    pct = labels.percentage(F.col("total"), F.col("possible"))
    status = state.select(
        *keep,
        "difficulty",
        q_num.alias("q_num"),
        total.alias("phase_total"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("possible", F.lit(0)).alias("possible"),
        F.coalesce("done", F.lit(False)).alias("done"),
        F.when(F.col("done"), labels.verdict(pct)).alias("verdict"),
        ((q_num - 1) / total).alias("progress"),
    )
    if plan is None:
        return status
    questions = plan.select(
        "session", F.col("level").alias("difficulty"), "q_num", F.col("id").alias("question_id")
    )
    # A complete session points past its phase and finds no question there.
    return status.join(questions, ["session", "difficulty", "q_num"], "left").select(*status.columns, "question_id")


def phase_flags(status: DataFrame, phases: Phases = PHASE_LIMITS) -> DataFrame:
    """One row per session and phase: short name, question count, active and done flags."""
    each = F.explode(
        F.array(*[F.struct(F.lit(x).alias("phase"), F.lit(phases[x]).alias("questions")) for x in LEVELS])
    )
    place, now = labels.level_order(F.col("p.phase")), labels.level_order(F.col("difficulty"))
    return status.select("session", "difficulty", each.alias("p")).select(
        "session",
        labels.phase_tag(F.col("p.phase")).alias("phase"),
        F.col("p.questions").alias("questions"),
        (place == now).alias("active"),
        (place < now).alias("finished"),
    )


def answer_rejects(
    starts: DataFrame,
    log: DataFrame,
    limits: DataFrame | None = None,
    *,
    on_empty_easy: str = "reject",
    blank: str = "skip",
    phases: Phases = PHASE_LIMITS,
) -> DataFrame:
    """Answers that are refused: (session, seq, reason).

    ``starts`` holds the accepted sessions (see ``validate_starts``); answers of any other are
    "session not found". The fold gives the answer that completed a session; later ones are
    refused. One row per session meets the log in a single left join, so that a session with a
    large share of the log can be split.
    """
    known = _with_limits(starts.select("session").distinct(), limits, on_empty_easy, phases).select("session", "_e", "_m")
    used = used_answers(first_answers(log, False, blank, phases), limits, on_empty_easy, phases)
    closed = close_sessions(used, F.max("seq").alias("last_seq")).where("done").select("session", "last_seq")
    # A session with nothing to ask before the gate is complete from the start.
    facts = known.join(closed, "session", "left").select(
        "session", F.lit(True).alias("_known"), (F.col("_e") + F.col("_m") == 0).alias("_closed"), "last_seq"
    )
    late = F.col("_closed") | (F.col("seq") > F.col("last_seq"))
    if blank == "skip" and "answer" in log.columns:
        late = late & ~is_blank(F.col("answer"))
    reason = F.when(F.col("_known").isNull(), F.lit("session not found")).when(late, F.lit("session complete"))
    return log.join(facts, "session", "left").select("session", "seq", reason.alias("reason")).where("reason is not null")


def session_counts(starts: DataFrame) -> DataFrame:
    """Number of started sessions, with or without answers."""
    return starts.agg(F.count_distinct("session").alias("sessions"))


def plan_limits(plan: DataFrame) -> DataFrame:
    """Questions per session and phase of a question plan, as phase limits."""
    wide = plan.groupBy("session").pivot("level", list(PHASE_LIMITS)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("session", *[F.col(x).cast("int").alias(x.lower()) for x in PHASE_LIMITS])
