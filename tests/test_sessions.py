"""Batch and streaming sessions against a plain state machine."""

import random

import pytest
from machine import LIMITS, run
from pyspark.sql import functions as F

from vivabank.operators import sessions as ops
from vivabank.sources import durable
from vivabank.streaming import session_stream as stream

LOG = "session long, seq long, score int, answer string"


def make_log(seed, sessions=60, low=5):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        n = r.choice([0, 1, 3, 5, 6, 12, 13, 14, 17, 18, 19, 25, 40])
        base = r.randint(low, 9)
        for _ in range(n):
            text = r.choice(["fine answer"] * 12 + ["  ", "", "\t", " QUIT "])
            rows.append((s, len(rows), max(0, min(10, base + r.randint(-2, 2))), text))
    r.shuffle(rows)
    return rows


def make_pools(seed, sessions=60):
    r = random.Random(seed)
    return {
        s: {"Easy": r.choice([0, 1, 3, 5, 9]), "Medium": r.choice([0, 5, 6, 8, 20]), "Hard": r.choice([0, 1, 5, 6])}
        for s in range(sessions)
    }


def folds(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("quit_ends", [False, True])
@pytest.mark.parametrize("pools", ["none", "reject", "advance"])
def test_fold_and_turns(spark, quit_ends, pools):
    log = make_log(11)
    df = spark.createDataFrame(log, LOG).repartition(4)
    limits = limits_df = None
    choice = "reject" if pools == "none" else pools
    if pools != "none":
        limits = make_pools(5)
        limits_df = spark.createDataFrame(
            [(s, p["Easy"], p["Medium"], p["Hard"]) for s, p in limits.items()], "session long, easy int, medium int, hard int"
        )
    expected, _ = run(log, limits, quit_ends, choice)
    got = folds(ops.session_fold(df, limits_df, quit_ends=quit_ends, on_empty_easy=choice))
    assert got == {k: s.ended_fold() if quit_ends else s.fold() for k, s in expected.items()}

    used = ops.used_answers(ops.first_answers(df, quit_ends), limits_df, choice)
    turns = {}
    for t in ops.session_turns(used).orderBy("session", "pos").collect():
        turns.setdefault(t.session, []).append(
            (t.seq, t.level, t.q_num, t.total, t.possible, t.message, t.next_level, t.next_q_num, t.done)
        )
    assert turns == {k: s.turns for k, s in expected.items() if s.turns}


@pytest.mark.parametrize("pools", [False, True])
def test_blank_answers_can_count(spark, pools):
    log = make_log(21)
    df = spark.createDataFrame(log, LOG).repartition(4)
    limits = {k: p for k, p in make_pools(6).items()} if pools else None
    limits_df = spark.createDataFrame(
        [(s, p["Easy"], p["Medium"], p["Hard"]) for s, p in limits.items()], "session long, easy int, medium int, hard int"
    ) if pools else None
    expected, refused = run(log, limits, blank="score")
    assert folds(ops.session_fold(df, limits_df, blank="score")) == {k: s.fold() for k, s in expected.items()}
    starts = spark.createDataFrame([(k,) for k in expected], "session long")
    late = ops.answer_rejects(starts, df, limits_df, blank="score").where("reason = 'session complete'")
    assert {(r.session, r.seq) for r in late.collect()} == set(refused)


def test_a_session_that_quits_at_once_stays(spark):
    df = spark.createDataFrame([(1, 1, 9, " QUIT "), (1, 2, 9, "x"), (2, 1, 9, "x"), (2, 2, 9, "quit")], LOG)
    assert folds(ops.session_fold(df, quit_ends=True)) == {
        1: ("Easy", 0, 0, 0, 0.0, False, True, None),
        2: ("Easy", 1, 9, 10, 90.0, False, True, "STRONG HIRE"),
    }


def test_rejects_follow_the_limits(spark):
    """Limits 2/1/0: done after three answers; without a Medium question nor an Easy one, done at the start."""
    df = spark.createDataFrame([(s, i, 9, "x") for s in (1, 2, 3) for i in range(6)], LOG)
    limits = spark.createDataFrame([(1, 2, 1, 0), (2, 0, 0, 5)], "session long, easy int, medium int, hard int")
    starts = spark.createDataFrame([(1,), (2,)], "session long")
    got = {tuple(r) for r in ops.answer_rejects(starts, df, limits, on_empty_easy="advance").collect()}
    want = {(1, i, "session complete") for i in range(3, 6)} | {(2, i, "session complete") for i in range(6)}
    assert got == want | {(3, i, "session not found") for i in range(6)}
    refused = {tuple(r) for r in ops.answer_rejects(starts, df, limits).collect()}
    assert refused == {(1, i, "session complete") for i in range(3, 6)} | {
        (s, i, "session not found") for s in (2, 3) for i in range(6)
    }


@pytest.mark.parametrize("medium_sum, level", [(55, "Medium"), (56, "Hard")])
def test_gate(spark, medium_sum, level):
    scores = [0] * 5 + [7] * 7 + [medium_sum - 49]
    df = spark.createDataFrame([(1, i, s, "x") for i, s in enumerate(scores)], LOG)
    row = ops.session_fold(df).collect()[0]
    assert (row.difficulty, row.done) == (level, level == "Medium")


def test_five_medium_questions_never_pass(spark):
    df = spark.createDataFrame([(1, i, 10, "x") for i in range(12)], LOG)
    limits = spark.createDataFrame([(1, 5, 5, 5)], "session long, easy int, medium int, hard int")
    row = ops.session_fold(df, limits).collect()[0]
    assert (row.difficulty, row.answered, row.done, row.verdict) == ("Medium", 10, True, "STRONG HIRE")


def test_report_and_wrapup(spark):
    log = make_log(3)
    df = spark.createDataFrame(log, LOG)
    expected, _ = run(log)
    report = ops.session_report(df)
    stats = {r.session: r for r in ops.wrapup_stats(report).collect()}
    scores = {(s, q): sc for s, q, sc, _ in log}
    for r in report.collect():
        s = expected[r.session]
        own = [scores[(r.session, t[0])] for t in s.turns]
        assert [h.score for h in r.history] == own and [h.pos for h in r.history] == list(range(1, len(own) + 1))
        assert [(x.score, x.lost) for x in r.lost_marks] == [(x, 10 - x) for x in own if x < 10]
        assert r.last_score == own[-1] and r.message == (s.message if s.done else None)
        w = stats[r.session]
        assert w.questions == len(own) and w.marks_lost == sum(10 - x for x in own)
        assert w.passed_overall == (r.pct >= 70) and w.phases_shown == (3 if r.pct >= 70 else 2)
        assert w.passed_medium == (s.level == "Hard")


def test_rejects_and_status(spark):
    log = make_log(8)
    df = spark.createDataFrame(log, LOG)
    starts = spark.createDataFrame([(s,) for s in range(10, 70)], "session long")
    known = [r for r in log if r[0] >= 10]
    expected, refused = run(known)
    want = {(k, q, "session complete") for k, q in refused}
    want |= {(k, q, "session not found") for k, q, _, _ in log if k < 10}
    assert {tuple(r) for r in ops.answer_rejects(starts, df).collect()} == want

    status = {r.session: r for r in ops.session_status(starts, df).collect()}
    assert len(status) == 60
    for k, r in status.items():
        s = expected.get(k)
        if s is None:
            assert (r.difficulty, r.q_num, r.phase_total, r.total, r.done, r.progress) == ("Easy", 1, 5, 0, False, 0.0)
        else:
            assert (r.difficulty, r.q_num, r.phase_total) == (s.level, s.asked + 1, LIMITS[s.level])
            assert (r.total, r.possible, r.done, r.verdict) == (s.total, s.possible, s.done, s.fold()[-1])
            assert r.progress == pytest.approx(s.asked / LIMITS[s.level])
    plan = spark.createDataFrame(
        [(k, x, q, 1000 * k + q) for k in range(10, 70) for x, n in LIMITS.items() for q in range(1, n + 1)],
        "session long, level string, q_num int, id long",
    )
    open_now = {r.session: r.question_id for r in ops.session_status(starts, df, plan=plan).collect()}
    for k, r in status.items():
        assert open_now[k] == (None if r.done else 1000 * k + r.q_num)
    pools = {k: p for k, p in make_pools(4, 70).items() if p["Easy"]}
    limits = spark.createDataFrame(
        [(s, p["Easy"], p["Medium"], p["Hard"]) for s, p in pools.items()], "session long, easy int, medium int, hard int"
    )
    expected, _ = run(known, pools)
    for r in ops.session_status(starts, df, limits).collect():
        if r.session in expected:
            s = expected[r.session]
            assert (r.difficulty, r.q_num, r.total, r.done) == (s.level, s.asked + 1, s.total, s.done)
    flags = ops.phase_flags(ops.session_status(starts.limit(1), df)).collect()
    assert [f.phase for f in flags] == ["EAS", "MED", "HAR"] and sum(f.active for f in flags) == 1


def test_hot_session_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("session"), F.col("id").alias("seq"), F.lit(5).alias("score"))
    plan = ops.session_fold(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Partial") > plan.index("Exchange")
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


def test_stream_equals_batch(spark):
    log = make_log(21, 40)
    rows = spark.createDataFrame(log, LOG)
    source = durable.new_path(spark, "stream-in")
    path = durable.new_path(spark, "stream-out")
    state = durable.new_path(spark, "stream-state")
    # Two deliveries; the second goes on with the stored sessions.
    middle = len(log) // 2
    for part in (rows.where(F.col("seq") < middle), rows.where(F.col("seq") >= middle)):
        part.write.mode("append").parquet(source)
        turns = stream.session_stream(spark.readStream.schema(LOG).parquet(source))
        stream.run_available(turns, path=path, checkpoint=state)
    turns = spark.read.schema(stream.TURN_SCHEMA).parquet(path)
    expected, refused = run(log)
    assert folds(stream.latest_state(turns)) == {k: s.fold() for k, s in expected.items()}
    assert folds(ops.session_fold(rows)) == folds(stream.latest_state(turns))
    assert {(r.session, r.seq) for r in turns.where("reason is not null").collect()} == set(refused)
    told = {}
    for t in stream.with_message(turns.where("reason is null")).orderBy("session", "pos").collect():
        told.setdefault(t.session, []).append(
            (t.seq, t.level, t.q_num, t.total, t.possible, t.message, t.next_level, t.next_q_num, t.done)
        )
    assert told == {k: s.turns for k, s in expected.items()}


def test_stream_with_a_hot_session(spark):
    log = [(7, i, 8, "x") for i in range(30000)] + [(s, 40000 + s, 5, "x") for s in range(100, 110)]
    source = durable.new_path(spark, "stream-in")
    spark.createDataFrame(log, LOG).repartition(3).write.parquet(source)
    out = stream.run_available(stream.session_stream(spark.readStream.schema(LOG).parquet(source)))
    turns = spark.read.schema(stream.TURN_SCHEMA).parquet(out)
    assert turns.count() == len(log)
    expected, refused = run(log)
    assert folds(stream.latest_state(turns)) == {k: s.fold() for k, s in expected.items()}
    assert sorted((r.session, r.seq) for r in turns.where("reason is not null").collect()) == sorted(refused)


def test_stream_with_pools(spark):
    log = [r for r in make_log(5, 30) if r[0] < 30]
    pools = {k: p for k, p in make_pools(9, 30).items()}
    limits = spark.createDataFrame(
        [(s, p["Easy"], p["Medium"], p["Hard"]) for s, p in pools.items()], "session long, easy int, medium int, hard int"
    )
    source = durable.new_path(spark, "stream-in")
    spark.createDataFrame(log, LOG).write.parquet(source)
    scored = spark.readStream.schema(LOG).parquet(source).join(limits, "session")
    out = stream.run_available(stream.session_stream(scored))
    expected, _ = run(log, pools, on_empty_easy="advance")
    got = folds(stream.latest_state(spark.read.schema(stream.TURN_SCHEMA).parquet(out)))
    assert got == {k: s.fold() for k, s in expected.items()}
