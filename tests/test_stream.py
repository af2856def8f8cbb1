"""The session machine: text keys, faults, starts, wrap-up records, take-over, expiry, scoring and the table of states."""

import os
import random
import subprocess
import sys
import time
import uuid

import pytest
from machine import run
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_scoring import BANK, graded
from test_sessions import LOG, folds, make_log, make_pools

from vivabank.operators import interviews, pools, sessions as ops
from vivabank.sources import durable
from vivabank.streaming import live, session_stream as stream
from vivabank.streaming.session_stream import Rules



@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of a stateful step starts a worker and a store of its own."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


TEXT_LOG = "session string, seq long, score int, answer string"


def _feed(spark, rows, schema, source=None, mode="append"):
    source = source or durable.new_path(spark, "stream-in")
    spark.createDataFrame(rows, schema).coalesce(2).write.mode(mode).parquet(source)
    return source


def _machine(spark, events, rules, label="rows"):
    rows = stream.run_machine(events, rules)
    path = stream.run_available(rows, label)
    return spark.read.schema(rows.schema).parquet(path)


def test_the_processor_needs_nothing_of_the_package(tmp_path):
    """It is also loaded beside the driver, where the package may not be on the path."""
    cloudpickle.register_pickle_by_value(stream)
    try:
        data = cloudpickle.dumps(stream.SessionMachine(Rules(history=True, patience_ms=5, quit_ends=True), 56))
    finally:
        cloudpickle.unregister_pickle_by_value(stream)
    (tmp_path / "machine").write_bytes(data)
    code = "import pickle, sys; m = pickle.load(open('machine', 'rb')); assert 'vivabank.operators' not in sys.modules; print(m.rules.most)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "18", done.stderr


def test_text_keys_and_faulty_rows(spark):
    names = {s: str(uuid.UUID(int=random.Random(s).getrandbits(128))) for s in range(40)}
    log = make_log(31, 40)
    faults = [(None, 1, 5, "x"), (names[1], None, 5, "x"), (names[2], 10**6, None, "x"), (names[3], 10**6 + 1, None, "  "), (None, None, None, "y")]
    hot = [(names[0], 2 * 10**6 + i, 7, "x") for i in range(20_000)]
    source = _feed(spark, [(names[s], *r) for s, *r in log] + faults + hot, TEXT_LOG)
    out = stream.run_available(stream.session_stream(spark.readStream.schema(TEXT_LOG).parquet(source)))
    turns = spark.read.schema(stream.turn_schema("string")).parquet(out)
    expected, refused = run(log + [(0, *r[1:]) for r in hot])
    assert folds(stream.latest_state(turns)) == {names[k]: s.fold() for k, s in expected.items()}
    bad = turns.where("reason is not null")
    late = bad.where("reason = 'session complete'").select("session", "seq").collect()
    assert sorted(map(tuple, late)) == sorted((names[k], q) for k, q in refused)
    faulty = {(r.session, r.seq, r.reason) for r in bad.where("reason <> 'session complete'").collect()}
    # Without a number, a row shows 0 if it is refused for something else.
    assert faulty == {(None, 1, "no session"), (names[1], None, "no number"), (names[2], 10**6, "no score"), (None, 0, "no session")}


@pytest.mark.parametrize("easy, medium, hard", [(7, 9, 6), (1, 1, 1), (3, 8, 0)])
def test_other_phases_in_batch_and_stream(spark, easy, medium, hard):
    phases = {"Easy": easy, "Medium": medium, "Hard": hard}
    rules = Rules(phases=phases)
    log = [(s, 100 * s + i, max(0, min(10, 5 + s % 6 + i % 2)), "x") for s in range(30) for i in range(s)]
    frame = spark.createDataFrame(log, LOG)
    source = _feed(spark, log, LOG)
    out = stream.run_available(stream.session_stream(spark.readStream.schema(LOG).parquet(source), rules=rules))
    turns = spark.read.schema(stream.TURN_SCHEMA).parquet(out)
    batch = ops.session_fold(frame, phases=phases)
    assert folds(stream.latest_state(turns)) == folds(batch)
    # By hand: an answer is lost only behind the end of its session.
    for r in batch.collect():
        scores = [x[2] for x in log if x[0] == r.session]
        gate, full = easy + medium, easy + medium + hard
        passed = len(scores) >= gate and sum(scores[easy:gate]) / (10 * medium) >= 0.7
        assert r.answered == min(len(scores), full if passed else gate) and r.total == sum(scores[: r.answered])
    used = ops.used_answers(ops.first_answers(frame, phases=phases), phases=phases)
    told = lambda df: {(t.session, t.pos): (t.level, t.q_num, t.message, t.next_level, t.next_q_num, t.done) for t in df.collect()}
    assert told(stream.with_message(turns.where("reason is null"), phases)) == told(ops.session_turns(used, phases=phases))
    assert ops.answer_rejects(frame.select("session").distinct(), frame, phases=phases).count() == turns.where("reason is not null").count()


def _starts(spark, accepted, refused, limits=None):
    rows = [(s, f"D{s}", True, None, *((limits or {}).get(s) or (9, 9, 9))) for s in accepted]
    rows += [(s, "Nope", False, "domain not found", 9, 9, 9) for s in refused]
    return rows


STARTS = "session long, domain string, accepted boolean, reason string, easy int, medium int, hard int"


def test_starts_and_rejects_as_one_stream(spark):
    log = make_log(8, 50) + [(3, 10**6 + i, 7, "x") for i in range(9000)] + [(44, 10**6 + i, 7, "x") for i in range(9000)]
    pools_ = {s: tuple(p[x] for x in ("Easy", "Medium", "Hard")) for s, p in make_pools(4, 50).items()}
    starts = _starts(spark, range(40), [41, 42], pools_)
    limits = spark.createDataFrame([(s, *p) for s, p in pools_.items()], "session long, easy int, medium int, hard int")
    accepted = spark.createDataFrame([(s,) for s in range(40)], "session long")
    frame = spark.createDataFrame(log, LOG)
    rules = Rules(needs_start=True)
    events = stream.start_events(spark.readStream.schema(STARTS).parquet(_feed(spark, starts, STARTS)), rules, "advance").unionByName(
        stream.answer_events(spark.readStream.schema(LOG).parquet(_feed(spark, log, LOG)), rules)
    )
    rows = _machine(spark, events, rules)
    got = {tuple(r) for r in stream.settled_rejects(rows).collect()}
    want = {tuple(r) for r in ops.answer_rejects(accepted, frame, limits, on_empty_easy="advance").collect()}
    # Blank answers of unknown sessions are no events.
    blank = {(r.session, r.seq) for r in frame.where(ops.is_blank(F.col("answer"))).collect()}
    assert got == {w for w in want if w[:2] not in blank} | {(s, None, "domain not found") for s in (41, 42)}
    assert rows.where("kind = 'start'").count() == 40
    assert {r.domain for r in rows.where("kind = 'start' and session = 7").collect()} == {"D7"}


def test_answers_wait_for_their_start(spark):
    rules = Rules(needs_start=True, patience_ms=3_600_000)
    answers = _feed(spark, [(1, i, 9, "x") for i in range(3)] + [(2, i, 8, "x") for i in range(40)], LOG)
    starts = _feed(spark, [], STARTS)
    path, state = durable.new_path(spark, "rows"), durable.new_path(spark, "state")

    def deliver(rules):
        events = stream.start_events(spark.readStream.schema(STARTS).parquet(starts), rules).unionByName(
            stream.answer_events(spark.readStream.schema(LOG).parquet(answers), rules)
        )
        rows = stream.run_machine(events, rules)
        stream.run_available(rows, path=path, checkpoint=state)
        return spark.read.schema(rows.schema).parquet(path)

    assert deliver(rules).where("kind = 'turn'").count() == 0
    _feed(spark, _starts(spark, [1], []), STARTS, starts)
    _feed(spark, [(1, 3, 9, "x")], LOG, answers)
    turns = {(r.session, r.seq, r.pos) for r in deliver(rules).where("kind = 'turn'").collect()}
    assert turns == {(1, i, i + 1) for i in range(4)}
    _feed(spark, _starts(spark, [2, 1], []), STARTS, starts)
    rows = deliver(rules)
    assert rows.where("kind = 'turn' and session = 2").count() == 18
    assert [r.session for r in rows.where("reason = 'session started before'").collect()] == [1]
    assert stream.settled_rejects(rows).where("session = 2 and reason = 'session complete'").count() == 22


def test_waiting_ends_and_silent_sessions_expire(spark):
    answers = _feed(spark, [(1, i, 9, "x") for i in range(3)], LOG)
    path, state = durable.new_path(spark, "rows"), durable.new_path(spark, "state")

    def deliver(rules, path, state):
        rows = stream.run_machine(stream.answer_events(spark.readStream.schema(LOG).parquet(answers), rules), rules)
        stream.run_available(rows, path=path, checkpoint=state)
        return spark.read.schema(rows.schema).parquet(path)

    patient = Rules(needs_start=True, patience_ms=1)
    assert deliver(patient, path, state).count() == 0
    time.sleep(0.1)
    _feed(spark, [(5, 1, 9, "x")], LOG, answers)
    assert {(r.session, r.seq, r.reason) for r in deliver(patient, path, state).collect()} == {(1, i, "session not found") for i in range(3)}

    path, state = durable.new_path(spark, "rows"), durable.new_path(spark, "state")
    silent = Rules(idle_ms=1, history=True)
    assert deliver(silent, path, state).where("kind = 'turn'").count() == 4
    time.sleep(0.1)
    _feed(spark, [(6, 1, 9, "x")], LOG, answers)
    rows = deliver(silent, path, state)
    ended = {r.session: (r.answered, r.total, r.done, r.ended, r.verdict, len(r.history)) for r in stream.wrap_up(rows).collect()}
    assert ended == {1: (3, 27, False, True, "STRONG HIRE", 3), 5: (1, 9, False, True, "STRONG HIRE", 1)}
    # Off: the same answers, no record.
    assert {r.kind for r in deliver(Rules(), durable.new_path(spark, "rows"), durable.new_path(spark, "state")).collect()} == {"turn"}


@pytest.mark.parametrize("quit_ends", [False, True])
def test_wrap_up_records_equal_the_batch(spark, quit_ends):
    log = [(s, q, sc, a if a.strip() else " ", f"Q{q}", f"F{sc}") for s, q, sc, a in make_log(17, 40)]
    schema = LOG + ", question string, feedback string"
    rules = Rules(history=True, quit_ends=quit_ends)
    middle = len(log) // 2
    parts = [[r for r in log if r[1] < middle], [r for r in log if r[1] >= middle]]
    source = durable.new_path(spark, "stream-in")
    path, state = durable.new_path(spark, "rows"), durable.new_path(spark, "state")
    for part in parts:
        _feed(spark, part, schema, source)
        rows = stream.run_machine(stream.answer_events(spark.readStream.schema(schema).parquet(source), rules), rules)
        stream.run_available(rows, path=path, checkpoint=state)
    got = stream.wrap_up(spark.read.schema(rows.schema).parquet(path))
    batch = ops.session_report(spark.createDataFrame(log, schema), quit_ends=quit_ends)
    batch = batch.where("ended") if quit_ends else batch.where("done")
    plain = lambda r: (
        r.difficulty, r.answered, r.total, r.possible, r.pct, r.done, r.verdict, r.last_score, r.message,
        [(h.pos, h.question, h.answer, h.score, h.feedback, h.level) for h in r.history],
        [(x.pos, x.question, x.score, x.lost, x.level) for x in r.lost_marks],
    )
    assert {r.session: plain(r) for r in got.collect()} == {r.session: plain(r) for r in batch.collect()}


def test_stream_takes_over_from_a_fold_and_the_store_can_be_read(spark):
    log = make_log(23, 50)
    frame = spark.createDataFrame(log, LOG)
    middle = len(log) // 2
    state = durable.durable(stream.fold_state(ops.used_answers(ops.first_answers(frame.where(F.col("seq") < middle)))), "fold-state")
    source = _feed(spark, [r for r in log if r[1] >= middle], LOG)
    path, checkpoint = durable.new_path(spark, "rows"), durable.new_path(spark, "state")
    turns = stream.session_stream(spark.readStream.schema(LOG).parquet(source), initial=state)
    stream.run_available(turns, path=path, checkpoint=checkpoint)
    whole = folds(ops.session_fold(frame))
    assert folds(stream.stored_sessions(spark, checkpoint)) == whole
    late = spark.read.schema(stream.TURN_SCHEMA).parquet(path)
    assert {k: v for k, v in folds(stream.latest_state(late)).items()}.items() <= whole.items()
    # Reading leaves the store as it was: the stream goes on and ends the same.
    stream.run_available(turns, path=path, checkpoint=checkpoint)
    assert folds(stream.stored_sessions(spark, checkpoint)) == whole


def test_live_scoring_equals_interviews(spark, tmp_path):
    bank = spark.createDataFrame(
        [(i, "D", ["Easy", "Medium", "Hard"][i % 3], f"Question {i}?", f"Reference {i}") for i in range(60)], BANK
    )
    starts = spark.createDataFrame([(s, "D") for s in range(6)], "session long, domain string")
    marks = {0: 9, 1: 7, 2: 6, 3: 10, 4: 8}
    log = [(s, 100 * s + i, f"an answer worth {m} marks") for s, m in marks.items() for i in range([20, 18, 20, 7, 13][s])]
    log += [(77, 999, "an answer worth 5 marks"), (0, 50, " "), (4, 450, "pass")]
    random.Random(1).shuffle(log)
    schema = "session long, seq long, answer string"
    folder = str(tmp_path)

    def counted():
        def ask(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(str(p.split("worth ")[1].split(" ")[0]) for p in prompts))
            return graded()(prompts)

        return ask

    plan = durable.durable(pools.question_plan(starts, bank), "plan")
    source, tables = durable.new_path(spark, "answers-in"), live.LiveTables.new(spark)
    for part in (sorted(log, key=lambda r: r[1] % 100)[: len(log) // 2], sorted(log, key=lambda r: r[1] % 100)[len(log) // 2 :]):
        _feed(spark, part, schema, source)
        scored, limits = live.score_live(spark.readStream.schema(schema).parquet(source), plan, bank, counted, tables=tables, name="counted")
    asked = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n")]
    assert asked.count("6") == 13 and asked.count("9") == 18  # session 2 fails Medium: no Hard answer is asked
    got = folds(ops.session_fold(scored.select("session", "seq", "score", "answer"), limits, blank="score"))
    answers = spark.createDataFrame(log, schema)
    assert got == folds(interviews.run_interviews(starts, answers, bank, graded, name="graded"))
    held = interviews.hold_interviews(starts, answers, bank, graded, name="graded").scored
    pick = lambda df: sorted((r.session, r.seq, r.level, r.q_num, r.question, r.score, r.feedback) for r in df.collect())
    gone = {(r.session, r.seq) for r in held.join(scored, ["session", "seq"], "left_anti").collect()}
    assert not gone and pick(scored) == pick(held)


def test_table_of_states_survives_a_replayed_batch(spark, monkeypatch):
    monkeypatch.setattr(live, "BLOCK", 2)
    log = make_log(12, 40)
    source = durable.new_path(spark, "stream-in")
    path, checkpoint = durable.new_path(spark, "states"), durable.new_path(spark, "state")
    third = len(log) // 3
    starts = spark.createDataFrame([(s,) for s in range(45)], "session long")
    for part in range(3):
        rows = [r for r in log if part * third <= r[1] and (r[1] < (part + 1) * third or part == 2)]
        _feed(spark, rows, LOG, source)
        turns = stream.session_stream(spark.readStream.schema(LOG).parquet(source))
        live.keep_states(turns, path, checkpoint)
        so_far = spark.createDataFrame([r for r in log if r[1] < (part + 1) * third or part == 2], LOG)
        status = live.live_status(starts, live.live_states(spark, path))
        want = ops.session_status(starts, so_far)
        assert sorted(map(tuple, status.collect())) == sorted(map(tuple, want.collect()))
    # The last batch again, as after a failure before its commit.
    again = spark.read.parquet(f"{path}/changes/block=1/batch=2")
    assert again.count() > 0
    durable.durable(again, "copy").write.mode("overwrite").parquet(f"{path}/changes/block=1/batch=2")
    status = live.live_status(starts, live.live_states(spark, path))
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, ops.session_status(starts, spark.createDataFrame(log, LOG)).collect()))
