"""Sessions that share the groups of the stateful step: take-over, wrap-up records, the table of states, timers, faults."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_sessions import LOG, folds, make_log

from vivabank.operators import sessions as ops
from vivabank.sources import durable
from vivabank.streaming import live, session_stream as stream
from vivabank.streaming.session_stream import Rules


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _feed(spark, rows, schema, source=None):
    source = source or durable.new_path(spark, "stream-in")
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(source)
    return source


def _halves(log):
    middle = len(log) // 2
    return [r for r in log if r[1] < middle], [r for r in log if r[1] >= middle]


def test_initial_states_share_groups(spark):
    """of a bucket's sessions some come with a state, some by stream, some by both."""
    log = make_log(41, 60)
    early, late = _halves(log)
    early = [r for r in early if r[0] % 3 != 1]
    late = [r for r in late if r[0] % 3 != 2]
    state = durable.durable(stream.fold_state(ops.used_answers(ops.first_answers(spark.createDataFrame(early, LOG)))), "fold-state")
    checkpoint = durable.new_path(spark, "state")
    events = spark.readStream.schema(LOG).parquet(_feed(spark, late, LOG))
    stream.run_available(stream.session_stream(events, rules=Rules(buckets=3), initial=state), checkpoint=checkpoint)
    assert folds(stream.stored_sessions(spark, checkpoint)) == folds(ops.session_fold(spark.createDataFrame(early + late, LOG)))
    keys = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint).select("key").distinct()
    assert keys.count() <= 3


def test_batches_of_long_texts_stay_small(spark):
    """what a step in Python holds at a time is bounded in bytes, not in rows only."""
    schema = LOG + ", question string"
    rules = Rules(extra=("answer",))
    rows = spark.range(6000).select((F.col("id") % 400).alias("session"), F.col("id").alias("seq"), F.lit(9).alias("score"), F.repeat(F.lit("x"), 2000).alias("answer"), F.lit("q").alias("question"))
    source = durable.new_path(spark, "stream-in")
    rows.coalesce(1).write.parquet(source)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    turns = stream.run_machine(stream.answer_events(spark.readStream.schema(schema).parquet(source), rules), rules)
    path = stream.run_available(turns.mapInArrow(sizes, "n long, size long"))
    n, most = spark.read.parquet(path).agg(F.sum("n"), F.max("size")).first()
    assert n == 6000 and most < 3 << 20


def test_wrap_up_records_of_shared_groups(spark):
    """histories of a bucket's sessions grow over batches and end with their own session only."""
    log = [(s, q, sc, a, f"Q{q}", f"F{sc}") for s, q, sc, a in make_log(19, 40)]
    schema = LOG + ", question string, feedback string"
    rules = Rules(history=True, quit_ends=True, buckets=2)
    source, path, state = (durable.new_path(spark, x) for x in ("stream-in", "rows", "state"))
    for part in _halves(log):
        _feed(spark, part, schema, source)
        rows = stream.run_machine(stream.answer_events(spark.readStream.schema(schema).parquet(source), rules), rules)
        stream.run_available(rows, path=path, checkpoint=state)
    got = stream.wrap_up(spark.read.schema(rows.schema).parquet(path))
    batch = ops.session_report(spark.createDataFrame(log, schema), quit_ends=True).where("ended")
    plain = lambda r: (
        r.difficulty, r.answered, r.total, r.possible, r.pct, r.done, r.verdict, r.last_score, r.message,
        [(h.pos, h.question, h.answer, h.score, h.feedback, h.level) for h in r.history],
    )
    assert got.count() == batch.count()
    assert {r.session: plain(r) for r in got.collect()} == {r.session: plain(r) for r in batch.collect()}


def test_timers_of_shared_groups(spark):
    """a bucket's timer ends the sessions it is for, and no neighbour that went on."""
    rules = Rules(idle_ms=2000, history=True, buckets=1)
    source, path, state = (durable.new_path(spark, x) for x in ("stream-in", "rows", "state"))

    def deliver(rows):
        _feed(spark, rows, LOG, source)
        out = stream.run_machine(stream.answer_events(spark.readStream.schema(LOG).parquet(source), rules), rules)
        stream.run_available(out, path=path, checkpoint=state)
        return {r.session: r.answered for r in stream.wrap_up(spark.read.schema(out.schema).parquet(path)).collect()}

    assert deliver([(s, i, 9, "x") for s in (1, 2, 3) for i in range(3)]) == {}
    time.sleep(2.5)
    assert deliver([(2, 10, 9, "x")]) == {1: 3, 3: 3}
    time.sleep(2.5)
    # A session that ended begins anew; what came for 2 earlier counts until its own clock runs out.
    assert deliver([(1, 20, 9, "x")]) == {1: 3, 2: 4, 3: 3}


def test_table_of_states_of_shared_groups(spark):
    """a bucket's sessions keep their own last states, batch by batch."""
    log = make_log(43, 60)
    source, path, checkpoint = (durable.new_path(spark, x) for x in ("stream-in", "states", "state"))
    starts = spark.createDataFrame([(s,) for s in range(65)], "session long")
    for part in _halves(log):
        _feed(spark, part, LOG, source)
        live.keep_states(stream.session_stream(spark.readStream.schema(LOG).parquet(source), rules=Rules(buckets=2)), path, checkpoint)
    status = live.live_status(starts, live.live_states(spark, path))
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, ops.session_status(starts, spark.createDataFrame(log, LOG)).collect()))


def test_many_sessions_take_few_groups(spark):
    """groups of the stateful step do not grow with the sessions; turns equal the batch's."""
    log = [(s, 100 * i + s, 5 + (s + i) % 6, "x") for s in range(600) for i in range(s % 23)]
    checkpoint = durable.new_path(spark, "state")
    out = stream.run_available(
        stream.session_stream(spark.readStream.schema(LOG).parquet(_feed(spark, log, LOG)), rules=Rules(buckets=5)), checkpoint=checkpoint
    )
    turns = spark.read.schema(stream.TURN_SCHEMA).parquet(out)
    used = ops.used_answers(ops.first_answers(spark.createDataFrame(log, LOG)))
    told = lambda df: sorted((t.session, t.pos, t.seq, t.level, t.q_num, t.total, t.next_level, t.next_q_num or 0, t.done) for t in df.collect())
    assert told(turns.where("reason is null")) == told(ops.session_turns(used))
    states = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    assert states.count() == len({r[0] for r in log}) and states.select("key").distinct().count() == 5


def test_large_numbers_beside_rows_without_a_session(spark):
    """sessions stay exact although rows of their batch have none."""
    big = 2**53 + 1
    log = [(big + 2 * s, i, 7, "x") for s in range(200) for i in range(3)] + [(None, i, 7, "x") for i in range(200)]
    out = stream.run_available(stream.session_stream(spark.readStream.schema(LOG).parquet(_feed(spark, log, LOG))))
    turns = spark.read.schema(stream.TURN_SCHEMA).parquet(out)
    assert {r.session for r in turns.where("reason is null").collect()} == {big + 2 * s for s in range(200)}
    assert turns.where("reason = 'no session' and session is null").count() == 200


def _packed_rows(spark, n, answer):
    """What the stateful step takes for ``n`` answers of 700 sessions in 5 buckets."""
    rows = spark.range(n).coalesce(1).select((F.col("id") % 700).alias("session"), F.col("id").alias("seq"), F.lit(9).alias("score"), answer.alias("answer"))
    rules = Rules(buckets=5, extra=("answer",))
    events = stream.answer_events(rows, rules, "score")
    arrays = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in events.schema.fields)
    bucket = F.pmod(F.xxhash64("session"), F.lit(rules.buckets)).cast("int").alias("bucket")
    return events.select(bucket, "*").mapInArrow(stream._packed(4 * rules.most), f"bucket int, lane int, {arrays}").collect()


def test_a_bucket_comes_in_few_rows(spark):
    """the stateful step takes arrays, not a row for every event; nothing is lost or moved inside a session."""
    rows = _packed_rows(spark, 40_000, F.lit("x"))
    assert len(rows) <= 40 and max(len(r.session) for r in rows) <= 4096
    got = {}
    for r in rows:
        for session, seq in zip(r.session, r.seq):
            got.setdefault(session, []).append(seq)
    assert got == {s: list(range(s, 40_000, 700)) for s in range(700)}


def test_packed_rows_of_long_texts_stay_small(spark):
    """a packed row is bounded in bytes as well, whatever its bucket holds."""
    rows = _packed_rows(spark, 6000, F.repeat(F.lit("x"), 2000))
    assert sum(len(r.session) for r in rows) == 6000
    assert max(sum(map(len, r.answer)) for r in rows) <= 1 << 18


def test_the_table_of_states_with_sessions_of_other_types(spark):
    """sessions of every type keep their own states, though their events come as arrays; some rows have none."""
    log = make_log(23, 30)
    for kind in ("string", "decimal(20,0)", "date", "timestamp", "int"):
        made = {"date": "date_add(date'2024-01-01', cast(session as int))", "timestamp": "timestamp_seconds(session)"}.get(kind, f"cast(session as {kind})")
        keyed = spark.createDataFrame(log, LOG).withColumn("name", F.col("session")).withColumn("session", F.expr(made))
        source, path, checkpoint = (durable.new_path(spark, x) for x in ("stream-in", "states", "state"))
        events = keyed.drop("name").unionByName(keyed.drop("name").limit(3).withColumn("session", F.lit(None).cast(kind))).coalesce(1)
        events.write.parquet(source)
        live.keep_states(stream.session_stream(spark.readStream.schema(events.schema).parquet(source)), path, checkpoint)
        states = live.live_states(spark, path, kind).join(keyed.select("session", "name").distinct(), "session")
        got = {r.name: (r.pos, r.total, r.done) for r in states.collect()}
        fold = ops.session_fold(spark.createDataFrame(log, LOG)).where("answered > 0")
        assert got == {r.session: (r.answered, r.total, r.done) for r in fold.collect()}, kind


def test_state_stores_do_not_grow_with_the_shuffle_partitions(spark):
    """a stream has a few state stores per core; partitions set for larger tables add none, and a checkpoint keeps its number."""
    log = make_log(47, 60)
    source, path, checkpoint = (durable.new_path(spark, x) for x in ("stream-in", "states", "state"))
    starts = spark.createDataFrame([(s,) for s in range(65)], "session long")
    stores = lambda: spark.read.format("state-metadata").load(checkpoint).first()["numPartitions"]
    for part, partitions in zip(_halves(log), ("100", "3")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        _feed(spark, part, LOG, source)
        live.keep_states(stream.session_stream(spark.readStream.schema(LOG).parquet(source)), path, checkpoint)
        assert stores() == 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    status = live.live_status(starts, live.live_states(spark, path))
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, ops.session_status(starts, spark.createDataFrame(log, LOG)).collect()))


def test_frames_of_the_stateful_step_hold_no_objects():
    """rows leave the stateful step as Arrow arrays; only what Arrow has no plain type for stays an object."""
    rules = Rules(history=True, extra=("id",))
    cells = {"session": [1, 2**62, 3], "seq": [5, 6, 7], "score": [4, -1, 9], "fault": [None, "no session", "no number"]}
    for key, objects in (("bigint", {"history"}), ("date", {"history", "session"})):
        rows = stream._Rows(rules, key)
        rows.refuse({c: np.array(x, object if c == "fault" else None) for c, x in cells.items()}, "session complete")
        frame = next(rows.frames())
        assert {c for c in frame if not isinstance(frame[c].dtype, pd.ArrowDtype)} == objects
        told = [tuple(None if pd.isna(x) else x for x in r) for r in frame[["session", "seq", "score", "reason"]].itertuples(index=False)]
        assert told == [(1, 5, 4, "session complete"), (None, 6, None, "no session"), (3, None, 9, "no number")]
