"""Live services on the session machine: scoring as answers come in, and a table of last states.

Scoring takes two stateful steps with a written table between them. The first gives each answer its place,
which does not depend on marks; a join with the static plan then tells its question, and Easy and Medium
answers go to the model. The second walks the marks; Hard answers that it lets through the gate go to the
model behind it, others are never scored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import LEVELS, MAX_MARKS
from ..operators.interviews import with_questions
from ..operators.scoring import ModelFactory, call_model, guard_live, judged, live_prompts
from ..operators.sessions import open_status, plan_limits
from ..sources.durable import durable, new_path
from .session_stream import Rules, answer_events, run_available, run_machine, start_query

_TEXTS = ("id", "question", "reference", "answer", "route", "feedback")


@dataclass(frozen=True)
class LiveTables:
    """Folders of the two steps' tables and checkpoints; give the same ones to go on with the stored sessions."""

    early: str
    early_state: str
    scored: str
    scored_state: str

    @staticmethod
    def new(spark: SparkSession) -> LiveTables:
        return LiveTables(*[new_path(spark, f"live-{x}") for x in ("early", "early-state", "scored", "scored-state")])


def _ask(rows: DataFrame, wanted, factory: ModelFactory, **model_options) -> DataFrame:
    """Replies and marks for the rows that are ``wanted`` and left to the model; one pass, other rows unasked."""
    prompts = live_prompts(rows, (F.col("route") == "model") & wanted)
    return judged(call_model(prompts, "_prompt", factory, reply="_reply", **model_options)).drop("_prompt", "_reply")


def score_live(
    answers: DataFrame, plan: DataFrame, bank: DataFrame, factory: ModelFactory, *, rules: Rules | None = None,
    blank: str = "skip", tables: LiveTables | None = None, **model_options,
) -> tuple[DataFrame, DataFrame]:
    """Score what a stream of answers (session, seq, answer) holds now: (scored answers, phase limits).

    ``plan`` is the static question plan; answers of sessions without one are left out. The scored answers
    (session, seq, pos, level, q_num, score, question, answer, feedback, ...) are those that count, read from
    the written table. Call it again with the same ``tables`` to go on.
    """
    spark = answers.sparkSession
    rules, tables = rules or Rules(), tables or LiveTables.new(spark)
    limits = durable(plan_limits(plan), "live-limits")
    # Step 1. With full marks no gate closes: every answer gets the place it would have.
    numbered = answers.join(limits, "session").withColumn("score", F.lit(MAX_MARKS))
    first = run_machine(answer_events(numbered, replace(rules, extra=("answer",)), blank), replace(rules, extra=("answer",)))
    placed = first.where("kind = 'turn'").select("session", "seq", "pos", "level", "q_num", "answer")
    asked = guard_live(with_questions(placed, plan, bank))
    early = _ask(asked, F.col("level") != LEVELS[2], factory, **model_options)
    run_available(early, path=tables.early, checkpoint=tables.early_state)
    # Step 2. Hard answers walk with no marks; only their number matters.
    walked = replace(rules, extra=_TEXTS, quit_ends=False)
    stored = spark.readStream.schema(early.schema).parquet(tables.early)
    marked = stored.join(limits, "session").withColumn("score", F.coalesce("score", F.lit(0))).withColumn("id", F.col("id").cast("string"))
    turns = run_machine(answer_events(marked, walked, "score"), walked).where("kind = 'turn'").select(
        "session", "seq", "pos", "level", "q_num", "score", *_TEXTS
    )
    scored = _ask(turns, F.col("level") == LEVELS[2], factory, **model_options)
    run_available(scored, path=tables.scored, checkpoint=tables.scored_state)
    return spark.read.schema(scored.schema).parquet(tables.scored), limits


#: Micro-batches whose changes stand side by side before they are folded into a full table.
BLOCK = 16
_STATE = "next_level string, next_q_num int, pos int, total bigint, possible bigint, done boolean"


def _last(rows: DataFrame) -> DataFrame:
    """Last state per session; further on in a session is later."""
    fields = [x.split()[0] for x in _STATE.split(", ")]
    return rows.groupBy("session").agg(F.max_by(F.struct(*fields), "pos").alias("s")).select("session", "s.*")


def live_states(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """Last state of every session in the table that ``keep_states`` writes under ``path``."""
    schema = f"session {key}, {_STATE}, block long"
    changes = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/changes")
    block = changes.agg(F.max("block")).first()[0]  # one number, from the folders' names and a count
    block = -1 if block is None else block
    full = spark.read.schema(schema).parquet(f"{path}/full").where(F.col("block") == block - 1)
    return _last(full.drop("block").unionByName(changes.where(F.col("block") == block).drop("block", "batch")))


def keep_states(turns: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the last state of every session of a stream of turns in a table under ``path``, by what arrives now.

    A micro-batch writes the changes of its sessions into a folder of its own number, so a batch that is
    delivered again writes the same folder again. Behind every ``BLOCK`` batches the changes are folded into
    a full table: a batch costs what it changes, and reading never meets more than one block of changes.
    """
    spark = turns.sparkSession
    key = turns.schema["session"].dataType.simpleString()
    empty = spark.createDataFrame([], f"session {key}, {_STATE}")
    empty.write.mode("ignore").parquet(f"{path}/full/block=-1")
    empty.write.mode("ignore").parquet(f"{path}/changes/block=0/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        block = number // BLOCK
        last = _last(batch.where("reason is null"))
        last.write.mode("overwrite").parquet(f"{path}/changes/block={block}/batch={number}")
        if number % BLOCK == BLOCK - 1:
            here = batch.sparkSession
            full = here.read.schema(empty.schema).parquet(f"{path}/full/block={block - 1}")
            changes = here.read.schema(empty.schema).parquet(f"{path}/changes/block={block}")
            _last(full.unionByName(changes.drop("batch"))).write.mode("overwrite").parquet(f"{path}/full/block={block}")

    writer = turns.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    start_query(spark, writer).awaitTermination()


def live_status(starts: DataFrame, states: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Snapshot of every started session (session, and more) out of ``live_states``, as ``session_status`` gives it."""
    state = starts.join(states.drop("pos"), "session", "left").withColumn("difficulty", F.coalesce("next_level", F.lit(LEVELS[0])))
    return open_status(state, starts.columns, plan)
