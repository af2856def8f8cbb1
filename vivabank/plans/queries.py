"""One registered query per operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.classify import infer_domain, map_level
from ..functions.prompts import eval_prompt, live_prompt
from ..functions.text import core_question, dedup_key, display_question
from ..functions.parsing import parse_numeric, parse_tagged
from ..operators import analytics, bank as bank_ops, interviews, metrics, pools, scoring, sessions as session_ops
from ..sources.bank_files import read_bank_csv, sft_table, write_bank_csv
from ..sources.durable import durable, new_path
from ..sources.raw_sources import CHAT_SCHEMA, INSTRUCTION_SCHEMA, PAIR_SCHEMA, profile_sources, read_export
from ..streaming import live, session_stream as streaming
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_queries)


# --- text and classes ---------------------------------------------------------


@query
def core_question_(spark, sf):
    prefix = b.pick(
        F.col("doc_id") % 7,
        ["Candidate prompt: ", "\t could you explain this :\n", "Define and explain:", "INTERVIEW QUESTION: Interview Question: "],
        F.lit("Please answer "),
    )
    asked = b.table(spark, sf, "documents").select("doc_id", F.concat(prefix, F.col("text")).alias("q"))
    return asked.select(
        "doc_id", core_question(F.col("q")).alias("core"), display_question(F.col("q")).alias("display")
    )


@query
def dedup_key_(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", dedup_key(F.col("text")).alias("norm"))


@query
def source_clean(spark, sf):
    return bank_ops.clean_pairs(b.gappy_pairs(spark, sf, every=True), "question", "answer").select("id", "question", "answer")


@query
def chat_extract(spark, sf):
    return bank_ops.chat_pairs(b.chat_source(spark, sf), "text").select(
        F.col("order").alias("id"), "question", "answer"
    )


@query
def infer_domain_(spark, sf):
    text = F.col("text")
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        infer_domain(text).alias("domain"),
        infer_domain(text, b.SYLLABLES, "Behavioral").alias("syllable_domain"),
    )


@query
def map_difficulty(spark, sf):
    literal = b.pick(F.col("o_orderkey") % 4, [" Senior ", "BEGINNER", "intermediate"], F.col("o_orderstatus"))
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        map_level(F.col("o_orderpriority"), b.PRIORITY_LEVELS).alias("level"),
        map_level(literal).alias("alias_level"),
    )


# --- bank build ---------------------------------------------------------------


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", bank_ops.question_digest(F.col("text")))


@query
def dedup_against_bank(spark, sf):
    old = b.old_bank(spark, sf).select(bank_ops.question_digest(F.col("Question")).alias("_key"))
    return bank_ops.drop_known(_keyed(b.new_documents(spark, sf)), old, "_key").select("doc_id")


@query
def dedup_keep_first(spark, sf):
    docs = _keyed(b.table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    return bank_ops.keep_first(docs, "_key", ["doc_id"]).select("doc_id")


@query
def bank_append(spark, sf):
    old = b.old_bank(spark, sf).select("ID", (F.col("ID") - 1).alias("doc_id"), F.col("Question").alias("text"))
    first = bank_ops.keep_first(_keyed(b.new_documents(spark, sf)).select("doc_id", "_key"), "_key", ["doc_id"])
    fresh = bank_ops.drop_known(first, _keyed(old), "_key").select("doc_id")
    numbered = bank_ops.next_ids(old, fresh, ["doc_id"])
    return old.select(F.col("ID").alias("id"), "doc_id", F.lit("old").alias("origin")).unionByName(
        numbered.select(F.col("ID").alias("id"), "doc_id", F.lit("new").alias("origin"))
    )


def _sources(spark, sf) -> list[DataFrame]:
    return [
        bank_ops.from_tabular(b.tabular_source(spark, sf), "order"),
        bank_ops.from_chat(b.chat_source(spark, sf), "order"),
        bank_ops.from_instruction(b.instruction_source(spark, sf), "order"),
    ]


@query
def bank_build(spark, sf):
    return bank_ops.build_bank(b.old_bank(spark, sf), *_sources(spark, sf))


@query
def bank_audit(spark, sf):
    return bank_ops.build_audit(b.old_bank(spark, sf), ["tabular", "chat", "instruction"], *_sources(spark, sf))


@query
def bank_build_observed(spark, sf):
    path = new_path(spark, "bank")
    return bank_ops.build_bank_observed(
        b.old_bank(spark, sf), ["tabular", "chat", "instruction"], *_sources(spark, sf), path=path
    )


@query
def csv_roundtrip(spark, sf):
    path = new_path(spark, "bank-csv")
    write_bank_csv(b.bank(spark, sf), path)
    return read_bank_csv(spark, path)


@query
def export_scan(spark, sf):
    """Three tables exported in three formats and scanned as raw sources."""
    folder = new_path(spark, "exports")
    b.table(spark, sf, "documents").select(
        F.col("source").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output")
    ).write.json(f"{folder}/documents.json")
    b.table(spark, sf, "pages").select(F.col("url").alias("input"), F.col("html").alias("response")).write.options(
        header="true", quote='"', escape='"'
    ).csv(f"{folder}/pages.csv")
    b.table(spark, sf, "benchmark").select("text").write.parquet(f"{folder}/benchmark.parquet")
    parts = [
        read_export(spark, f"{folder}/documents.json", INSTRUCTION_SCHEMA).select(
            F.lit("json").alias("kind"), F.concat_ws("/", "instruction", "input").alias("about"), F.col("output").alias("text")
        ),
        read_export(spark, f"{folder}/pages.csv", PAIR_SCHEMA).select(F.lit("csv"), "input", "response"),
        read_export(spark, f"{folder}/benchmark.parquet", CHAT_SCHEMA).select(F.lit("parquet"), F.lit(""), "text"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


# --- bank analytics -----------------------------------------------------------


@query
def domain_first_seen(spark, sf):
    return analytics.first_seen_domains(b.bank(spark, sf))


@query
def bank_stats(spark, sf):
    return analytics.bank_stats(b.bank(spark, sf))


@query
def bank_cells(spark, sf):
    return analytics.bank_cells(b.bank(spark, sf))


@query
def bank_cube(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        F.nullif("lang", F.lit("de")).alias("Domain"),
        b.pick(F.col("n_chars") % 4, ["Easy", "Medium", "Hard"], F.lit(None)).alias("Difficulty_Level"),
        F.col("text").alias("Question"),
    )
    return analytics.bank_cube(docs)


@query
def bank_pivot(spark, sf):
    return analytics.bank_pivot(b.bank(spark, sf))


@query
def domain_list(spark, sf):
    return analytics.domain_list(b.bank(spark, sf))


@query
def stats_lines(spark, sf):
    return analytics.stats_lines(b.bank(spark, sf))


PROFILED = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": ("l_orderkey", "l_linenumber"), "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": ("conv_id", "turn"),
}


@query
def source_profile(spark, sf):
    return profile_sources(spark, {t: (f"{sf}/{t}.parquet", key) for t, key in PROFILED.items()})


@query
def sft_text(spark, sf):
    return sft_table(b.bank(spark, sf))


# --- choosing questions -------------------------------------------------------


@query
def domain_resolve(spark, sf):
    return pools.resolve_domains(b.requests(spark, sf), b.bank(spark, sf)).select("request", "status", "domain")


@query
def start_validate(spark, sf):
    return pools.validate_starts(b.starts(spark, sf), b.bank(spark, sf)).select("session", "accepted", "reason")


@query
def question_pool(spark, sf):
    return pools.draw_next(b.sessions(spark, sf), b.asked(spark, sf), b.bank(spark, sf))


@query
def question_plan(spark, sf):
    return pools.question_plan(b.sessions(spark, sf), b.bank(spark, sf)).select("session", "level", "q_num", "id")


@query
def session_start(spark, sf):
    starts, bank = b.starts(spark, sf), b.bank(spark, sf)
    plan = pools.question_plan(starts, bank)
    return pools.start_sessions(starts, bank, plan)


# --- scoring ------------------------------------------------------------------


@query
def guard_live(spark, sf):
    return scoring.guard_live(b.answers(spark, sf)).select("id", "route", "score", "feedback")


@query
def guard_eval(spark, sf):
    return scoring.guard_eval(b.answers(spark, sf)).select("id", "route", "score")


@query
def keyword_overlap(spark, sf):
    return scoring.keyword_overlap(b.answers(spark, sf)).select("id", F.round("overlap", 6).alias("overlap"), "hit")


@query
def render_prompt(spark, sf):
    q, ref, a = F.col("Question"), F.col("Reference_Answer"), F.col("Domain")
    a = F.coalesce(a, F.lit(""))
    return b.bank(spark, sf).select(
        F.col("ID").alias("id"),
        F.md5(live_prompt(q, ref, a)).alias("live"),
        F.md5(eval_prompt(q, ref, a)).alias("eval"),
    )


@query
def parse_tagged_(spark, sf):
    score, feedback = parse_tagged(F.col("reply"))
    return b.replies(spark, sf).select("id", score.alias("score"), feedback.alias("feedback"))


@query
def parse_numeric_(spark, sf):
    return b.replies(spark, sf).select("id", parse_numeric(F.col("reply")).alias("score"))


def length_model():
    """Stand-in for a model: marks follow the prompt's length, every fifth reply has no score."""

    def reply(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = len(p)
            tag = "" if n % 5 == 0 else f"<score>{n % 12}</score>"
            out.append(f"<feedback>seen {n}</feedback>{tag}")
        return out

    return reply


@query
def score_answers(spark, sf):
    return scoring.score_answers(b.answers(spark, sf), length_model).select("id", "route", "score", "feedback")


@query
def score_once(spark, sf):
    return scoring.score_answers(b.answers(spark, sf), length_model, once=True).select("id", "route", "score", "feedback")


@query
def benchmark_run(spark, sf):
    timed = scoring.score_benchmark(b.answers(spark, sf), length_model, answer="answer")
    return timed.select("id", "route", "score", (F.col("latency_ms") >= 0).alias("timed"))


# --- sessions -----------------------------------------------------------------


@query
def session_turns(spark, sf):
    log = b.log(spark, sf)
    users = b.sessions(spark, sf).join(log.select("session").distinct(), "session", "left_semi")
    plan = durable(pools.question_plan(users, b.bank(spark, sf)), "turn-plan")
    used = session_ops.used_answers(session_ops.first_answers(log), session_ops.plan_limits(plan))
    turns = session_ops.session_turns(used)
    open_question = plan.select("session", "level", "q_num", F.col("id").alias("question_id"))
    tag = F.concat_ws(" ", labels.phase_tag(F.col("level")), labels.ordinal(F.col("q_num")))
    return turns.join(open_question, ["session", "level", "q_num"]).select(
        "session", "pos", "level", "q_num", "question_id", "total", "possible", "message",
        "next_level", "next_q_num", "done", tag.alias("tag"),
    )


@query
def interview_run(spark, sf):
    return interviews.run_interviews(
        b.sessions(spark, sf), b.spoken(spark, sf), b.bank(spark, sf), length_model
    )


def _items(column: str, *fields: str) -> Column:
    """Digest of a record's list, one text per item."""
    item = lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields])
    return F.md5(F.concat_ws(";", F.transform(column, item)))


def _wrapped(report: DataFrame) -> DataFrame:
    """Wrap-up records with the overview's lines, lists as digests."""
    total, possible = F.col("total"), F.col("possible")
    ended = F.col("ended") & (F.col("answered") > 0)
    return report.select(
        "session", "difficulty", "answered", "total", "possible", "pct", "done", "ended", "verdict", "last_score", "message",
        F.when(ended, labels.verdict_advice(labels.percentage(total, possible))).alias("advice"),
        labels.overall_line(total, possible).alias("overall"),
        _items("history", "pos", "question", "answer", "score", "feedback", "level").alias("history"),
        _items("lost_marks", "pos", "question", "score", "lost", "level").alias("lost_marks"),
    )


_WORDS = ("  ", "error", " Quit ")


@query
def interview_report(spark, sf):
    return _wrapped(interviews.interview_report(
        b.sessions(spark, sf), b.spoken(spark, sf, _WORDS), b.bank(spark, sf), length_model, quit_ends=True
    ))


@query
def session_fold(spark, sf):
    return session_ops.session_fold(b.log(spark, sf))


@query
def session_fold_pools(spark, sf):
    return session_ops.session_fold(b.log(spark, sf), b.limits(spark, sf), on_empty_easy="advance")


@query
def session_quit(spark, sf):
    return session_ops.session_fold(b.log(spark, sf), quit_ends=True)


@query
def session_blank(spark, sf):
    return session_ops.session_fold(b.log(spark, sf), blank="score")


def _report(spark, sf) -> DataFrame:
    return session_ops.session_report(b.log(spark, sf))


@query
def session_history(spark, sf):
    item = lambda x: F.concat_ws(":", x["pos"], x["answer"], x["score"], x["level"])
    return _report(spark, sf).select("session", F.concat_ws(";", F.transform("history", item)).alias("items"))


@query
def lost_marks(spark, sf):
    item = lambda x: F.concat_ws(":", x["pos"], x["score"], x["lost"], x["level"])
    return _report(spark, sf).select("session", F.concat_ws(";", F.transform("lost_marks", item)).alias("items"))


@query
def session_report(spark, sf):
    return _report(spark, sf).select(
        "session", "difficulty", "done", "verdict", "last_score", "total", "possible", "pct", "message",
        F.size("history").alias("n_history"), F.size("lost_marks").alias("n_lost"),
    )


@query
def wrapup_stats(spark, sf):
    return session_ops.wrapup_stats(_report(spark, sf))


@query
def score_bands(spark, sf):
    return b.log(spark, sf).groupBy(labels.score_band(F.col("score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _accepted(spark, sf) -> DataFrame:
    return pools.validate_starts(b.starts(spark, sf), b.bank(spark, sf)).where("accepted").select("session", "domain")


@query
def session_status(spark, sf):
    status = session_ops.session_status(_accepted(spark, sf).select("session"), b.log(spark, sf))
    return status.withColumn("progress", F.round("progress", 6))


def _status_plan(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Accepted starts with their domain, and their question plan."""
    starts = durable(_accepted(spark, sf), "status-starts")
    return starts, durable(pools.question_plan(starts, b.bank(spark, sf)), "status-plan")


def _open_questions(status: DataFrame, bank: DataFrame) -> DataFrame:
    texts = pools.question_text(bank).select(F.col("id").alias("question_id"), "question")
    return status.withColumn("progress", F.round("progress", 6)).join(texts, "question_id", "left").select(*status.columns, "question")


@query
def status_question(spark, sf):
    starts, plan = _status_plan(spark, sf)
    status = session_ops.session_status(starts, b.log(spark, sf), session_ops.plan_limits(plan), plan)
    return _open_questions(status, b.bank(spark, sf))


@query
def phase_flags(spark, sf):
    return session_ops.phase_flags(session_ops.session_status(_accepted(spark, sf).select("session"), b.log(spark, sf)))


@query
def session_counts(spark, sf):
    return session_ops.session_counts(_accepted(spark, sf))


@query
def answer_rejects(spark, sf):
    return session_ops.answer_rejects(
        _accepted(spark, sf), b.log(spark, sf), b.limits(spark, sf), on_empty_easy="advance"
    )


# --- scorer evaluation --------------------------------------------------------


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def tier_metrics(spark, sf):
    return _rounded(metrics.tier_metrics(b.cases(spark, sf)), "mae", "accuracy", "mean_score")


@query
def confusion(spark, sf):
    return metrics.confusion(b.cases(spark, sf))


@query
def score_histogram(spark, sf):
    return metrics.score_histogram(b.cases(spark, sf))


@query
def latency_quantiles(spark, sf):
    return _rounded(metrics.latency_quantiles(b.cases(spark, sf)), "median_ms", "p95_ms")


@query
def latency_box(spark, sf):
    return _rounded(metrics.latency_box(b.cases(spark, sf)), "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def loss_summary(spark, sf):
    return _rounded(metrics.loss_summary(b.loss_log(spark, sf)), "reduction")


@query
def loss_by_epoch(spark, sf):
    return metrics.loss_by_epoch(b.loss_log(spark, sf))


# --- streaming ----------------------------------------------------------------


def _event_stream(spark, sf, name: str = "events") -> DataFrame:
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run(rows: DataFrame, label: str) -> DataFrame:
    """The rows of a stream over what the source holds."""
    return rows.sparkSession.read.schema(rows.schema).parquet(streaming.run_available(rows, label))


@query
def stream_session(spark, sf):
    return streaming.latest_state(_run(streaming.session_stream(b.events_to_log(_event_stream(spark, sf))), "turns"))


@query
def stream_turns(spark, sf):
    turns = streaming.session_stream(b.events_to_log(_event_stream(spark, sf)))
    return streaming.with_message(_run(turns, "turns").where("reason is null")).drop("reason", "medium_score")


@query
def stream_scored(spark, sf):
    starts = pools.validate_starts(b.sessions(spark, sf), b.bank(spark, sf)).where("accepted").select("session", "domain")
    plan = durable(pools.question_plan(starts, b.bank(spark, sf)), "live-plan")
    answers = b.events_to_spoken(_event_stream(spark, sf))
    scored, limits = live.score_live(answers, plan, b.bank(spark, sf), length_model)
    return session_ops.session_fold(scored.select("session", "seq", "score", "answer"), limits)


@query
def stream_rejects(spark, sf):
    rules = streaming.Rules(needs_start=True)
    asked = b.suppliers_to_starts(_event_stream(spark, sf, "supplier")).join(durable(b.limits(spark, sf), "start-limits"), "session")
    starts = streaming.start_events(pools.validate_starts(asked, b.bank(spark, sf)), rules, "advance")
    answers = streaming.answer_events(b.events_to_log(_event_stream(spark, sf)), rules)
    return streaming.settled_rejects(_run(streaming.run_machine(starts.unionByName(answers), rules), "machine"))


@query
def stream_report(spark, sf):
    # The log of scored answers goes through the stream again, and records come out as sessions end.
    rules = streaming.Rules(history=True, quit_ends=True)
    held = interviews.hold_interviews(
        b.sessions(spark, sf), b.spoken(spark, sf, _WORDS), b.bank(spark, sf), length_model, quit_ends=True
    )
    folder = new_path(spark, "scored")
    columns = ["session", "seq", "score", "answer", "question", "feedback"]
    scored = held.scored.select(columns).unionByName(held.quits, allowMissingColumns=True)
    scored.join(held.limits, "session").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    rows = _run(streaming.run_machine(streaming.answer_events(stream, rules), rules), "machine")
    return _wrapped(streaming.wrap_up(rows))


@query
def status_live(spark, sf):
    starts, plan = _status_plan(spark, sf)
    limits = durable(session_ops.plan_limits(plan), "live-limits")
    log = b.events_to_log(_event_stream(spark, sf)).join(limits, "session")
    path = new_path(spark, "states")
    live.keep_states(streaming.session_stream(log), path, new_path(spark, "states-checkpoint"))
    return _open_questions(live.live_status(starts, live.live_states(spark, path), plan), b.bank(spark, sf))


@query
def stored_sessions(spark, sf):
    checkpoint = new_path(spark, "turns-state")
    streaming.run_available(streaming.session_stream(b.events_to_log(_event_stream(spark, sf))), checkpoint=checkpoint)
    return streaming.stored_sessions(spark, checkpoint)


@query
def stream_takeover(spark, sf):
    # The earlier half of the answers came in a batch; the others come as a stream that goes on from there.
    middle = b.table(spark, sf, "events").agg(F.avg(F.col("event_id").cast("double")).alias("m")).first()["m"]
    early = b.events_to_log(b.table(spark, sf, "events").where(F.col("event_id") <= middle))
    state = durable(streaming.fold_state(session_ops.used_answers(session_ops.first_answers(early))), "fold-state")
    late = b.events_to_log(_event_stream(spark, sf).where(F.col("event_id") > middle))
    checkpoint = new_path(spark, "takeover-state")
    streaming.run_available(streaming.session_stream(late, initial=state), checkpoint=checkpoint)
    return streaming.stored_sessions(spark, checkpoint)


for _name in [n for n in _queries if n.endswith("_")]:
    _queries[_name[:-1]] = _queries.pop(_name)
