"""Scoring answers: rule guards first, the model only for what they leave."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    EVAL_GIBBERISH, EVAL_NON_ANSWERS, FEEDBACK_INJECTION, FEEDBACK_NON_ANSWER, FEEDBACK_TOO_SHORT,
    LIVE_INJECTIONS, LIVE_NON_ANSWERS, MAX_MARKS, OVERLAP_HIT, OVERLAP_SCORE,
)
from ..functions.parsing import parse_numeric, parse_tagged
from ..functions.prompts import eval_prompt, live_prompt
from ..functions.text import has_three_words, keywords, overlap_ratio, strip, text_or
from ..sources.durable import durable

# Loads a model and returns the function that answers a list of prompts.
ModelFactory = Callable[[], Callable[[list[str]], list[str]]]


def _any_in(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit |= F.contains(text, F.lit(phrase))
    return hit


def _with_clean(df: DataFrame, answer: str, reference: str) -> DataFrame:
    return df.withColumns(
        {
            "_clean": F.lower(strip(text_or(F.col(answer), ""))),
            "_ref": F.lower(strip(text_or(F.col(reference), "nan"))),
        }
    )


def guard_live(df: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Add route, score and feedback of the live rules; route ``model`` leaves both null."""
    clean, ref = F.col("_clean"), F.col("_ref")
    route = (
        F.when(clean.isin(LIVE_NON_ANSWERS), F.lit("non_answer"))
        .when(~has_three_words(clean) & (clean != ref), F.lit("too_short"))
        .when(_any_in(clean, LIVE_INJECTIONS), F.lit("injection"))
        .otherwise(F.lit("model"))
    )
    feedback = (
        F.when(F.col("route") == "non_answer", F.lit(FEEDBACK_NON_ANSWER))
        .when(F.col("route") == "too_short", F.lit(FEEDBACK_TOO_SHORT))
        .when(F.col("route") == "injection", F.lit(FEEDBACK_INJECTION))
    )
    routed = _with_clean(df, answer, reference).withColumn("route", route).drop("_clean", "_ref")
    return routed.withColumns({"score": F.when(F.col("route") != "model", F.lit(0)), "feedback": feedback})


def keyword_overlap(df: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Add ``overlap``, the share of the reference's words the answer has, and ``hit``."""
    words = df.withColumns(
        {"_rw": keywords(text_or(F.col(reference), "nan")), "_aw": keywords(text_or(F.col(answer), ""))}
    )
    return (
        words.withColumn("overlap", overlap_ratio(F.col("_rw"), F.col("_aw")))
        .withColumn("hit", F.coalesce(F.col("overlap") >= OVERLAP_HIT, F.lit(False)))
        .drop("_rw", "_aw")
    )


def guard_eval(df: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Add route and score of the benchmark rules; route ``model`` leaves the score null.

    An empty reference is contained in every answer and gives full marks.
    """
    clean, ref = F.col("_clean"), F.col("_ref")
    early = (
        F.when(clean.isin(EVAL_NON_ANSWERS), F.lit("non_answer"))
        .when(_any_in(clean, EVAL_GIBBERISH), F.lit("gibberish"))
        .when(F.contains(clean, ref), F.lit("match"))
        .when(~has_three_words(clean), F.lit("too_short"))
    )
    routed = _with_clean(df, answer, reference).withColumn("_early", early).drop("_clean", "_ref")
    # Word sets only for what the cheap rules left: their texts are null elsewhere.
    open_row = F.col("_early").isNull()
    scored = keyword_overlap(
        routed.withColumns(
            {
                "_open_answer": F.when(open_row, text_or(F.col(answer), "")).otherwise(F.lit("")),
                "_open_ref": F.when(open_row, text_or(F.col(reference), "nan")).otherwise(F.lit("")),
            }
        ),
        "_open_answer",
        "_open_ref",
    )
    route = F.coalesce("_early", F.when(F.col("hit"), F.lit("overlap")).otherwise(F.lit("model")))
    score = (
        F.when(F.col("route") == "match", F.lit(MAX_MARKS))
        .when(F.col("route") == "overlap", F.lit(OVERLAP_SCORE))
        .when(F.col("route") != "model", F.lit(0))
    )
    return (
        scored.withColumn("route", route)
        .withColumn("score", score)
        .drop("_early", "_open_answer", "_open_ref", "overlap", "hit")
    )


_loaded: dict[str, Callable[[list[str]], list[str]]] = {}


def _worker_model(factory: ModelFactory, name: str) -> Callable[[list[str]], list[str]]:
    """The model of this Python worker; workers are reused, so it is loaded once. ``name`` tells factories apart."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def call_model(
    df: DataFrame,
    prompt: str,
    factory: ModelFactory,
    *,
    name: str = "model",
    batch_size: int = 64,
    spread: int | None = None,
    reply: str = "reply",
    timed: bool = False,
) -> DataFrame:
    """Add the model's reply to every row, in Arrow batches.

    A model call costs far more than moving a row: ``spread`` sets the number of
    tasks, as a file split may hold too many prompts for one. ``timed`` also
    adds ``latency_ms``, the call's wall time shared among its rows. A row without
    a prompt is not asked and has no reply.
    """
    if spread:
        df = df.repartition(spread)  # evenly, whatever the prompts are
    # Another factory, or the same one with other values bound to it, is another model.
    name = f"{name}-{hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()}"
    fields = df.schema.fields + [T.StructField(reply, T.StringType())]
    if timed:
        fields = fields + [T.StructField("latency_ms", T.DoubleType())]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the prompts become Python values; the other columns pass as they are, a batch at a time.
        model = _worker_model(factory, name)
        for batch in batches:
            prompts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
            replies: list[str | None] = [None] * len(prompts)
            latency: list[float] = []
            for at in range(0, len(prompts), batch_size):
                part = range(at, min(at + batch_size, len(prompts)))
                asked = [i for i in part if prompts[i] is not None]
                begin = time.perf_counter()
                if asked:
                    for i, told in zip(asked, model([prompts[i] for i in asked]), strict=True):
                        replies[i] = told
                latency += [(time.perf_counter() - begin) * 1000.0 / len(part)] * len(part)
            columns = [*batch.columns, pa.array(replies, pa.string()), *([pa.array(latency, pa.float64())] if timed else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.mapInArrow(answer, T.StructType(fields))


#: Rows with one prompt from which on they are dealt over ``SHARES`` groups to meet its reply.
HOT_PROMPT, SHARES = 100_000, 64


def call_model_once(df: DataFrame, prompt: str, factory: ModelFactory, *, reply: str = "reply", **options) -> DataFrame:
    """As ``call_model``, with one call per distinct prompt.

    Prompts meet by a digest, counted before the shuffle, and replies are joined back. The rows of a prompt
    that very many share are dealt over several groups, each with a copy of the reply. For a model that
    answers a prompt the same way each time.
    """
    key = F.unhex(F.sha2(F.col(prompt).cast("binary"), 256))
    rows = durable(df.withColumn("_key", key), "prompts")
    asked = rows.where(F.col(prompt).isNotNull()).groupBy("_key").agg(F.any_value(prompt).alias(prompt), F.count(F.lit(1)).alias("_n"))
    replies = durable(call_model(asked, prompt, factory, reply=reply, **options).drop(prompt), "replies")
    # As many rows at most as the table has rows by HOT_PROMPT; how they meet the table is left to their size.
    hot = durable(replies.where(F.col("_n") >= HOT_PROMPT).select("_key", F.lit(True).alias("_hot")), "hot-prompts")
    every = F.sequence(F.lit(0), F.when(F.col("_n") >= HOT_PROMPT, F.lit(SHARES - 1)).otherwise(F.lit(0)))
    shares = replies.withColumn("_share", F.explode(every)).drop("_n")
    dealt = rows.join(hot, "_key", "left").withColumn(
        "_share", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))).otherwise(F.lit(0)).cast("int")
    )
    return dealt.join(shares, ["_key", "_share"], "left").drop("_key", "_share", "_hot")


def live_prompts(guarded: DataFrame, asked: Column, question: str = "question", reference: str = "reference", answer: str = "answer") -> DataFrame:
    """Add ``_prompt``, null where ``asked`` does not hold."""
    prompt = live_prompt(text_or(F.col(question), "nan"), text_or(F.col(reference), "nan"), text_or(F.col(answer), ""))
    return guarded.withColumn("_prompt", F.when(asked, prompt))


def judged(replies: DataFrame, reply: str = "_reply") -> DataFrame:
    """Score and feedback out of the replies, where there is one; the rules read them stripped, as the model runtime gives them."""
    score, feedback = parse_tagged(strip(F.col(reply)))
    told = F.col(reply).isNotNull()
    return replies.withColumns({
        "score": F.when(told, score).otherwise(F.col("score")), "feedback": F.when(told, feedback).otherwise(F.col("feedback")),
    })


def score_routed(
    guarded: DataFrame,
    factory: ModelFactory,
    *,
    question: str = "question",
    reference: str = "reference",
    answer: str = "answer",
    once: bool = False,
    **model_options,
) -> DataFrame:
    """Score and feedback of the rows that ``guard_live`` left to the model.

    Rows a guard decided never reach Python: the table is split on the route and
    put together again, because ``when`` around a Python function would call it
    for every row. Give a written table, as it is read twice. With ``once`` equal
    prompts are asked once.
    """
    prompts = live_prompts(guarded.where("route = 'model'"), F.lit(True), question, reference, answer)
    call = call_model_once if once else call_model
    replies = judged(call(prompts, "_prompt", factory, reply="_reply", **model_options))
    return guarded.where("route <> 'model'").unionByName(replies.select(guarded.columns))


def score_answers(
    df: DataFrame, factory: ModelFactory, *, reference: str = "reference", answer: str = "answer", **options
) -> DataFrame:
    """Add route, score and feedback of every answer, live rules; see ``score_routed``.

    Routes are written once, so that the source is read and guarded once; a stream is guarded in both parts.
    """
    guarded = guard_live(df, answer, reference)
    if not df.isStreaming:
        guarded = durable(guarded, "routes")
    return score_routed(guarded, factory, reference=reference, answer=answer, **options)


def score_benchmark(
    df: DataFrame,
    factory: ModelFactory,
    *,
    question: str = "question",
    reference: str = "reference",
    answer: str = "candidate",
    **model_options,
) -> DataFrame:
    """Add route, score and ``latency_ms`` of every case, benchmark rules; decided rows take 0 ms."""
    guarded = guard_eval(df, answer, reference)
    prompts = guarded.where("route = 'model'").withColumn(
        "_prompt",
        eval_prompt(text_or(F.col(question), "nan"), text_or(F.col(reference), "nan"), text_or(F.col(answer), "")),
    )
    replies = call_model(prompts.drop("score"), "_prompt", factory, reply="_reply", timed=True, **model_options)
    judged = replies.withColumn("score", parse_numeric(strip(F.col("_reply")))).drop("_prompt", "_reply")
    decided = guarded.where("route <> 'model'").withColumn("latency_ms", F.lit(0.0))
    return decided.unionByName(judged)
