"""Building the question bank from raw sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.classify import infer_domain, map_level
from ..functions.fixed_values import BANK_COLUMNS, DEFAULT_DOMAIN, DOMAIN_LEXICON, MIN_CHAT_ANSWER, MISSING_TEXTS
from ..functions.text import chat_parts, dedup_key, strip, text_or
from ..sources.durable import durable
from .positions import with_position

# Columns of a canonical source row; (src_ord, row_ord) is its place in the merge.
# `about` is what the domain is read from beside the question, null where it is the question alone.
CANONICAL = ["src_ord", "row_ord", "about", "Difficulty_Level", "Question", "Reference_Answer"]


def is_missing(c: Column) -> Column:
    return (c == "") | F.lower(c).isin(MISSING_TEXTS)


def clean_pairs(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Null to text, strip, and drop rows whose question or answer says nothing."""
    cleaned = df.withColumns(
        {question: strip(text_or(F.col(question), "None")), answer: strip(text_or(F.col(answer), "None"))}
    )
    return cleaned.where(~is_missing(F.col(question)) & ~is_missing(F.col(answer)))


def chat_pairs(df: DataFrame, text: str, mode: str = "charset", min_answer: int = MIN_CHAT_ANSWER) -> DataFrame:
    """Add question and answer of a chat text; drop rows without both or with a short answer."""
    question, answer = chat_parts(F.col(text), mode)
    return df.withColumns({"question": question, "answer": answer}).where(
        (F.col("question") != "") & (F.length("answer") >= min_answer)
    )


def _column(df: DataFrame, name: str, default: str) -> Column:
    """A source column as stripped text; ``default`` when the source lacks it."""
    if name not in df.columns:
        return F.lit(default)
    return strip(text_or(F.col(f"`{name}`"), "None"))


def _canonical(df: DataFrame, place: int, order: str, level: Column, about: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(place).alias("src_ord"),
        F.col(order).cast("long").alias("row_ord"),
        (F.lit(None).cast("string") if about is None else about).alias("about"),
        level.alias("Difficulty_Level"),
        F.col("question").alias("Question"),
        F.col("answer").alias("Reference_Answer"),
    )


def from_tabular(df: DataFrame, order: str, place: int = 0) -> DataFrame:
    """Tabular source: level from its level column, domain from question and language."""
    named = df.select(
        order,
        _column(df, "Questions", "").alias("question"),
        _column(df, "Answers", "").alias("answer"),
        _column(df, " level ", "Medium").alias("level"),
        _column(df, "language", "").alias("language"),
    )
    kept = named.where(~is_missing(F.col("question")) & ~is_missing(F.col("answer")))
    return _canonical(kept, place, order, map_level(F.col("level")), F.col("language"))


def from_chat(df: DataFrame, order: str, place: int = 1) -> DataFrame:
    """Chat source: pairs out of the text, level Medium."""
    return _canonical(chat_pairs(df.select(order, "text"), "text"), place, order, F.lit("Medium"))


def from_instruction(df: DataFrame, order: str, place: int = 2) -> DataFrame:
    """Instruction source: ``output`` is the question, ``input`` the answer, level Medium."""
    named = df.select(
        order, _column(df, "output", "").alias("question"), _column(df, "input", "").alias("answer")
    )
    kept = named.where(~is_missing(F.col("question")) & ~is_missing(F.col("answer")))
    return _canonical(kept, place, order, F.lit("Medium"))


def with_domain(
    df: DataFrame, lexicon: Mapping[str, Sequence[str]] = DOMAIN_LEXICON, default: str = DEFAULT_DOMAIN
) -> DataFrame:
    """Add the domain of canonical rows; null ``about`` is left out of the text."""
    return df.withColumn("Domain", infer_domain(F.concat_ws(" ", "Question", "about"), lexicon, default))


def merge_sources(*sources: DataFrame) -> DataFrame:
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source)
    return merged


def keep_first(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order.

    Spark puts a group limit in front of the shuffle, so a key with very many
    copies sends one row per input partition.
    """
    place = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def drop_known(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``. The key must not be null."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def question_digest(question: Column) -> Column:
    """Key of a question in joins and windows: 16 bytes, whatever the length of the text."""
    return F.unhex(F.md5(dedup_key(question)))


def new_questions(old: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged rows with a question the bank does not have, once each.

    The first copies are kept before the anti-join: both need the rows by key,
    so they share one shuffle, and copies are gone before it. Of the bank only
    digests move.
    """
    keyed = merged.withColumn("_key", question_digest(F.col("Question")))
    first = keep_first(keyed, "_key", ["src_ord", "row_ord"])
    # A missing question of the bank prints as nan.
    known = old.select(question_digest(text_or(F.col("Question"), "nan")).alias("_key"))
    return drop_known(first, known, "_key").drop("_key")


def next_ids(old: DataFrame, new: DataFrame, order_by: Sequence[str], id_column: str = "ID") -> DataFrame:
    """Number ``new`` from the bank's largest ID on, in the given order, without gaps."""
    largest = old.agg(F.max(id_column)).first()[0] or 0
    # The sample for the ranges reads the shuffled keys once more; writing ``new`` first costs more than that.
    placed = with_position(new, order_by, out="_place")
    return placed.withColumn(id_column, F.col("_place") + F.lit(largest + 1)).drop("_place")


def build_bank(old: DataFrame, *sources: DataFrame, lexicon: Mapping[str, Sequence[str]] = DOMAIN_LEXICON) -> DataFrame:
    """The old bank followed by the new questions of the sources.

    The domain search, the dearest step per row, comes last: only questions that
    are new get there.
    """
    fresh = next_ids(old, new_questions(old, merge_sources(*sources)), ["src_ord", "row_ord"])
    return old.select(BANK_COLUMNS).unionByName(with_domain(fresh, lexicon).select(BANK_COLUMNS))


def build_bank_observed(
    old: DataFrame, names: Sequence[str], *sources: DataFrame, path: str, lexicon: Mapping[str, Sequence[str]] = DOMAIN_LEXICON
) -> DataFrame:
    """Append the new questions of the sources to the bank at ``path``, and tell the rows of every stage.

    Gives the rows of ``build_audit``. They are counted as the build runs by: each source and the old bank
    are read once, by the job that finds the new questions, and the largest ID comes from the same pass.
    """
    usable, before, added = Observation("usable"), Observation("old bank"), Observation("new")
    count = F.count(F.lit(1))
    merged = merge_sources(*sources).observe(
        usable, *[F.count(F.when(F.col("src_ord") == i, 1)).alias(str(i)) for i in range(len(names))]
    )
    bank = old.observe(before, count.alias("rows"), F.max("ID").alias("largest"))
    fresh = durable(new_questions(bank, merged).observe(added, count.alias("rows")), "new-questions")
    placed = with_position(fresh, ["src_ord", "row_ord"], out="_place")
    numbered = placed.withColumn("ID", F.col("_place") + F.lit((before.get["largest"] or 0) + 1))
    with_domain(numbered, lexicon).select(BANK_COLUMNS).write.mode("append").parquet(path)
    counts = [*[usable.get[str(i)] for i in range(len(names))], before.get["rows"], added.get["rows"]]
    rows = list(zip([*names, "old bank", "new after dedup", "final"], [*counts, counts[-2] + counts[-1]]))
    return old.sparkSession.createDataFrame(rows, "stage string, rows long")


def build_audit(old: DataFrame, names: Sequence[str], *sources: DataFrame) -> DataFrame:
    """Rows per stage of a build: usable per source, old bank, new rows, final bank."""
    merged = merge_sources(*sources)
    # Names as an inline table, so that a source without usable rows shows 0.
    stages = [F.struct(F.lit(i).alias("src_ord"), F.lit(n).alias("stage")) for i, n in enumerate(names)]
    listed = old.sparkSession.range(1).select(F.inline(F.array(*stages)))
    counted = merged.groupBy("src_ord").agg(F.count(F.lit(1)).alias("rows"))
    usable = listed.join(counted, "src_ord", "left").select("stage", F.coalesce("rows", F.lit(0)).alias("rows"))
    before = old.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("old bank").alias("stage"), "rows")
    added = new_questions(old, merged).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("new after dedup").alias("stage"), "rows"
    )
    final = before.unionByName(added).agg(F.sum("rows").alias("rows")).select(F.lit("final").alias("stage"), "rows")
    return usable.unionByName(before).unionByName(added).unionByName(final)
