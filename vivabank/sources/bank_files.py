"""The question bank as CSV, and the other text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import BANK_COLUMNS, CSV_MISSING
from ..functions.prompts import sft_text

BANK_SCHEMA = T.StructType(
    [T.StructField("ID", T.LongType())] + [T.StructField(c, T.StringType()) for c in BANK_COLUMNS[1:]]
)

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_bank_csv(spark: SparkSession, path: str, missing: list[str] | None = CSV_MISSING) -> DataFrame:
    """The bank with its fixed schema; quoted fields may hold line breaks.

    Texts listed in ``missing`` become null, as the bank's readers take them;
    ``None`` keeps them.
    """
    df = spark.read.schema(BANK_SCHEMA).options(**_CSV, multiLine="true").csv(path)
    if missing is None:
        return df
    texts = [F.when(~F.col(c).isin(missing), F.col(c)).alias(c) for c in BANK_COLUMNS[1:]]
    return df.select("ID", *texts)


def write_bank_csv(bank: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the five bank columns with a header.

    A CSV with line breaks inside fields is read one file per task, so the
    files are kept small. Spark cannot replace the files it reads from:
    ``path`` must not be the bank's own input.
    """
    (
        bank.select(BANK_COLUMNS)
        .write.mode("overwrite")
        .options(**_CSV, maxRecordsPerFile=rows_per_file)
        .csv(path)
    )


def sft_table(bank: DataFrame) -> DataFrame:
    """One training text per bank row."""
    return bank.select(
        F.col("ID").alias("id"),
        sft_text(
            F.col("Domain"), F.col("Difficulty_Level"), F.col("Question"), F.col("Reference_Answer")
        ).alias("text"),
    )


def write_sft(bank: DataFrame, path: str) -> None:
    sft_table(bank).select("text").write.mode("overwrite").json(path)


def write_stats_lines(lines: DataFrame, path: str) -> None:
    """Write the statistics lines in order, one text file part after the other."""
    ordered = lines.orderBy("section", "domain", "level")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
