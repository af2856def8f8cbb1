"""Exported raw question sources, and a profile of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names of the raw sources; the blanks in " level " belong to the name.
TABULAR_SCHEMA = _texts("Number", "language", " level ", "Questions", "Answers", "Unnamed: 5")
CHAT_SCHEMA = _texts("text")
INSTRUCTION_SCHEMA = _texts("instruction", "input", "output")
PAIR_SCHEMA = _texts("input", "response")


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported source; the format is taken from the file name."""
    reader = spark.read.schema(schema)
    name = path.rstrip("/").lower()
    if name.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return reader.json(path)
    if name.endswith((".csv", ".csv.gz")):
        return reader.options(header="true", multiLine="true", quote='"', escape='"').csv(path)
    return reader.parquet(path)


def profile_table(df: DataFrame, name: str, key: str | Sequence[str], width: int = 150) -> DataFrame:
    """Rows, column names and the first row (by ``key``, one or more columns) with values cut to ``width``.

    The count and the smallest key come from one scan of the key columns. The
    sample is then a filter on that key, so files and row groups without it are
    skipped and the wide columns are read for one row only.
    """
    keys = [F.col(f"`{k}`") for k in ([key] if isinstance(key, str) else key)]
    total, first = df.agg(F.count(F.lit(1)), F.min(F.struct(*keys))).first()
    cells = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.substring(F.col(f"`{c}`").cast("string"), 1, width), F.lit("None")))
        for c in df.columns
    ]
    here = F.lit(first is not None)
    for k, value in zip(keys, first or ()):
        here = here & k.eqNullSafe(F.lit(value))
    sample = df.where(here).select(F.concat_ws("; ", *cells).alias("sample"))
    return sample.agg(F.min("sample").alias("sample")).select(
        F.lit(name).alias("source"),
        F.lit("OK").alias("status"),
        F.lit(total).cast("long").alias("rows"),
        F.lit(", ".join(df.columns)).alias("columns"),
        "sample",
    )


def profile_sources(
    spark: SparkSession, sources: Mapping[str, tuple[str, str | Sequence[str]]], width: int = 150
) -> DataFrame:
    """One profile row per source ``name -> (path, order key or keys)``; one that cannot be
    opened gives a FAILED row with its error text."""
    out = None
    for name, (path, key) in sources.items():
        try:
            row = profile_table(spark.read.parquet(path), name, key, width)
        except PySparkException as error:
            text = f"{type(error).__name__}: {error}"[:200]
            row = spark.range(1).select(
                F.lit(name).alias("source"),
                F.lit("FAILED").alias("status"),
                F.lit(None).cast("long").alias("rows"),
                F.lit(None).cast("string").alias("columns"),
                F.lit(text).alias("sample"),
            )
        out = row if out is None else out.unionByName(row)
    return out
