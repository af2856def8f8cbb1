"""Compare registered queries with their SQL counterparts: names, types, rows and values.

Usage: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT",
}


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def digest(rows, order) -> str:
    lines = sorted("\x1f".join(repr(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def compare(spark, con, sf: str, name: str, query, sql: str | None) -> dict:
    begin = time.perf_counter()
    df = query(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "rows": len(rows), "spark_s": round(time.perf_counter() - begin, 2)}
    if sql is None:
        return {**out, "ok": None}
    begin = time.perf_counter()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    out["duck_s"] = round(time.perf_counter() - begin, 2)
    out["expected_rows"] = len(expected)
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    off = [(c, t, types.get(c)) for c, t in df.dtypes if _TYPES.get(t, t) != types.get(c)]
    if off:
        out["types"] = off
    if sorted(names) != sorted(df.columns):
        return {**out, "ok": False, "columns": (df.columns, names)}
    order = sorted(names)
    mine, theirs = [df.columns.index(c) for c in order], [names.index(c) for c in order]
    out["ok"] = digest(rows, mine) == digest(expected, theirs)
    if not out["ok"]:
        a = {tuple(r[i] for i in mine) for r in rows}
        b = {tuple(r[i] for i in theirs) for r in expected}
        out["order"] = order
        out["spark_only"] = sorted(map(str, a - b))[:3]
        out["duck_only"] = sorted(map(str, b - a))[:3]
        out["n_diff"] = (len(a - b), len(b - a))
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in sys.argv[2:] or list(queries):
        try:
            result = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as error:  # keep going, the summary counts it
            result = {"name": name, "ok": False, "error": str(error)[:1500]}
        bad += result["ok"] is False
        flag = {True: "ok  ", False: "BAD ", None: "rows"}[result.pop("ok")]
        print(flag, {k: (str(x)[:900] if isinstance(x, (list, str, tuple)) else x) for k, x in result.items()}, flush=True)
    print("without SQL:", [n for n in queries if n not in oracles], "bad:", bad)


if __name__ == "__main__":
    main()
