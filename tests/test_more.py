"""Observed builds, prompts asked once, empty banks, NaN, and texts of the overview."""

import uuid

import pytest
from pyspark.sql import functions as F

from vivabank.functions import labels
from vivabank.operators import analytics, bank, metrics, scoring
from vivabank.sources import durable

BANK = "ID long, Domain string, Difficulty_Level string, Question string, Reference_Answer string"


def test_observed_build_writes_the_new_rows_and_reads_once(spark):
    old = spark.createDataFrame([(7, "D", "Easy", "What is a heap?", "x"), (9, "D", "Easy", None, "x")], BANK)
    rows = [("What is a heap?", 0), ("What is a stack?", 1), ("what is a  STACK?", 2), ("How do threads share memory?", 3)]
    source = lambda k: spark.createDataFrame(
        [(k, i, None, "Easy", q if k == 0 else f"{q} {k}", "a") for q, i in rows],
        "src_ord int, row_ord long, about string, Difficulty_Level string, Question string, Reference_Answer string",
    )
    path = durable.new_path(spark, "bank")
    old.write.parquet(path)
    names = ["a", "b", "none"]
    audit = bank.build_bank_observed(old, names, source(0), source(1), path=path)
    assert {r.stage: r.rows for r in audit.collect()} == {"a": 4, "b": 4, "none": 0, "old bank": 2, "new after dedup": 5, "final": 7}
    plain = bank.build_audit(old, names, source(0), source(1))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, audit.collect()))
    whole = spark.read.schema(BANK).parquet(path)
    want = bank.build_bank(old, source(0), source(1))
    assert sorted(map(str, whole.collect())) == sorted(map(str, want.collect()))


def test_equal_prompts_are_asked_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "HOT_PROMPT", 50)
    folder = str(tmp_path)

    def counted():
        def ask(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(prompts))
            return [f"<score>{len(p) % 11}</score>" for p in prompts]

        return ask

    rows = [(i, "hot" if i % 3 == 0 else f"p{i % 40}" if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(6)
    out = {r.id: r.reply for r in scoring.call_model_once(df, "prompt", counted, name="counted").collect()}
    assert out == {i: p and f"<score>{len(p) % 11}</score>" for i, p in rows}
    asked = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n")]
    assert sorted(asked) == sorted({p for _, p in rows if p})


def test_empty_bank_has_a_total(spark):
    empty = spark.createDataFrame([], BANK)
    assert [tuple(r) for r in analytics.bank_cube(empty).collect()] == [(None, None, 3, 0, 0)]
    assert [r.line for r in analytics.stats_lines(empty).collect()] == ["Total rows: 0"]


def test_domains_in_the_order_they_occur(spark):
    rows = [(5, "B", "Easy", "q", "a"), (2, "C", "Easy", "q", "a"), (9, "A", "Easy", "q", "a"), (1, None, "Easy", "q", "a"), (7, "C", "Easy", "q", "a")]
    got = analytics.first_seen_domains(spark.createDataFrame(rows, BANK)).collect()
    assert sorted(map(tuple, got)) == [(1, "C"), (2, "B"), (3, "A")]


def test_nan_is_left_out_of_quantiles(spark):
    df = spark.createDataFrame([("P", x) for x in (1.0, 2.0, 3.0, float("nan"), None)], "tier string, latency_ms double")
    assert tuple(metrics.latency_quantiles(df).first()) == (3, 2.0, pytest.approx(2.9))
    assert metrics.latency_box(df).first()["median"] == 2.0


def test_texts_of_the_overview(spark):
    rows = [(5, 80), (65, 80), (0, 0), (126, 160), (30, 50)]
    df = spark.createDataFrame(rows, "total long, possible long")
    total, possible = F.col("total"), F.col("possible")
    pct = labels.percentage(total, possible)
    got = df.select("total", labels.overall_line(total, possible), labels.verdict_advice(pct), labels.grouped(total * 10_000)).collect()
    plain = lambda t, p: f"Overall Result: {t:.1f} / {p} ({t / p * 100:.1f}%)" if p else None
    advice = lambda x: "STRONG HIRE" if x >= 80 else "LEANING HIRE (Requires further review)" if x >= 60 else "NO HIRE (Needs more foundational study)"
    assert [tuple(r) for r in got] == [(t, plain(t, p), advice(t / p * 100 if p else 0), f"{t * 10_000:,}") for t, p in rows]
    line = spark.range(1).select(labels.lost_line(F.lit("Why?"), F.lit(4)), labels.places(F.lit(0.125), 2)).first()
    assert tuple(line) == ("- Q: Why?\n  Score: 4/10 (-6 marks)", "0.12")
