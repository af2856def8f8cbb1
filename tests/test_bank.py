"""Bank build, analytics, positions and files."""

import random

import pytest
from pyspark.sql import functions as F

from vivabank.operators import analytics, bank, positions
from vivabank.sources import bank_files, durable, raw_sources

BANK = "ID long, Domain string, Difficulty_Level string, Question string, Reference_Answer string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def old(spark):
    return spark.createDataFrame(
        [(5, "AI/ML", "Easy", "What is  KNN?", "a"), (9, None, "Hard", None, "b")], BANK
    )


@pytest.fixture
def sources(spark):
    tabular = spark.createDataFrame(
        [
            (1, "1", "Java", "Easy", "What is Java?", "A language."),
            (2, "2", "Java", None, " what IS   java? ", "Copy, dropped."),
            (3, "3", None, "Senior", "What is knn?", "Known, dropped."),
            (4, "4", "C", "Hard", "None", "x"),
            (5, "5", "C", "Hard", "q", " NaN "),
            (6, "6", "C", "Hard", None, "x"),
            (7, "7", None, "junior", "Candidate prompt: What is Java?", "Kept: the prefix is part of the key."),
        ],
        'order int, Number string, language string, ` level ` string, Questions string, Answers string',
    )
    chat = spark.createDataFrame(
        [
            (1, "<s>[INST] Explain a hash [/INST] nineteen chars here </s>"),
            (2, "<s>[INST] Explain a heap [/INST] exactly 20 chars yep </s>"),
            (3, "nothing"),
            (4, "[INST] What is Java? [/INST] a later copy of the first source"),
        ],
        "order int, text string",
    )
    instruction = spark.createDataFrame(
        [(1, "i", "None", "Dropped?"), (2, "i", "hint", "Tell me about you"), (3, "i", None, "Dropped too")],
        "order int, instruction string, input string, output string",
    )
    return [
        bank.from_tabular(tabular, "order"),
        bank.from_chat(chat, "order"),
        bank.from_instruction(instruction, "order"),
    ]


def test_build(old, sources):
    built = bank.build_bank(old, *sources)
    new = [tuple(r) for r in built.orderBy("ID").collect() if r.ID > 9]
    assert new == [
        (10, "Core CS & OS", "Easy", "What is Java?", "A language."),
        (11, "Core CS & OS", "Easy", "Candidate prompt: What is Java?", "Kept: the prefix is part of the key."),
        (12, "Data Structures & Algorithms", "Medium", "Explain a heap", "exactly 20 chars yep"),
        (13, "Behavioral", "Medium", "Tell me about you", "hint"),
    ]


def test_build_twice_adds_nothing(spark, old, sources):
    built = durable.durable(bank.build_bank(old, *sources), "built")
    again = bank.build_bank(built, *sources)
    assert rows(again) == rows(built)
    shuffled = [s.repartition(5, F.rand(3)) for s in sources]
    assert rows(bank.build_bank(old, *shuffled)) == rows(built)


def test_empty_source_in_audit(spark, old, sources):
    audit = {r.stage: r.rows for r in bank.build_audit(old, ["a", "b", "c"], *sources[:2], sources[2].where("false")).collect()}
    assert audit["a"] == 4 and audit["b"] == 2 and audit["c"] == 0 and audit["old bank"] == 2
    assert audit["final"] == audit["old bank"] + audit["new after dedup"]


def test_missing_columns_take_their_defaults(spark):
    bare = spark.createDataFrame([(1, "What is a thread?", "x")], "order int, Questions string, Answers string")
    row = bank.with_domain(bank.from_tabular(bare, "order")).collect()[0]
    assert tuple(row) == (0, 1, "", "Medium", "What is a thread?", "x", "Core CS & OS")


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("key"))
    plan = bank.keep_first(df, "key", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_positions(spark):
    n = 5000
    keys = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"g{i % 7}") for i in range(n)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame(keys, "i int, g string")
    got = positions.with_position(df, ["i"], ["g"]).collect()
    groups = {}
    for i, g in sorted(keys, key=lambda k: k[0]):
        groups.setdefault(g, []).append(i)
    assert len(got) == n
    assert all(groups[r.g][r.position] == r.i for r in got)
    whole = positions.with_position(df, ["i"]).collect()
    assert sorted(r.position for r in whole) == list(range(n)) and all(r.position == r.i for r in whole)


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = [("a", float(x)) for x in rng.integers(0, 50, 700)] + [("b", float(x)) for x in rng.normal(size=333)]
    values += [("a", 7.0)] * 600 + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(values, "g string, x double")
    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: r.quantiles for r in positions.exact_quantiles(df, "x", ps, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(list(np.quantile([x for k, x in values if k == g], ps)))
    assert "d" not in got
    alone = positions.exact_quantiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double"), "x", [0.95])
    assert alone.collect()[0].quantiles[0] == pytest.approx(8.95)


def test_cube_drops_missing_keys(spark):
    df = spark.createDataFrame(
        [(1, None, "Easy", "Q", ""), (2, "d", None, "q ", ""), (3, "d", "Odd", "r", ""), (4, "d", "Easy", None, ""), (5, "d", "Easy", "nan", "")],
        BANK,
    )
    cube = {(r.domain, r.level, r.gid): (r.rows, r.unique_q) for r in analytics.bank_cube(df).collect()}
    assert cube == {
        (None, None, 3): (5, 3),
        ("d", None, 1): (4, 3),
        (None, "Easy", 2): (3, 2),
        (None, "Odd", 2): (1, 1),
        ("d", "Odd", 0): (1, 1),
        ("d", "Easy", 0): (2, 1),
    }
    stats = {(r.metric, r.key): r.value for r in analytics.bank_stats(df).collect()}
    assert stats[("total", "")] == 5 and stats[("unique_q", "")] == 3
    assert stats[("per_level", "Hard")] == 0 and stats[("per_level", "Easy")] == 3
    assert rows(analytics.bank_pivot(df)) == [("d", 2, 0, 0)]
    assert rows(analytics.domain_list(df)) == [(1, "d")]


def test_stats_text(spark, old):
    path = durable.new_path(spark, "stats")
    bank_files.write_stats_lines(analytics.stats_lines(old), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["Total rows: 2", "AI/ML | Easy | 1 unique"]
    assert analytics.summary_lines(old).collect()[0].line == "  AI/ML" + " " * 34 + "Easy" + " " * 8 + "1 unique questions"


def test_csv_keeps_texts(spark):
    texts = ['a "quoted", text', "two\nlines", "cr\r\nlf", " blanks ", "back\\slash", "x,y", 'ends with "', "\\"]
    df = spark.createDataFrame([(i, "D", "Easy", t, t[::-1]) for i, t in enumerate(texts)], BANK)
    path = durable.new_path(spark, "csv")
    bank_files.write_bank_csv(df, path, rows_per_file=3)
    assert rows(bank_files.read_bank_csv(spark, path)) == rows(df)


def test_csv_missing_texts(spark):
    df = spark.createDataFrame([(1, "None", "", "N/A", None), (2, "none", "NaN", "x", "nan")], BANK)
    path = durable.new_path(spark, "csv")
    bank_files.write_bank_csv(df, path)
    assert rows(bank_files.read_bank_csv(spark, path)) == [(1, None, None, None, None), (2, "none", None, "x", None)]
    kept = bank_files.read_bank_csv(spark, path, missing=None).where("ID = 2").collect()[0]
    assert kept.Reference_Answer == "nan"


def test_sft_sink(spark, old):
    path = durable.new_path(spark, "sft")
    bank_files.write_sft(old, path)
    texts = {r.text for r in spark.read.json(path).collect()}
    assert "Domain: nan\nDifficulty: Hard\nQuestion: nan\nIdeal Answer: b" in texts


def test_exports_and_profile(spark):
    pairs = spark.createDataFrame([("General", "Why\nus?" + "y" * 200), ("g2", None)], raw_sources.PAIR_SCHEMA)
    root = durable.new_path(spark, "exports")
    pairs.write.json(f"{root}/d.json")
    pairs.write.option("header", True).option("escape", '"').csv(f"{root}/d.csv")
    pairs.write.parquet(f"{root}/d.parquet")
    for name in ("d.json", "d.csv", "d.parquet"):
        assert rows(raw_sources.read_export(spark, f"{root}/{name}", raw_sources.PAIR_SCHEMA)) == rows(pairs)
    profile = raw_sources.profile_sources(
        spark, {"d": (f"{root}/d.parquet", "input"), "gone": (f"{root}/none.parquet", "x")}, width=60
    )
    ok, failed = sorted(profile.collect(), key=lambda r: r.source)
    assert (ok.status, ok.rows, ok.columns) == ("OK", 2, "input, response")
    assert ok.sample == "input=General; response=" + ("Why\nus?" + "y" * 200)[:60]
    assert failed.status == "FAILED" and "PATH_NOT_FOUND" in failed.sample and failed.rows is None
