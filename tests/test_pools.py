"""Choosing questions: rules hold for every session, and the draws are uniform."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vivabank.operators import pools

BANK = "ID long, Domain string, Difficulty_Level string, Question string, Reference_Answer string"


def bank_rows():
    rows = []

    def add(n, domain, level, question):
        for _ in range(n):
            rows.append((len(rows) + 1, domain, level, question, "ref"))

    # A large pool where one question holds a third of the rows.
    add(40, "Big", "Easy", "hot")
    for i in range(80):
        add(1, "Big", "easy", f"Candidate prompt: E{i}")
    # Medium shares questions with Easy, under other spellings.
    for i in range(60):
        add(1, "Big", "Medium", f"e{i}")
    # Nearly all rows are one question: draws alone cannot do.
    add(5000, "Big", "HARD", "flood")
    for i in range(40):
        add(1, "Big", "Hard", f"h{i}")
    # Small pools.
    add(1, "Small", "Easy", "only")
    add(1, "Small", "Medium", "Interview Question: ONLY")
    for i in range(3):
        add(2, "Small", "Medium", f"m{i}")
    add(1, "Late", "Medium", "no easy one")
    add(1, None, "Easy", "no domain")
    return rows


@pytest.fixture(scope="module")
def bank(spark):
    return spark.createDataFrame(bank_rows(), BANK)


def test_plan_rules(spark, bank):
    domains = ["Big"] * 300 + ["Small"] * 50 + ["Late"] * 20 + ["Gone"] * 5
    sessions = spark.createDataFrame(list(enumerate(domains)), "session long, domain string")
    plan = pools.question_plan(sessions, bank).collect()
    info = {r[0]: (r[1], r[2].capitalize(), r[3].split(": ")[-1].lower()) for r in bank_rows()}
    per = {}
    for p in plan:
        per.setdefault(p.session, []).append(p)
    want = {"Big": (5, 8, 5), "Small": (1, 3, 0), "Late": (0, 1, 0), "Gone": (0, 0, 0)}
    for s, domain in enumerate(domains):
        mine = per.get(s, [])
        counts = Counter(p.level for p in mine)
        assert tuple(counts[x] for x in ("Easy", "Medium", "Hard")) == want[domain], (s, domain)
        assert all(info[p.id][0] == domain and info[p.id][1] == p.level for p in mine)
        cores = [info[p.id][2] for p in mine]
        assert len(set(cores)) == len(cores)
        for level in counts:
            assert sorted(p.q_num for p in mine if p.level == level) == list(range(1, counts[level] + 1))
    assert sorted(map(tuple, pools.question_plan(sessions.repartition(7), bank).collect())) == sorted(map(tuple, plan))


def looked_at(built, sessions, draws=(11, 17, 11)):
    return pools._candidates(pools._requests(sessions, draws), built, 0)


def of_domain(spark, n):
    return spark.range(n).select(F.col("id").alias("session"), F.lit("D").alias("domain"))


def test_sessions_served_by_few_arrivals_are_not_redone(spark):
    rows = [(i, "D", ["Easy", "Medium", "Hard"][i % 3], f"q{i}", "a") for i in range(3000)]
    built = pools.build_pools(spark.createDataFrame(rows, BANK))
    wanted = [5, 8, 5]
    few = pools._fold_picks(looked_at(built, of_domain(spark, 500)), wanted)
    assert pools._short_sessions(few, built, wanted).count() == 0
    starved = pools._fold_picks(looked_at(built, of_domain(spark, 500), (11, 2, 11)), wanted)
    assert pools._short_sessions(starved, built, wanted).count() > 400


def test_a_flood_of_copies_makes_no_more_candidates(spark):
    """One question holds 99 % of the rows: sessions still look at a bounded number of questions, and are complete."""
    rows = [(i, "D", "Easy", "flood" if i >= 400 else f"q{i}", "a") for i in range(40_000)]
    bank = spark.createDataFrame(rows, BANK)
    built = pools.build_pools(bank)
    assert looked_at(built, of_domain(spark, 300)).count() <= 300 * (36 + 11)
    plan = pools.question_plan(of_domain(spark, 300), bank, pools=built)
    assert plan.count() == 300 * 5
    assert plan.select("session", "id").distinct().count() == 300 * 5


def test_more_arrivals_only_add_to_the_end(spark):
    """The plan does not depend on how many arrivals a session looks at first."""
    rows = [(i, "D", "Easy", f"q{i % 60}" if i < 300 else f"r{i}", "a") for i in range(500)]
    built = pools.build_pools(spark.createDataFrame(rows, BANK))
    few, many = (
        {r.session: [tuple(p) for p in r.picks] for r in pools._fold_picks(looked_at(built, of_domain(spark, 200), d), [5, 8, 5]).collect()}
        for d in ((4, 1, 1), (64, 1, 1))
    )
    assert all(len(many[s]) == 5 for s in range(200))
    assert all(many[s][: len(few[s])] == few[s] for s in few) and any(len(p) < 5 for p in few.values())


@pytest.mark.parametrize("n", [32, 35, 36])
def test_one_more_question_keeps_the_other_clocks(spark, n):
    """Pools just below, at and above the number of heads are drawn from in the same way."""

    def order(k):
        built = pools.build_pools(spark.createDataFrame([(i, "D", "Easy", f"q{i}", "a") for i in range(k)], BANK))
        walk = {}
        for r in looked_at(built, of_domain(spark, 100), (400, 1, 1)).orderBy("session", "ord").collect():
            if r.core_id < n and r.core_id not in walk.setdefault(r.session, []):
                walk[r.session].append(r.core_id)
        return walk

    # Question n, if it has no clock of its own, comes from the stream; the others ring as before.
    assert order(n) == order(n + 1)


def test_second_choice_is_uniform_over_what_is_left(spark):
    """40 single questions: heads and stream are equally likely."""
    bank = spark.createDataFrame([(i, "D", "Easy", f"q{i}", "a") for i in range(40)], BANK)
    plan = pools.question_plan(of_domain(spark, 4000), bank).groupBy("q_num", (F.col("id") >= 36).alias("tail")).count()
    shares = {r.q_num: r["count"] / 4000 for r in plan.collect() if r.tail}
    assert all(shares[q] == pytest.approx(0.1, abs=0.02) for q in range(1, 6))


def test_first_draw_is_uniform_over_rows(spark, bank):
    sessions = spark.range(6000).select(F.col("id").alias("session"), F.lit("Big").alias("domain"))
    first = pools.question_plan(sessions, bank).where("q_num = 1").join(
        bank.select(F.col("ID").alias("id"), "Question"), "id"
    )
    shares = {(r.level, r.Question): r["count"] / 6000 for r in first.groupBy("level", "Question").count().collect()}
    # 40 of 120 Easy rows are one question; it is drawn first in a third of the sessions.
    assert shares[("Easy", "hot")] == pytest.approx(1 / 3, abs=0.03)
    assert shares[("Hard", "flood")] == pytest.approx(5000 / 5040, abs=0.01)
    second = pools.question_plan(sessions, bank).where("level = 'Easy' and q_num = 2").join(
        bank.select(F.col("ID").alias("id"), "Question"), "id"
    )
    hot = second.where("Question = 'hot'").count() / 6000
    # After another first question: 2/3 * 40/119.
    assert hot == pytest.approx(2 / 3 * 40 / 119, abs=0.03)


def test_small_pool_is_weighted_by_rows(spark):
    bank = spark.createDataFrame(
        [(1, "D", "Easy", "a", ""), (2, "D", "Easy", "a", ""), (3, "D", "Easy", "a", ""), (4, "D", "Easy", "b", "")], BANK
    )
    sessions = spark.range(4000).select(F.col("id").alias("session"), F.lit("D").alias("domain"))
    first = Counter(r.id for r in pools.question_plan(sessions, bank).where("q_num = 1").collect())
    for i in (1, 2, 3, 4):
        assert first[i] / 4000 == pytest.approx(0.25, abs=0.03)


def test_draw_next(spark, bank):
    info = {r[0]: r for r in bank_rows()}
    big_hard = [i for i, r in info.items() if r[1] == "Big" and r[2].lower() == "hard"]
    others = [i for i in big_hard if info[i][3] != "flood"]
    flood = next(i for i in big_hard if info[i][3] == "flood")
    sessions = spark.createDataFrame(
        [(1, "Big", "hard"), (2, "Big", "Hard"), (3, "Small", "Easy"), (4, "Small", "medium"), (5, "Late", "Easy"), (6, "Big", "HARD")],
        "session long, domain string, level string",
    )
    only_medium = next(i for i, r in info.items() if r[1] == "Small" and "ONLY" in r[3])
    asked = [(1, flood), (2, flood), *[(2, i) for i in others[:-1]], (3, only_medium), *[(6, i) for i in others], (6, flood)]
    got = {r.session: r.id for r in pools.draw_next(sessions, spark.createDataFrame(asked, "session long, id long"), bank).collect()}
    assert got[1] in others  # one copy asked bars all 5000
    assert got[2] == others[-1]
    assert 3 not in got  # its question was asked in another phase
    assert info[got[4]][1:3] == ("Small", "Medium")
    assert 5 not in got and 6 not in got


def test_next_draw_after_a_long_history(spark):
    """All of a large pool asked but one or two questions; what is left is drawn by its rows."""
    bank = spark.createDataFrame([(i, "D", "Easy", f"q{i // 2 * 2 if i < 2000 else i}", "a") for i in range(2001)], BANK)
    sessions = spark.range(2000).select(F.col("id").alias("session"), F.lit("D").alias("domain"), F.lit("easy").alias("level"))
    left = spark.createDataFrame([(1000,), (2000,)], "id int")  # two copies (1000, 1001) and one (2000)
    history = bank.select(F.col("ID").alias("id")).where("id % 2 = 0").join(left, "id", "left_anti")
    asked = sessions.where("session < 300").select("session").crossJoin(history)
    got = {r.session: r.id for r in pools.draw_next(sessions, asked, bank, pools=pools.build_pools(bank)).collect()}
    assert len(got) == 2000
    after = Counter(got[s] for s in range(300))
    assert set(after) == {1000, 1001, 2000} and all(60 <= n <= 140 for n in after.values())
    assert sum(got[s] < 1000 for s in range(300, 2000)) / 1700 == pytest.approx(0.5, abs=0.05)


def test_resolve_domains(spark):
    names = ["AI/ML", "Behavioral", "Core CS & OS", "Data Structures & Algorithms", "X"]
    bank = spark.createDataFrame([(i, d, "Easy", "q", "a") for i, d in enumerate(names)], BANK)
    typed = {
        "1": ("selected", "AI/ML"), " 03 ": ("selected", "Core CS & OS"), "0": ("invalid", None), "6": ("invalid", None),
        "9" * 60: ("invalid", None), "behav": ("selected", "Behavioral"), "&": ("ambiguous", None), "": ("ambiguous", None),
        "x": ("selected", "X"), "X ": ("selected", "X"), "cs & os": ("selected", "Core CS & OS"), "zzz": ("none", None),
        "al": ("ambiguous", None), "AI/ML": ("selected", "AI/ML"), "-1": ("none", None), None: ("ambiguous", None),
    }
    df = spark.createDataFrame(list(enumerate(typed)), "request int, raw string")
    got = {r.raw: (r.status, r.domain) for r in pools.resolve_domains(df, bank).collect()}
    assert got == typed
    plan = pools.resolve_domains(df, bank)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_starts(spark, bank):
    starts = spark.createDataFrame([(1, "Big"), (2, "big"), (3, "Late"), (4, "Small")], "session long, domain string")
    judged = {r.session: (r.accepted, r.reason) for r in pools.validate_starts(starts, bank).collect()}
    assert judged == {1: (True, None), 2: (False, "domain not found"), 3: (True, None), 4: (True, None)}
    first = {r.session: r for r in pools.start_sessions(starts, bank, pools.question_plan(starts, bank)).collect()}
    assert set(first) == {1, 4}
    assert tuple(first[4])[1:] == ("Small", "Easy", first[4].question_id, "only", 1, 5)
