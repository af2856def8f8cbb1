"""Choosing questions for sessions: uniform over unseen rows, without session x bank pairs.

A session's next question is drawn uniformly from the *rows* of its pool (domain,
level) whose question it has not seen. Let every row ring at the events of its own
Poisson process of rate 1: the order in which the questions ring first is the order
of such draws. Of this a session looks at the beginning only:

* The heaviest questions of a pool (``heads`` of them, bounded) ring once, on an
  exponential clock with their number of rows as rate.
* All rows behind them are one stream; each of its arrivals picks a row number, and
  an equi-join with the bank's row numbers tells the question.
* What comes before the last arrival looked at is final. A session that has too
  few questions by then looks at twice as many arrivals.

A plan has at most half as many questions as there are heads. So the unseen heads
outweigh all seen questions of the stream, and more than every second event is new
on any data: few sessions look again, and their number falls with each round.

Draws are md5 of (seed, session, level, ...), so a plan can be computed again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import LEVELS, PHASE_LIMITS
from ..functions.text import core_question, display_question, strip, text_or
from ..sources.durable import durable
from .analytics import domain_list
from .positions import with_position, with_running_total

# Arrivals per wanted question that a session looks at first.
FIRST_ARRIVALS = 2
_HASH_RANGE = 2.0**60


@dataclass(frozen=True)
class Pools:
    """The bank's questions, numbered through so that the rows of a pool, and inside it the
    copies of a question, stand together, questions with most copies first.

    ``rows``: row, id, core_id — one per question row.
    ``cores``: domain, level, core_id, first_row, weight — one per pool and distinct question.
    ``sizes``: domain, level, pool_row, n_rows, heads, n_tail — one per pool. ``heads`` are the
    first questions, a bounded list; ``n_tail`` rows stand behind them.

    All are written tables, so their sizes are known when joins are planned."""

    rows: DataFrame
    cores: DataFrame
    sizes: DataFrame


def question_text(bank: DataFrame) -> DataFrame:
    """Question rows as a session shows them: id, display text, reference text."""
    return bank.select(
        F.col("ID").cast("long").alias("id"),
        display_question(F.col("Question")).alias("question"),
        text_or(F.col("Reference_Answer"), "nan").alias("reference"),
    )


def build_pools(bank: DataFrame, heads: int = 2 * sum(PHASE_LIMITS.values())) -> Pools:
    """Number the bank by (domain, level, question). The level compares without case.

    ``heads``: questions of a pool that get their own clock, twice as many as a plan has in all.
    """
    keyed = bank.where(F.col("Domain").isNotNull() & F.col("Difficulty_Level").isNotNull()).select(
        F.col("Domain").alias("domain"),
        F.lower("Difficulty_Level").alias("level"),
        F.col("ID").cast("long").alias("id"),
        # A digest, so that no text is shuffled.
        F.unhex(F.md5(core_question(F.col("Question")))).alias("_key"),
    )
    # Counted before the window: a question may have very many copies, but few levels.
    counted = keyed.groupBy("domain", "_key", "level").agg(
        F.min("id").alias("_least"), F.count(F.lit(1)).alias("weight")
    )
    # A question is named by its smallest id, in all levels of the domain.
    named = counted.select(
        "domain", "_key", "level", "weight",
        F.min("_least").over(Window.partitionBy("domain", "_key")).alias("core_id"),
    )
    weighed = keyed.join(named, ["domain", "_key", "level"]).select(
        "domain", "level", (-F.col("weight")).alias("_light"), "core_id", "id"
    )
    rows = durable(with_position(weighed, ["domain", "level", "_light", "core_id", "id"], out="row"), "pool-rows")
    cores = durable(
        rows.groupBy("domain", "level", "core_id").agg(
            F.min("row").alias("first_row"), F.count(F.lit(1)).alias("weight")
        ),
        "pool-cores",
    )
    # The limit on the row number cuts before the shuffle, so a pool's list has ``heads`` entries at most.
    place = F.row_number().over(Window.partitionBy("domain", "level").orderBy("first_row"))
    heavy = (
        cores.withColumn("_place", place)
        .where(F.col("_place") <= heads)
        .groupBy("domain", "level")
        .agg(
            F.collect_list(F.struct("core_id", "first_row", "weight")).alias("heads"),
            F.sum("weight").alias("_n_heads"),
        )
    )
    totals = cores.groupBy("domain", "level").agg(
        F.min("first_row").alias("pool_row"), F.sum("weight").alias("n_rows")
    )
    sizes = durable(
        totals.join(heavy, ["domain", "level"]).select(
            "domain", "level", "pool_row", "n_rows", "heads", (F.col("n_rows") - F.col("_n_heads")).alias("n_tail")
        ),
        "pool-sizes",
    )
    return Pools(rows.select("row", "id", "core_id"), cores, sizes)


def _digest(seed: int, kind: str, *last: Column) -> Column:
    """md5 over what is drawn, for whom."""
    parts = [F.lit(seed), F.lit(kind), F.col("session"), F.col("level"), *last]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _number(digest: Column, half: int = 0) -> Column:
    """A number in 0 .. 2^60 - 1 from either half of a digest."""
    return F.conv(F.substring(digest, 1 + 15 * half, 15), 16, 10).cast("long")


def _waiting(digest: Column, rate: Column) -> Column:
    """Exponential time at ``rate``."""
    return -F.log((_number(digest) + 1) / F.lit(_HASH_RANGE)) / rate


def _by_session(requests: DataFrame) -> DataFrame:
    """Spread the short request rows by session before they grow to candidates.

    With a bank small enough to be broadcast, the candidates of a session are then
    already together and are not shuffled again. The number of partitions is
    given, or the few bytes would be put into one task.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(n, "session")


def _candidates(requests: DataFrame, pools: Pools, seed: int) -> DataFrame:
    """Questions of requests (session, domain, level, lv, draws) with the time ``ord`` they ring.

    Looks at ``draws`` arrivals of the pool's stream; heads that ring later than the last are left out.
    """
    known = requests.join(pools.sizes, ["domain", "level"])
    attempts = F.when(F.col("n_tail") > 0, F.sequence(F.lit(0), F.col("draws") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    digests = F.transform(attempts, lambda k: _digest(seed, "row", k))
    n_tail = F.greatest("n_tail", F.lit(1))
    tail_row = F.col("pool_row") + F.col("n_rows") - F.col("n_tail")
    steps = F.transform(
        digests,
        lambda d: F.struct(_waiting(d, n_tail).alias("wait"), (tail_row + _number(d, 1) % n_tail).alias("row")),
    )
    start = F.struct(F.lit(0.0).alias("now"), F.array().cast("array<struct<ord:double,row:bigint>>").alias("all"))

    def arrive(state: Column, step: Column) -> Column:
        now = state["now"] + step["wait"]
        here = F.struct(now.alias("ord"), step["row"].alias("row"))
        return F.struct(now.alias("now"), F.array_append(state["all"], here).alias("all"))

    rings = F.transform(
        F.transform(
            "heads",
            lambda h: F.struct(
                _digest(seed, "core", h["core_id"]).alias("d"), h["first_row"].alias("first"), h["weight"].alias("n")
            ),
        ),
        lambda h: F.struct(_waiting(h["d"], h["n"]).alias("ord"), h["d"].alias("d"), h["first"].alias("first"), h["n"].alias("n")),
    )
    looked = known.select(
        "session", "domain", "lv", F.aggregate(steps, start, arrive).alias("_tail"), rings.alias("_heads"),
        (F.col("n_tail") > 0).alias("_open"),
    )
    # Few heads ring in time, and only those need a row.
    final = F.transform(
        F.filter("_heads", lambda h: ~F.col("_open") | (h["ord"] <= F.col("_tail.now"))),
        lambda h: F.struct(h["ord"].alias("ord"), (h["first"] + _number(h["d"], 1) % h["n"]).alias("row")),
    )
    events = looked.select("session", "domain", "lv", F.inline(F.concat(final, F.col("_tail.all"))))
    return events.join(pools.rows.drop("id"), "row").select("session", "domain", "lv", "ord", "core_id", "row")


def draw_next(
    sessions: DataFrame, asked: DataFrame, bank: DataFrame, seed: int = 0, pools: Pools | None = None
) -> DataFrame:
    """One unseen question per session.

    ``sessions``: session, domain, level. ``asked``: session, id of bank rows
    asked before; neither those rows nor rows with the same question come again.
    A session whose pool is exhausted is missing from the result (session, id).

    One number among the unseen rows is drawn. The row it stands for lies behind the
    seen questions that begin at or before it, when seen rows are not counted.
    """
    pools = pools or build_pools(bank)
    group = ["session", "domain", "level"]
    requests = (
        sessions.select("session", "domain", F.lower("level").alias("level"))
        .join(pools.sizes.select("domain", "level", "pool_row", "n_rows"), ["domain", "level"])
        .withColumn("_drawn", _number(_digest(seed, "next")))
    )
    # The asked question by name, whatever its level.
    names = asked.join(pools.rows.drop("row"), "id").select("session", "core_id").distinct()
    seen = (
        names.join(requests.select(*group, "pool_row").distinct(), "session")
        .join(pools.cores, ["domain", "level", "core_id"])
        .select(*group, (F.col("first_row") - F.col("pool_row")).alias("_begin"), "weight")
    )
    seen = with_running_total(seen, ["_begin"], "weight", group, "_before", "_seen")
    unseen = F.col("n_rows") - F.coalesce("_seen", F.lit(0))
    # No try at a number where nothing is left.
    drawn = requests.join(seen, group, "left").where(unseen > 0).withColumn("_place", F.col("_drawn") % unseen)
    passed = F.when(F.col("_begin") - F.col("_before") <= F.col("_place"), F.col("weight")).otherwise(F.lit(0))
    found = drawn.groupBy(*group, "pool_row", "_place").agg(F.sum(passed).alias("_passed"))
    rows = found.select("session", (F.col("pool_row") + F.col("_place") + F.col("_passed")).alias("row"))
    return rows.join(pools.rows, "row").select("session", "id")


def _fold_picks(candidates: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Walk a session's candidates level by level and keep unseen questions up to the limits.

    A session has a bounded number of candidates: the heads and the arrivals looked at.
    """
    walk = F.sort_array(F.collect_list(F.struct("lv", "ord", "core_id", "row")))
    most = F.array(*[F.lit(n) for n in limits])
    start = F.struct(
        F.array().cast("array<bigint>").alias("seen"),
        F.array().cast("array<struct<lv:int,q_num:int,row:bigint>>").alias("picks"),
        F.lit(0).alias("lv"),
        F.lit(0).alias("got"),
    )

    def step(state: Column, item: Column) -> Column:
        # The walk goes up the levels, so one counter will do.
        got = F.when(item["lv"] == state["lv"], state["got"]).otherwise(F.lit(0))
        take = (got < F.get(most, item["lv"])) & ~F.array_contains(state["seen"], item["core_id"])
        pick = F.struct(item["lv"].alias("lv"), (got + 1).alias("q_num"), item["row"].alias("row"))
        taken = F.struct(
            F.array_append(state["seen"], item["core_id"]).alias("seen"),
            F.array_append(state["picks"], pick).alias("picks"),
            item["lv"].alias("lv"),
            (got + 1).alias("got"),
        )
        return F.when(take, taken).otherwise(state)

    grouped = candidates.groupBy("session", "domain").agg(walk.alias("walk"))
    return grouped.select("session", "domain", F.aggregate("walk", start, step)["picks"].alias("picks"))


def _requests(sessions: DataFrame, draws: Sequence[int]) -> DataFrame:
    """One request per session and level."""
    levels = [
        F.struct(F.lit(x.lower()).alias("level"), F.lit(lv).alias("lv"), F.lit(n).alias("draws"))
        for lv, (x, n) in enumerate(zip(LEVELS, draws))
    ]
    return sessions.select("session", "domain", F.inline(F.array(*levels)))


def _short_sessions(folded: DataFrame, pools: Pools, limits: Sequence[int]) -> DataFrame:
    """Sessions (session, domain) that want more questions of a level than they have, where more will arrive."""
    def got(lv: int) -> Column:
        return F.size(F.filter("picks", lambda p: p["lv"] == lv))

    counts = [
        F.struct(F.lit(x.lower()).alias("level"), (got(lv) < n).alias("few"))
        for lv, (x, n) in enumerate(zip(LEVELS, limits))
    ]
    few = folded.select("session", "domain", F.inline(F.array(*counts))).where("few")
    more = pools.sizes.where(F.col("n_tail") > 0).select("domain", "level")
    return durable(few.join(more, ["domain", "level"], "left_semi").select("session", "domain").distinct(), "plan-short")


def question_plan(
    sessions: DataFrame,
    bank: DataFrame,
    seed: int = 0,
    limits: Mapping[str, int] = PHASE_LIMITS,
    pools: Pools | None = None,
) -> DataFrame:
    """The questions of every session: (session, domain, level, q_num, id).

    ``sessions``: session, domain. Up to ``limits`` questions per level, in the
    order they would be drawn; no question twice in a session, across levels too.
    A session that needs fewer questions uses the first ones.

    ``pools`` may be given, as ``build_pools`` made them for this bank; with limits
    above the standard ones they need ``heads`` of twice the sum of the limits.
    """
    wanted = [limits[x] for x in LEVELS]
    pools = pools or build_pools(bank, 2 * sum(wanted))
    waiting, draws = sessions.select("session", "domain"), [FIRST_ARRIVALS * n + 1 for n in wanted]
    parts = []
    while True:
        requests = _requests(_by_session(waiting), draws)
        folded = durable(_fold_picks(_candidates(requests, pools, seed), wanted), "plan")
        waiting = _short_sessions(folded, pools, wanted)
        if waiting.isEmpty():
            parts.append(folded)
            break
        parts.append(folded.join(waiting, ["session", "domain"], "left_anti"))
        draws = [2 * n for n in draws]
    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    rows = plan.select("session", "domain", F.inline("picks"))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return rows.join(pools.rows, "row").select(
        "session", "domain", F.get(names, F.col("lv")).alias("level"), "q_num", "id"
    )


def validate_starts(starts: DataFrame, bank: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``reason`` to start requests (…, domain): the domain must be in the bank."""
    known = (
        bank.where(F.col("Domain").isNotNull())
        .select(F.col("Domain").alias("domain"))
        .distinct()
        .withColumn("accepted", F.lit(True))
    )
    judged = starts.join(known, "domain", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return judged.withColumn("reason", F.when(~F.col("accepted"), F.lit("domain not found")))


def start_sessions(starts: DataFrame, bank: DataFrame, plan: DataFrame) -> DataFrame:
    """First turn of every accepted start: (session, domain, difficulty, question_id, question, q_num, phase_total).

    A session whose domain has no Easy question is left out, as its start is refused.
    """
    first = plan.where("level = 'Easy' and q_num = 1").select("session", F.col("id").alias("question_id"))
    accepted = validate_starts(starts, bank).where("accepted").select("session", "domain")
    texts = question_text(bank).select(F.col("id").alias("question_id"), "question")
    return accepted.join(first, "session").join(texts, "question_id").select(
        "session", "domain", F.lit("Easy").alias("difficulty"), "question_id", "question",
        F.lit(1).alias("q_num"), F.lit(PHASE_LIMITS["Easy"]).alias("phase_total"),
    )


def resolve_domains(requests: DataFrame, bank: DataFrame) -> DataFrame:
    """Domain a user's text stands for: (…, raw) plus status and domain.

    Digits are a menu number; other text must occur in exactly one domain name,
    without case. Domains and texts meet on the text's first characters (up to
    three), so there is no join of every text with every domain.
    """
    menu = domain_list(bank)  # numbered from a table written once
    typed = requests.withColumn("_raw", strip(F.coalesce("raw", F.lit("")))).withColumn("_needle", F.lower("_raw"))
    by_number = F.col("_raw").rlike(r"\A[0-9]+\z")
    needles = typed.where(~by_number).select("_needle").distinct().withColumn("_gram", F.substring("_needle", 1, 3))
    name = F.lower("domain")
    # All pieces of length 1 to 3 of a name, and the empty one, which every name holds.
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))),
            lambda i: F.array(*[F.substr(name, i, F.lit(n)) for n in (1, 2, 3)]),
        )
    )
    grams = menu.select(
        "domain", F.explode(F.array_distinct(F.array_append(pieces, F.lit("")))).alias("_gram")
    )
    matched = (
        needles.join(grams, "_gram")
        .where(F.contains(F.lower("domain"), F.col("_needle")))
        .groupBy("_needle")
        .agg(F.count(F.lit(1)).alias("_hits"), F.min("domain").alias("_match"))
    )
    text_part = (
        typed.where(~by_number)
        .join(matched, "_needle", "left")
        .withColumn(
            "status",
            F.when(F.col("_hits") == 1, F.lit("selected"))
            .when(F.col("_hits") > 1, F.lit("ambiguous"))
            .otherwise(F.lit("none")),
        )
        .withColumn("domain", F.when(F.col("_hits") == 1, F.col("_match")))
    )
    number_part = (
        typed.where(by_number)
        .withColumn("_ord", F.expr("try_cast(_raw as decimal(38,0))").cast("decimal(38,0)"))
        .join(menu.withColumn("_ord", F.col("ord").cast("decimal(38,0)")).drop("ord"), "_ord", "left")
        .withColumn("status", F.when(F.col("domain").isNotNull(), F.lit("selected")).otherwise(F.lit("invalid")))
    )
    keep = [*requests.columns, "status", "domain"]
    return text_part.select(keep).unionByName(number_part.select(keep))
