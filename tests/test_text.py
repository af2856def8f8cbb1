"""Normal forms, classes and parsers against Python's own string behaviour."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vivabank.functions import classify, fixed_values as v, labels, parsing, prompts, text

SPACES = [" ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]


def test_blanks_are_pythons():
    assert set(text.BLANKS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_dedup_key(column):
    texts = [f"{s}A{s}{s} b{s}" for s in SPACES] + ["", " ", "x", None]
    assert column(text.strip, texts) == [t and t.strip() if t else t for t in texts]
    expected = [None if t is None else re.sub(r"\s+", " ", t.strip().lower()) for t in texts]
    assert column(text.dedup_key, texts) == expected


def test_core_question(column):
    cases = {
        "Candidate prompt: What is X?": "what is x?",
        " \tINTERVIEW question  :\n What? \n": "what?",
        "Candidate prompt: Candidate prompt: Y": "candidate prompt: y",
        "Please answer the following Y": "please answer the following y",
        "say Interview Question: Y": "say interview question: y",
        "Define and explain:": "",
        "Line\nCandidate prompt: Z": "line\ncandidate prompt: z",
    }
    assert column(text.core_question, list(cases)) == list(cases.values())
    assert column(text.display_question, ["Candidate prompt:  What IS it? "]) == ["What IS it?"]
    # The key of the bank build keeps the prefix.
    assert column(text.dedup_key, ["Candidate prompt:  X"]) == ["candidate prompt: x"]


def test_chat_parts(column):
    cases = [
        "no tags here",
        "<s>[INST] state it [/INST] the processes</s>",
        "<s>[INST] a [/INST] b [INST] c [/INST] d </s>",
        "[INST]only open",
        "[/INST] wrong order [INST]",
        "[INST] two\nlines [/INST] an\nanswer",
        "[INST] <s> x > [/INST] done /</s>s",
        None,
    ]
    both = lambda c: F.struct(*text.chat_parts(c))
    got = [tuple(r) for r in column(both, cases)]
    assert got == [
        (None, None),
        ("tate it", "the processe"),
        ("a", "b [INST] c [/INST] d"),
        (None, None),
        (None, None),
        ("two\nlines", "an\nanswer"),
        ("x >", "done"),
        (None, None),
    ]
    tag = lambda c: F.struct(*text.chat_parts(c, mode="tag"))
    assert tuple(column(tag, [cases[1]])[0]) == ("state it", "the processes")


def test_word_functions(column):
    texts = ["", " ", "one", " one\ttwo ", "a b c", "a b c d"]
    assert column(text.word_count, texts) == [len(t.split()) for t in texts]
    assert column(lambda c: text.has_three_words(text.strip(c)), texts) == [len(t.split()) >= 3 for t in texts]
    assert sorted(column(text.keywords, ["The Trees, trees; and a tree's ROOT: it is O(n), not all"])[0]) == [
        "all", "root", "tree", "trees",
    ]


def test_overlap(column):
    reference = F.array(*[F.lit(f"w{chr(97 + i)}x") for i in range(20)])
    eleven = F.array(*[F.lit(f"w{chr(97 + i)}x") for i in range(11)])
    ratio = column(lambda c: text.overlap_ratio(reference, eleven), ["x"])[0]
    assert ratio == 11 / 20 and ratio >= v.OVERLAP_HIT
    assert column(lambda c: text.overlap_ratio(F.array().cast("array<string>"), eleven), ["x"]) == [None]


def test_infer_domain(column):
    cases = {
        "nothing fits": "Core CS & OS",
        "What is a LOOP": "Core CS & OS",  # oop in loop
        "gradient of a hash": "AI/ML",  # a tie goes to the first
        "hash tree and gradient": "Data Structures & Algorithms",
        "Tell me about a conflict": "Behavioral",
        "hash hash hash, process thread": "Core CS & OS",  # presence, not occurrences
    }
    assert column(classify.infer_domain, list(cases)) == list(cases.values())


def test_map_level(column):
    assert column(classify.map_level, [" Senior ", "BEGINNER", "unknown", None, "medium", "\tHard\n"]) == [
        "Hard", "Easy", "Medium", "Medium", "Medium", "Hard",
    ]


def test_parse_tagged(column):
    said = lambda c: F.struct(*parsing.parse_tagged(c))
    cases = {
        "<feedback> Good\njob </feedback>\n<score> 7 </score>": (7, "Good\njob"),
        "<SCORE>12</SCORE>": (10, v.FEEDBACK_DEFAULT),
        "<feedback>Nice</feedback>": (0, v.FEEDBACK_NO_SCORE),
        "<feedback></feedback><score>3</score>": (3, ""),
        "<score>8/10</score>": (0, v.FEEDBACK_NO_SCORE),
        "<score>-3</score>": (0, v.FEEDBACK_NO_SCORE),
        "<score>" + "9" * 25 + "</score>": (10, v.FEEDBACK_DEFAULT),
        "<score>0000000000000000004</score>": (4, v.FEEDBACK_DEFAULT),
        "<score>5</score><score>9</score>": (5, v.FEEDBACK_DEFAULT),
        "": (0, v.FEEDBACK_NO_SCORE),
    }
    assert [tuple(r) for r in column(said, list(cases))] == list(cases.values())


@pytest.mark.parametrize(
    "reply, score",
    [
        ("Score: 12", 10), ("score 7", 7), ("SCORE:\n 4 of 9", 4), ("7/10", 10), ("7.5", 5), ("42", 10),
        ("no digits", 0), ("I give it a 7", 7), ("007", 7), ("x7 and 300", 7), ("", 0), ("3 then 11", 3),
        ("8" * 40, 10), ("000", 0),
    ],
)
def test_parse_numeric(column, reply, score):
    assert column(parsing.parse_numeric, [reply]) == [score]


def _numeric(reply: str) -> int:
    m = re.search(r"score\s*:?\s*(\d+)", reply, re.I)
    if m:
        return min(int(m[1]), 10)
    whole = [int(x) for x in re.findall(r"\b\d+\b", reply) if int(x) <= 10]
    if whole:
        return whole[-1]
    runs = re.findall(r"\d+", reply)
    return min(int(runs[0]), 10) if runs else 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("score: 0123é4567\n89./x", max_size=14), min_size=40, max_size=60))
def test_parse_numeric_random(spark, replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, x string")
    got = {r.i: r.y for r in rows.select("i", parsing.parse_numeric(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(replies))] == [_numeric(r) for r in replies]


def test_percentages(spark):
    pairs = [(t, 10 * n) for n in range(0, 19) for t in range(0, 10 * n + 1)]
    rows = spark.createDataFrame(pairs, "t int, p int")
    exact = labels.percentage(F.col("t"), F.col("p"))
    got = rows.select("t", "p", labels.round_half_even(exact, 1).alias("r"), labels.verdict(exact).alias("v"))
    for r in got.collect():
        pct = r.t / r.p * 100 if r.p else 0.0
        assert r.r == round(pct, 1)
        assert r.v == ("STRONG HIRE" if pct >= 80 else "LEANING HIRE" if pct >= 60 else "NO HIRE")


def test_message_percent(spark):
    rows = spark.createDataFrame([(s,) for s in range(81)], "s int")
    got = rows.select("s", labels.whole_percent(F.col("s") / F.lit(80.0)).alias("p")).collect()
    assert all(r.p == f"{r.s / 80 * 100:.0f}%" for r in got)


def test_prompts(column):
    q, r, a = F.lit("Q {x}"), F.lit("R"), F.lit("A")
    live = column(lambda c: prompts.live_prompt(q, r, a), ["x"])[0]
    assert "Question: Q {x}\nReference Answer: R\nCandidate's Answer: A\n\nInstructions:" in live
    assert live.endswith("<score>Your integer score here</score>\n\nOutput:\n")
    short = column(lambda c: prompts.eval_prompt(q, r, a), ["x"])[0]
    assert short.endswith("No explanation.\nScore:")
    sft = column(lambda c: prompts.sft_text(F.lit(None), F.lit("Easy"), q, r), ["x"])[0]
    assert sft == "Domain: nan\nDifficulty: Easy\nQuestion: Q {x}\nIdeal Answer: R"


def test_labels(spark):
    row = spark.range(1).select(
        labels.ordinal(F.lit(7)), labels.ordinal(F.lit(123)), labels.phase_tag(F.lit("Medium")),
        labels.level_letter(F.lit("Hard")), labels.tier_name(F.lit("M")), labels.score_band(F.lit(4)),
        labels.predicted_tier(F.lit(7)), labels.tier_is_correct(F.lit("P"), F.lit(7)),
        labels.tier_is_correct(F.lit("M"), F.lit(3)), labels.tier_is_correct(F.lit("W"), F.lit(4)),
    ).collect()[0]
    assert tuple(row) == ("07", "123", "MED", "H", "Partial", "signal", "M", True, True, False)
