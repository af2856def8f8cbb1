"""Reply trees as training conversations.

Messages point to the message they answer. Iterative self-joins double every pointer (parent, 2nd,
4th, 8th ... ancestor) and add up the scores passed on the way, so ``log2(depth)`` joins give every
message its root-to-here path length and score, however deep a tree is. The leaves of a tree are
ranked by the score of their path; the same pointers, followed downwards in size, list the messages
of the chosen paths. Each path becomes one conversation in a chat template.

Template: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n`` for each message. Inside roles and texts a
backslash is doubled, and one is put behind the first character of every control string, this
template's and others'. So no control string is left in a text, and ``parse`` gets every text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Strings that chat templates use for control.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _put(s: str) -> str:
    return s[0] + "\\" + s[1:]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(_put(s))), CONTROL, doubled)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, s: F.replace(t, F.lit(_put(s)), F.lit(s)), CONTROL, text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Messages of the ``branches`` best root-to-leaf paths of each tree.

    ``messages``: tree, node, parent, role, text, score. Result: tree, branch (1 is best), position
    (0 at the root), path_score, role, text. A path's score is the sum of its messages' scores (null:
    0); ties go to the longer path, then the smaller leaf. A parent that is null or missing makes a
    root; a null tree is a tree; of repeated (tree, node) rows the smallest by (parent, role, text)
    stays; rows without node and rows whose parents run in a circle belong to no path.
    """
    columns = ["parent", "role", "text", "score"]
    nodes = (
        messages.where(F.col("node").isNotNull())
        .withColumn("_t", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null")))
        .groupBy("_t", "node")
        .agg(F.first("tree").alias("tree"), F.min(F.struct(*columns)).alias("m"))
        .select("_t", "node", "tree", "m.*")
    )
    nodes = durable(nodes, "chat-nodes")
    keys = nodes.select("_t", F.col("node").alias("up"))
    here = (
        nodes.select("_t", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("gain"))
        .join(keys.withColumn("there", F.lit(True)), ["_t", "up"], "left")
        .select("_t", "node", F.when(F.col("there"), F.col("up")).alias("up"), "gain", F.lit(1).cast("long").alias("steps"))
    )
    first = durable(here, "chat-up")
    total = first.count()
    # Pointers still open, per level, and messages that have met their root: only the former are joined on.
    opens, done = [first.where("up is not null")], [first.where("up is null")]
    while opens[-1].head(1) and 1 << (len(opens) - 1) <= total:
        now = opens[-1]
        beyond = reduce(DataFrame.unionByName, [*done, now]).select(
            "_t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("g2"), F.col("steps").alias("s2")
        )
        doubled = durable(
            now.join(beyond, ["_t", "up"]).select(
                "_t", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("g2")).alias("gain"), (F.col("steps") + F.col("s2")).alias("steps")
            ),
            "chat-up",
        )
        opens.append(doubled.where("up is not null"))
        done.append(doubled.where("up is null"))
    rooted = reduce(DataFrame.unionByName, done)
    inner = opens[0].select("_t", F.col("up").alias("node")).distinct()
    order = Window.partitionBy("_t").orderBy(F.desc("gain"), F.desc("steps"), "node")
    leaves = (
        rooted.join(inner, ["_t", "node"], "left_anti")
        .withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
        .select("_t", "branch", "node", F.col("gain").alias("path_score"))
    )
    path = durable(leaves, "chat-path")
    for level in reversed(opens[:-1]):
        above = path.join(level.select("_t", "node", "up"), ["_t", "node"]).select(
            "_t", "branch", F.col("up").alias("node"), "path_score"
        )
        path = durable(path.unionByName(above), "chat-path")  # else the plan doubles with every level
    return (
        path.join(rooted.select("_t", "node", "steps"), ["_t", "node"])
        .join(nodes.select("_t", "node", "tree", "role", "text"), ["_t", "node"])
        .select("tree", "branch", (F.col("steps") - 1).alias("position"), "path_score", "role", "text")
    )


def format_paths(paths: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per (tree, branch): ``formatted`` and ``loss_mask``, the spans to learn from.

    Spans are (start, end) in code points of ``formatted``: the texts of the roles in ``learn``. A
    null role or text is the empty one. A conversation is one row, so it must fit into memory.
    """
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(SEP))
    before = Window.partitionBy("tree", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        paths.select("tree", "branch", "position", head.alias("head"), text.alias("body"), F.col("role").isin(*learn).alias("on"))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    )
    span = F.when(F.col("on"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    rows = pieces.groupBy("tree", "branch").agg(
        F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("rows"),
        F.sort_array(F.collect_list(span)).alias("loss_mask"),
    )
    return rows.select("tree", "branch", F.array_join("rows.piece", "").alias("formatted"), "loss_mask")


def parse(formatted: Column) -> Column:
    """The messages of a formatted conversation: array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda t: t != "")

    def message(turn: Column) -> Column:
        halves = F.split(F.substr(turn, F.lit(len(START) + 1)), r"\Q" + SEP + r"\E", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, message)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
