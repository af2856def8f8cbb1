"""Prefix trie of conversations, built by the van Emde Boas recursion.

A range of depths is cut at its half. The upper half is a trie, and below every prefix that ends at the
cut hangs a trie of the lower half. Both are cut again, down to single turns. All tries of one size are
handled by the same few joins, so the number of rounds is the logarithm of the longest conversation, and
a conversation of any length is dealt over all tasks.

* Names. Two adjacent segments of turns give the name of the segment of twice the size. From the top
  down, the name of the prefix at a cut is made of the name of the prefix where its range begins and the
  name of the segment between. Equal prefixes have equal names, whatever conversation they are in.
* Totals. From the bottom up, what the trie below a cut prefix sums to is grafted onto every prefix of
  the upper half that the cut prefix extends: its ancestors there, read off its smallest member.

Names are SHA-256 digests, each kind with a mark of its own in front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import with_position
from ..sources.durable import durable

#: Binary logarithms of the turns of a conversation, and of the ids of a node, that are handled as one row's neighbours.
CHUNK, IDS = 12, 12


def _digest(mark: int, *parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(bytes([mark])), *parts), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), token (digest of role and text), bytes (UTF-8 length of the text).

    Order is by turn, null first; rows with the same turn are ordered by their digest, and repeated rows
    are turns each. Null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    token = _digest(0, F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), token.alias("token"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return with_position(rows, ["turn", "token"], ["conv_id"], "pos").select("conv_id", "pos", "token", "bytes")


def with_shared_openings(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: (turns, conversations).

    Conversation c takes the first h turns of c - c % group, all if fewer and none if absent, and then its
    own from the h-th on, with h = crc32(c) % (most + 1). Takes conv_id, pos, token, bytes and gives
    conv_id, depth (from 1), token, bytes; and conv_id, size (turns) of every conversation.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    size = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = durable(convs.select("conv_id", "base", "h", "taken", "n", size.alias("size")), "trie-conversations")
    # A base has at most `group` followers, and each takes at most `most` turns.
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    opening = convs.join(heads, "base").where(F.col("pos") < F.col("taken")).withColumn("depth", F.col("pos") + 1)
    # A long conversation meets its row chunk by chunk.
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", CHUNK)))
    spread = convs.select("conv_id", "h", "taken", chunks.alias("chunk"))
    rest = turns.withColumn("chunk", F.shiftright("pos", CHUNK)).join(spread, ["conv_id", "chunk"])
    rest = rest.where(F.col("pos") >= F.col("h")).withColumn("depth", F.col("pos") - F.col("h") + F.col("taken") + 1)
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "token", "bytes"]
    return opening.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", F.col("size").cast("long").alias("size"))


def prefix_names(turns: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """conv_id, depth, name, bytes (of the last turn): every prefix of every conversation, from depth 0 on.

    ``turns``: conv_id, depth (1 to 2 ** levels, no gaps), token, bytes; ``convs``: conv_id.
    """
    segments = [turns.select("conv_id", (F.col("depth") - 1).alias("at"), F.col("token").alias("name"), "bytes")]
    for _ in range(1, levels + 1):
        right = F.col("at") % 2 == 1
        pair = segments[-1].groupBy("conv_id", F.shiftright("at", 1).alias("up")).agg(
            F.max(F.when(~right, F.col("name"))).alias("_left"), F.max(F.when(right, F.col("name"))).alias("_right"),
            F.max(F.when(right, F.col("bytes"))).alias("bytes"),
        ).where("_right is not null")  # a segment that the conversation does not fill has no cut behind it
        segments.append(durable(
            pair.select("conv_id", F.col("up").alias("at"), _digest(1, F.col("_left"), F.col("_right")).alias("name"), "bytes"),
            "trie-segments",
        ))
    zero = F.lit(0).cast("long")
    prefixes = convs.select("conv_id", zero.alias("depth"), F.lit(b"").alias("name"), zero.alias("bytes"))
    for k in reversed(range(levels + 1)):
        # Prefixes so far end at multiples of 2 ** (k + 1); the next ones lie one segment further.
        behind = segments[k].where("at % 2 = 0").select(
            "conv_id", F.shiftleft("at", k).alias("depth"), F.col("name").alias("_segment"), F.col("bytes").alias("_bytes")
        )
        further = prefixes.join(behind, ["conv_id", "depth"]).select(
            "conv_id", (F.col("depth") + (1 << k)).alias("depth"), _digest(2, F.col("name"), F.col("_segment")).alias("name"),
            F.col("_bytes").alias("bytes"),
        )
        prefixes = durable(prefixes.unionByName(further), "trie-prefixes")
    return prefixes


def graft(nodes: DataFrame, prefixes: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """``nodes`` (name, conv_id, depth, ...) with each column of ``totals`` summed over the node's subtree.

    In round k every total covers the depths from the node to the end of its block of 2 ** k depths. Two
    blocks become one: the totals of the lower block's topmost nodes go to their ancestors in the upper one.
    """
    for k in range(levels):
        size = 1 << k
        cut = nodes.where(F.col("depth") % (2 * size) == size)
        first, last = F.col("depth") - size, F.col("depth") - 1
        starts = cut.select("conv_id", F.explode(F.sequence(first, last, F.lit(1 << CHUNK))).alias("first"), last.alias("last"), *totals)
        if k > CHUNK:
            starts = starts.repartition("conv_id", "first")  # one long path, on all tasks
        above = F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + ((1 << CHUNK) - 1))))
        paths = starts.select("conv_id", above.alias("depth"), *totals)
        # A name meets once per task before the shuffle, so a prefix that all share is no hot key.
        sums = paths.join(prefixes.select("conv_id", "depth", "name"), ["conv_id", "depth"]).groupBy("name").agg(
            *[F.sum(c).alias(f"_{c}") for c in totals]
        )
        joined = nodes.join(sums, "name", "left")
        kept = [c for c in nodes.columns if c not in totals]
        nodes = durable(
            joined.select(*kept, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in totals]), "trie-nodes"
        )
    return nodes


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations: (nodes, ends).

    ``turns``: conv_id, depth (from 1, no gaps), token, bytes; ``convs``: conv_id, size (turns, may be 0).
    nodes: name, conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (bytes of last turns that further members repeat, over the subtree). ends: name,
    conv_id of the node that each conversation ends in. Without conversations both are empty.
    """
    turns = durable(turns, "trie-turns")
    deepest = convs.agg(F.max("size")).first()[0] or 0
    levels = max(0, int(deepest).bit_length() - 1)  # the largest segment that some conversation fills
    prefixes = prefix_names(turns, convs.select("conv_id"), levels)
    ends = prefixes.join(convs.select("conv_id", F.col("size").alias("depth")), ["conv_id", "depth"]).select("name", "conv_id")
    nodes = durable(prefixes.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("_bytes"),
    ), "trie-nodes")
    up = nodes.where("depth > 0").select(F.col("name").alias("child"), "conv_id", (F.col("depth") - 1).alias("depth"))
    up = durable(up.join(prefixes.select("conv_id", "depth", "name"), ["conv_id", "depth"]).select("child", "name"), "trie-parents")
    children = up.groupBy("name").agg(F.count(F.lit(1)).alias("n_children"))
    # A parent of very many children: a skewed join, which Spark splits on the children's side.
    parents = durable(
        up.join(nodes.select("name", F.col("conv_id").alias("parent_conv_id")), "name").select(F.col("child").alias("name"), "parent_conv_id"),
        "trie-parents",
    )
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    own = nodes.join(children, "name", "left").join(parents, "name", "left").select(
        "name", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"),
        (n_children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("_bytes")).alias("saved_tokens"),
    )
    own = durable(own, "trie-nodes")
    return graft(own, prefixes, int(deepest).bit_length(), ["n_leaves", "saved_tokens"]), ends


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """name, ends_sha256: SHA-256 of the ids of each name in ``ends``, ascending, in decimal, comma-joined.

    Ids become texts in blocks of neighbouring numbers, on all tasks. The digest itself runs over
    its bytes one after the other, by its definition: a task streams a name's blocks and holds one of them.
    """
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("name", F.shiftright("conv_id", IDS).alias("block")).agg(texts.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())],
                names=["name", "ends_sha256"],
            )
            done.clear()
            return made

        for rows in batches:
            for own, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if digest is not None and own == name:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            if len(done) > 1 << 13:
                yield batch()
        if digest is not None:
            done.append((name, digest.hexdigest()))
        yield batch()

    ordered = blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids")
    return ordered.mapInArrow(run, "name binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turn, role, text) with shared openings.

    Columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see
    ``numbered_turns``, ``with_shared_openings`` and ``prefix_trie`` for nulls, ties and repeated rows.
    Other columns are not read. An empty table gives no rows.
    """
    turns = durable(numbered_turns(conversations), "trie-numbered")
    nodes, ends = prefix_trie(*with_shared_openings(turns))
    digests = digest_of_ends(ends)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
