"""Source divergence: how the terms of each source differ from its language and from every other source.

A term's smoothed share p of a group never falls when its count in the group rises, and its share q of
the language never falls when its count there rises. So a term that has k others with at least its
group count, at most its language count and an earlier spelling has k terms before it in the order of
p - q, and cannot be among the first k. What is left is the k-skyband of three coordinates. Every
partition finds the skyband of its own terms, the skybands are merged, and only their members are ranked.

Distances between sources are sums over all terms. The sources of a language are dealt into tiles and
its terms into slices; a task holds two tiles and one slice as a dense block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from .batches import SLICE_BYTES, slices, utf8

#: Shares are in parts of so many, and every count is raised by so much.
PARTS, ADDED = 1_000_000_000, 5
#: Sources of a tile, terms of a slice (both about), and shares of a group in which skybands are merged.
TILE, SLICE, SHARES = 64, 4096, 16
#: Terms that a task holds before it hands them on, and texts after which it does so at once.
MOST, LONG = 400_000, 1 << 20

# Bytes outside terms become blanks; A-Z are lowered. All bytes from 0x80 on belong to terms.
_TABLE = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split()


class _Held:
    """Counts per group since the last hand-over."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        if (lang, source) not in self.groups:
            # A blank in front marks the group itself: no term begins so.
            self.groups[lang, source] = (Counter({b" " + source: 0}), Counter())
        counts, docs = self.groups[lang, source]
        before = len(counts)
        own = terms_of(text)
        counts.update(own)
        docs.update(set(own))
        self.size += len(counts) - before + 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in self.groups.items():
            names = list(counts)
            for i in range(0, len(names), 1 << 16):
                part = names[i : i + (1 << 16)]
                columns = [
                    pa.array([lang] * len(part), pa.binary()).cast(pa.string()),
                    pa.array([source] * len(part), pa.binary()).cast(pa.string()),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([counts[x] for x in part], pa.int64()),
                    pa.array([docs[x] for x in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        self.groups.clear()
        self.size = 0


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), counted inside each task.

    Null lang, source and text are empty. Every group also has a row with its source behind a blank as
    term, so that groups without terms are seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for start, length in slices(batch.column(2), SLICE_BYTES):
                for row in zip(*map(utf8, batch.slice(start, length).columns)):
                    held.add(*row)
                    if held.size > MOST or len(row[2]) > LONG:
                        yield from held.batches()
        yield from held.batches()

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*read).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, source, term, n, lang_n, first: terms in at least ``least`` documents of their language.

    ``lang_n`` counts the term in the whole language; ``first`` is true in one row per language and term.
    Rows of groups (see ``term_counts``) stay, with null ``lang_n``. One shuffle: counts meet by language
    and term, already added up per task.
    """
    group = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
    counted = group.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    is_group = F.col("term").startswith(" ")
    seen = counted.withColumns({
        "lang_n": F.when(~is_group, F.sum("n").over(same)),
        "_docs": F.sum("docs").over(same),
        "first": ~is_group & (F.min("source").over(same) == F.col("source")),
    })
    return seen.where(is_group | (F.col("_docs") >= least)).select("lang", "source", "term", "n", "lang_n", "first")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + ADDED) / (total + ADDED * terms)), in whole numbers."""
    above = F.lit(PARTS).cast("decimal(10,0)") * (n + ADDED).cast("decimal(19,0)")
    below = (total + ADDED * terms).cast("decimal(19,0)")
    whole = F.call_function("div", above, below)
    return F.when(terms > 0, whole + 1).otherwise(F.lit(0)).cast("long")


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (of kept terms), terms (V of the language), sources, lang_total; one row per group."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = durable(groups, "divergence-sums")
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count(F.lit(1)).alias("sources")
    )
    return groups.drop("firsts").join(langs, "lang")


def skyband(counts: np.ndarray, lang_counts: np.ndarray, terms: list[bytes], k: int) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate.

    u dominates t if its count is not lower, its language count not higher, and its bytes come earlier.
    It is enough to look for dominators in the skyband itself: the first k of them are in it.
    """
    spelling = np.empty(len(terms), np.int64)
    spelling[np.asarray(pc.sort_indices(pa.array(terms, pa.binary())))] = np.arange(len(terms))
    order = np.lexsort((spelling, lang_counts, -counts))  # a dominator comes before what it dominates
    lang, place = lang_counts[order], spelling[order]
    kept: list[int] = []
    members = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for begin in range(0, len(order), 256):
        here = slice(begin, begin + 256)
        above = (members[0][None, :] <= lang[here, None]) & (members[1][None, :] < place[here, None])
        beaten = above.sum(1)
        own = (lang[here][None, :] <= lang[here, None]) & (place[here][None, :] < place[here, None])
        own &= np.tri(len(own), k=-1, dtype=bool)
        alive = np.zeros(len(own), bool)
        for i in np.nonzero(beaten < k)[0]:
            alive[i] = beaten[i] + (own[i] & alive).sum() < k
        kept += (begin + np.nonzero(alive)[0]).tolist()
        members = (lang[kept], place[kept])
    return np.sort(order[kept])


def skyband_of_partitions(rows: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, n, lang_n) that fewer than ``k`` others of their group dominate in their partition."""
    names = ["lang", "source", "term", "n", "lang_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], list[tuple]] = {}
        limit: dict[tuple[bytes, bytes], int] = {}
        total = 0

        def reduce(key) -> None:
            nonlocal total
            own = groups[key]
            found = skyband(np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.int64), [x[0] for x in own], k)
            total -= len(own) - len(found)
            groups[key] = [own[i] for i in found]
            limit[key] = 2 * len(found) + 4096

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal total
            for key in list(groups):
                reduce(key)
                own = groups.pop(key)
                columns = [[key[0]] * len(own), [key[1]] * len(own), *map(list, zip(*own))]
                arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            limit.clear()
            total = 0

        for batch in batches:
            raw = [batch.column(i).cast(pa.binary()).to_pylist() if i < 3 else batch.column(i).to_pylist() for i in range(5)]
            for lang, source, *row in zip(*raw):
                key = (lang, source)
                own = groups.setdefault(key, [])
                own.append(tuple(row))
                total += 1
                if len(own) >= limit.get(key, 4096):
                    reduce(key)
                if total > MOST:
                    yield from out()
        yield from out()

    return rows.select(*names).mapInArrow(run, "lang string, source string, term string, n long, lang_n long")


def telling_terms(kept: DataFrame, groups: DataFrame, k: int = 50) -> DataFrame:
    """lang, source, item, value, rank: the ``k`` terms whose share of a group is furthest above that of its language."""
    terms = kept.where(~F.col("term").startswith(" "))
    local = skyband_of_partitions(terms, k)
    dealt = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SHARES)))
    merged = skyband_of_partitions(dealt, k).join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    valued = merged.withColumn("value", p - q).where("value > 0").withColumnRenamed("term", "item")
    return _ranked(valued).where(F.col("rank") <= k)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def _distances(block: pa.Table) -> pa.Table:
    """Sums of |p - q| over a block, less those of as many terms that neither source has; one row per pair.

    Rows with the term " " give every source's tile and the share of a term that it does not have.
    """
    lang, low, high = (block.column(c)[0].as_py() for c in ("lang", "low", "high"))
    is_source = pc.equal(block.column("term"), " ")
    heads = block.filter(is_source).sort_by("source")
    rows = block.filter(pc.invert(is_source))
    names = heads.column("source").combine_chunks()
    base = np.asarray(heads.column("p"))
    tile = np.asarray(heads.column("tile"))
    dense = np.repeat(base[:, None], 0, 1)
    if rows.num_rows:
        encoded = rows.column("term").combine_chunks().dictionary_encode()
        dense = np.repeat(base[:, None], len(encoded.dictionary), 1)
        at = np.asarray(pc.index_in(rows.column("source").combine_chunks(), value_set=names))
        dense[at, np.asarray(encoded.indices)] = np.asarray(rows.column("p"))
    firsts, seconds, sums = [], [], []
    for i in range(len(base)):
        # A pair is counted once: by its order inside a tile, from the lower tile to the higher otherwise.
        others = np.arange(i + 1, len(base)) if low == high else np.nonzero(tile == high)[0] if tile[i] == low else []
        if len(others):
            apart = np.abs(dense[others] - dense[i]).sum(1) - dense.shape[1] * np.abs(base[others] - base[i])
            firsts += [i] * len(others)
            seconds += list(others)
            sums += apart.tolist()
    take = lambda x, t: pa.array(x, t)
    return pa.table({
        "lang": pa.array([lang] * len(sums), pa.string()),
        "a": names.take(take(firsts, pa.int64())).cast(pa.string()),
        "b": names.take(take(seconds, pa.int64())).cast(pa.string()),
        "p_a": pa.array(base[np.array(firsts, int)], pa.int64()),
        "p_b": pa.array(base[np.array(seconds, int)], pa.int64()),
        "apart": take(sums, pa.int64()),
    })


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by the sum of |p - q| over all kept terms.

    A task holds the sources of two tiles and the terms of one slice: about 2 TILE x SLICE numbers, however
    many sources and terms there are. The result itself has a row for each two sources.
    """
    tiles = F.ceil(F.col("sources") / TILE)
    placed = groups.withColumns({
        "tile": F.pmod(F.xxhash64("source"), tiles).cast("int"),
        "tiles": tiles.cast("int"),
        "slices": (F.col("terms") / SLICE).cast("int") + 1,
    })
    by_term = kept.where(~F.col("term").startswith(" ")).join(placed, ["lang", "source"]).select(
        "lang", "source", "term", "tile", "tiles", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"),
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
    )
    heads = placed.select(
        "lang", "source", F.lit(" ").alias("term"), "tile", "tiles",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        _share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p"),
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = by_term.unionByName(heads).withColumn("_with", partner).select(
        "lang", "source", "term", "tile", "slice", "p",
        F.least("tile", "_with").alias("low"), F.greatest("tile", "_with").alias("high"),
    )
    apart = rows.groupBy("lang", "low", "high", "slice").applyInArrow(
        _distances, "lang string, a string, b string, p_a long, p_b long, apart long"
    )
    sums = apart.groupBy("lang", "a", "b").agg(
        F.sum("apart").alias("apart"), F.abs(F.max("p_a") - F.max("p_b")).alias("base")
    )
    terms = groups.select("lang", "terms").distinct()
    sums = sums.join(terms, "lang").withColumn("value", F.col("apart") + F.col("base") * F.col("terms"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))
    ))
    return _ranked(sums.select("lang", "value", both.alias("x")).select("lang", "value", "x.*"))


def audit_sources(docs: DataFrame, least: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs (lang, source, text).

    Part ``pair`` ranks every other source of the language by its distance, part ``term`` the first ``k``
    terms above their share of the language. Nulls are empty strings; repeated rows count each; other
    columns are not read; ties go by UTF-8 order; a group without kept terms is as far from another as the
    shares of unseen terms are, 0 if its language has no kept term. An empty table gives no rows.
    """
    kept = durable(kept_terms(docs, least), "divergence-terms")
    groups = durable(group_totals(kept), "divergence-groups")
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair"))
    terms = telling_terms(kept, groups, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
