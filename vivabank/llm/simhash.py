"""SimHash near-duplicates: fingerprints, and a Hamming join by the generalised pigeonhole principle.

If bits are split into parts and part i gets a threshold t_i with sum (t_i + 1) = t + 1, two
fingerprints within t bits agree up to t_i bits in some part i (t_i = -1 leaves a part out). The parts
group bits that vary together, so the other parts tell more apart. The thresholds are chosen by
dynamic programming on the probes and candidates each part would cost. Fingerprints are then looked
up by (part, bits of the part with up to t_i of them flipped), and every candidate is verified.

Equal fingerprints are one row before the join, so groups of copies make no pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable
from .batches import annotate
from .components import components

BITS = 64


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bits set in over half of the shingles' hashes; no word: 0."""
    own = text.lower().split()  # bytes: A-Z, and \x20 \x09-\x0D, only
    if not own:
        return 0
    shingles = zip(*(own[i:] for i in range(words))) if len(own) >= words else [own]
    hashes = np.fromiter(map(_hash, map(b" ".join, shingles)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep=None) -> DataFrame:
    """Add ``fingerprint`` (a long) to every row; null and empty texts have 0."""

    def factory():
        def compute(texts: list[bytes]):
            made = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
            return [made.view(np.int64)]

        return compute

    return annotate(docs, factory, "fingerprint long", keep=keep)


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, how often each two bits are both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                raw = np.ascontiguousarray(batch.column(0)[i : i + (1 << 14)].to_numpy(zero_copy_only=False))
                bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(raw)
        at = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["at", "n"]
        )

    rows = prints.select("fingerprint").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {r["at"]: r["n"] for r in rows}  # 4097 rows
    counts = np.array([found.get(i, 0) for i in range(BITS * BITS)]).reshape(BITS, BITS)
    return found.get(-1, 0), counts


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated bits in the same group."""
    p = np.diag(together) / max(1, n)
    covariance = together / max(1, n) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(covariance / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0, up to 1, ... up to ``most`` of bits set with chances p."""
    differ = 2 * p * (1 - p)
    exact = np.zeros(most + 1)
    exact[0] = 1.0
    for d in differ:
        exact[1:] = exact[1:] * (1 - d) + exact[:-1] * d
        exact[0] *= 1 - d
    return np.cumsum(exact)


@dataclass
class Part:
    bits: list[int]
    threshold: int

    @property
    def mask(self) -> int:
        return _mask(self.bits)

    def flips(self) -> list[int]:
        """Every change of up to ``threshold`` of the part's bits."""
        return [_mask(list(c)) for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) with sum (t + 1) = ``total`` of least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if used + k <= total and cost + more < following.get(used + k, (np.inf,))[0]:
                    following[used + k] = (cost + more, [*chosen, k - 1])
        best = following
    return best[total]


def plan_parts(prints: DataFrame, distance: int) -> list[Part]:
    """Parts and thresholds for distinct fingerprints. All statistics are over all of them.

    A part's candidates at threshold 0 are counted (pairs with equal bits in the part); at higher
    thresholds that count grows as independent bits of the same frequencies would have it.
    """
    n, together = bit_counts(prints)
    p = np.diag(together) / max(1, n)
    grouped = {m: group_bits(n, together, m) for m in range(2, distance + 2)}
    every = [(m, i, bits) for m, groups in grouped.items() for i, bits in enumerate(groups)]
    keys = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(_mask(bits))).alias("key"))
        for k, (_, _, bits) in enumerate(every)
    ])
    sizes = prints.select(F.explode(keys).alias("x")).groupBy("x.k", "x.key").count()
    same = {r.k: float(r.pairs) for r in sizes.groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, groups in grouped.items():
        costs = []
        for k, (m2, _, bits) in enumerate(every):
            if m2 == m:
                chance = within(p[bits], distance)
                growth = chance / max(chance[0], 1e-300)
                probes = np.cumsum([_choose(len(bits), t) for t in range(distance + 1)])
                # A probe and a stored key cost a shuffled row each, a candidate a comparison.
                costs.append([0.0, *(max(1, n) * (probes + 1) + np.maximum(same.get(k, 0.0), n * n / 2 * chance[0]) * growth)])
        cost, thresholds = allocate(costs, distance + 1)
        if best is None or cost < best[0]:
            best = (cost, [Part(bits, t) for bits, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def hamming_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: distinct values of ``fingerprint`` that differ in at most ``distance`` bits."""
    parts = plan_parts(prints, distance)
    value = F.col("fingerprint")

    def keyed(part: int, key: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), key.alias("key"))

    stored = prints.select(value.alias("b"), F.explode(F.array(*[
        keyed(i, value.bitwiseAND(F.lit(p.mask))) for i, p in enumerate(parts)
    ])).alias("at")).select("b", "at.part", "at.key")
    probes = F.array(*[
        keyed(i, value.bitwiseAND(F.lit(p.mask)).bitwiseXOR(F.lit(x))) for i, p in enumerate(parts) for x in p.flips()
    ])
    asked = prints.select(value.alias("a"), F.explode(probes).alias("at")).select("a", "at.part", "at.key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # A pair that several parts find counts in the first of them.
    first = F.lit(True)
    for i, p in enumerate(parts):
        first &= (F.col("part") <= i) | (F.bit_count(differ.bitwiseAND(F.lit(p.mask))) > p.threshold)
    on = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & first
    return asked.join(stored, ["part", "key"]).where(on).select("a", "b")


def _placed(marked: DataFrame, distance: int) -> DataFrame:
    """fingerprint, component_id of every fingerprint in ``marked`` (doc_id, fingerprint)."""
    classes = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = components(hamming_links(classes.select("fingerprint"), distance))
    # Components of fingerprints have the smallest fingerprint as id; documents want the smallest doc_id.
    placed = classes.join(found, classes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "rep", F.coalesce("component", "fingerprint").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return placed.join(least, "component")


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, keep=None) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to every row of docs (doc_id, text).

    Documents link when their fingerprints differ in at most ``distance`` bits; a component's id is its
    smallest doc_id (null only if all its ids are null). Texts without words share fingerprint 0.
    Repeated rows are in one component. Columns with the added names are replaced.
    """
    columns = [c for c in (keep or docs.columns) if c.lower() not in ("fingerprint", "component_id")]
    marked = durable(fingerprints(docs, words, keep=columns), "simhash")
    placed = _placed(marked, distance).select("fingerprint", "component_id")
    return marked.join(placed, "fingerprint").select(
        *columns, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_key() -> Column:
    """Digest of doc_id and text: the same only for rows that agree in both."""
    parts = [F.coalesce(F.concat(F.lit("="), x), F.lit("null")) for x in (F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))]
    return F.md5(F.concat(parts[0], F.lit(" "), parts[1]).cast("binary"))


def one_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """A row of docs for each component of ``placed`` (doc_id, key, component): smallest doc_id, then smallest key.

    Ids may repeat with different texts: the row is chosen by id and text. Rows that agree in both are in
    one component, so the chosen keys differ and texts move once, to meet them.
    """
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    chosen = durable(placed.groupBy("component").agg(F.min(place)["key"].alias("_key")).select("_key"), "chosen")
    return docs.withColumn("_key", row_key()).join(chosen, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """One row of each component of ``near_duplicates``, columns as they were: the one with the smallest doc_id.

    If an id has several texts in the component, the smallest digest of id and text decides. Rows without an id
    stay, one for each component that has no other.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    marked = durable(fingerprints(keyed, words, keep=["doc_id", "key"]), "simhash")
    placed = _placed(marked, distance).select("fingerprint", "component")
    return one_of_each(docs, marked.join(placed, "fingerprint"))
