"""SimHash near-duplicates: 64-bit fingerprints linked by generalised pigeonhole search.

Fingerprints are split into parts of correlated bits. A pair within `bits` differing bits must, for any
thresholds t_i that sum to ``bits - parts + 1``, differ in at most t_i bits of some part i. Every fingerprint picks
its own thresholds by dynamic programming over estimated candidate counts (t_i = -1 leaves a part out), probes
the values within t_i of its own in each part, and the candidates are verified on all 64 bits.

A bucket whose pairs would outnumber its rows by `work` times is not joined. All fingerprints that live in or probe
such buckets go through an exact way that makes no pairs: two fingerprints differ in at most two bits if and only if
some 64-bit value lies within one bit of both, so each emits its 65 such values, and a value that several share
(at most 65 can) links them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, connected_components, maybe_in, picked, small

BITS = 64
#: Pairs that a bucket may make for each of its rows before its fingerprints take the pair-free way.
WORK = 32
#: Candidate rows that one probe costs in the allocation.
PROBE_COST = 1.0


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of `text` (A-Z lower-cased, repeats counted): null or no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def of_sets(ends: np.ndarray, hashes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The SimHash of each run of 64-bit `hashes`, from one of `ends` to the next: a bit is 1 if over half have it; none: 0."""
    size = np.diff(ends)
    row, ones = np.repeat(np.arange(len(size)), size), np.zeros((len(size), BITS), np.int32)
    for at in range(0, len(row), block):
        own = row[at : at + block]
        first = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        ones[own[first]] += np.add.reduceat(unpacked(hashes[at : at + block]), first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, h, fp) for every row of `docs`: a hash of the text, and the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(found.view(np.int64))], ["id", "h", "fp"])

    chosen = picked(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return chosen.mapInArrow(work, f"id {chosen.schema['id'].dataType.simpleString()}, h long, fp long")


def unpacked(fps: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each fingerprint, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def projected(bits: np.ndarray, places: list[int]) -> np.ndarray:
    return bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))


def bit_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size, correlated ones together: each group starts with the
    first free bit and takes, one by one, the free bit of the largest mean absolute correlation with it."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for part in range(parts):
        group = [free.pop(0)]
        while len(group) < (BITS * (part + 1)) // parts - (BITS * part) // parts:
            best = max(free, key=lambda b: (round(float(tie[b, group].mean()), 9), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


class Allocation:
    """Thresholds for each fingerprint and part, from counts of all fingerprints by half of a part."""

    def __init__(self, groups: list[list[int]], counts: dict[tuple[int, int], int], n: int, bits: int):
        self.groups, self.units = groups, bits + 1
        self.halves = [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]
        self.near = []
        for k, half in enumerate(self.halves):
            values = np.arange(1 << len(half))
            share = np.array([counts.get((k, int(v)), 0) for v in values]) / max(n, 1)
            near = np.stack([share] + [np.zeros(len(values))] * bits, axis=1)
            for d in range(1, bits + 1):
                for flips in combinations(range(len(half)), d):
                    near[:, d] += share[values ^ sum(1 << f for f in flips)]
            self.near.append(near)
        self.n = n
        self.masks = [
            [np.array([sum(1 << f for f in c) for d in range(t + 1) for c in combinations(range(len(g)), d)], np.int64) for t in range(bits + 1)]
            for g in groups
        ]

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """For each fingerprint and part its threshold, -1 for none; they sum to bits - parts + 1."""
        rows, parts, units = len(bits), len(self.groups), self.units
        best = np.full((rows, units + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for i in range(parts):
            a = self.near[2 * i][projected(bits, self.halves[2 * i])]
            b = self.near[2 * i + 1][projected(bits, self.halves[2 * i + 1])]
            cost, within = [np.zeros(rows)], np.zeros(rows)
            for t in range(units):
                within = within + sum(a[:, d] * b[:, t - d] for d in range(t + 1))
                cost.append(within * self.n + PROBE_COST * len(self.masks[i][t]))
            options = np.full((rows, units + 1, units + 1), np.inf)
            for used in range(units + 1):
                for take in range(units + 1 - used):
                    options[:, used + take, take] = best[:, used] + cost[take]
            chosen.append(options.argmin(axis=2))
            best = options.min(axis=2)
        out, left = np.empty((rows, parts), np.int64), np.full(rows, units)
        for i in reversed(range(parts)):
            take = chosen[i][np.arange(rows), left]
            out[:, i] = take - 1
            left = left - take
        return out


def _arrow_fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(fps: DataFrame, count) -> list:
    """Sums of fixed-size tables that every task makes of its fingerprints: (a, b, n) rows, by (a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k, table in enumerate(count(unpacked(_arrow_fps(batch)))):
                total[k] = total.get(k, 0) + table
        for k, table in total.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(table[at])], ["a", "b", "n"])

    return fps.select("fp").mapInArrow(work, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()


def links(fps: DataFrame, bits: int = 2, parts: int | None = None, work: int = WORK) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints `fps` (fp) connected by `bits` (0 to 2) differing bits.

    Not every linked pair is listed where a crowded bucket links its members through their smallest.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    n = fps.count()
    parts = parts or (4 if n < 1 << 22 else 3)
    together = np.zeros((BITS, BITS))
    for r in _summed(fps, lambda b: [np.rint(b.T.astype(np.float32) @ b.astype(np.float32)).astype(np.int64).ravel()]):
        together[divmod(r.b, BITS)] = r.n
    groups = bit_groups(together, n, parts)
    halves = [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]
    counts = _summed(fps, lambda b: [np.bincount(projected(b, h), minlength=1 << len(h)) for h in halves])
    plan = Allocation(groups, {(r.a, r.b): r.n for r in counts}, n, bits)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _arrow_fps(batch)
            bit = unpacked(fp)
            limit = plan.thresholds(bit)
            for i, group in enumerate(groups):
                value = projected(bit, group)
                rows = [(value, fp, False)]
                for t in range(bits + 1):
                    at, masks = np.flatnonzero(limit[:, i] == t), plan.masks[i][t]
                    rows.append(((value[at, None] ^ masks).ravel(), np.repeat(fp[at], len(masks)), True))
                for v, f, probe in rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(f), pa.array(np.full(len(v), probe))],
                        ["part", "value", "fp", "probe"],
                    )

    rows = checkpointed(fps.select("fp").mapInArrow(signatures, "part int, value long, fp long, probe boolean"))
    sizes = rows.groupBy("part", "value").agg(F.count_if(~F.col("probe")).alias("here"), F.count_if("probe").alias("probes"))
    crowded = small(checkpointed(sizes.filter(F.col("here") * F.col("probes") > work * (F.col("here") + F.col("probes"))).select("part", "value")))
    light = rows.join(crowded, ["part", "value"], "left_anti")
    found = (
        light.filter(~F.col("probe")).select("part", "value", F.col("fp").alias("a"))
        .join(light.filter("probe").select("part", "value", F.col("fp").alias("b")), ["part", "value"])
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    return found.unionByName(_linked_by_neighbours(rows.join(crowded, ["part", "value"], "left_semi").select("fp").distinct(), bits)).distinct()


def _linked_by_neighbours(fps: DataFrame, bits: int) -> DataFrame:
    """(a, b) links of fingerprints that share a value within one bit of each; for bits < 2, verified."""
    flips = np.array([0] + [1 << b for b in range(BITS)], np.uint64).view(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _arrow_fps(batch)
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, len(flips)))], ["z", "fp"])

    shared = fps.mapInArrow(work, "z long, fp long").groupBy("z").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    if bits == 2:  # any two within one bit of z are within two of each other
        pairs = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    else:  # at most 65 in a list
        pairs = shared.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return pairs.filter("a < b")


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int) -> DataFrame:
    """(id, h, fp, root, component): the root names the component among fingerprints, the other among ids."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = checkpointed(connected_components(links(distinct, bits)))
    rooted = checkpointed(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component")))
    by_fp = checkpointed(rooted.join(least, "root").select("fp", "root", "component"))
    return fps.join(by_fp, "fp").select("id", "h", "fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(id, fp, component): for every row of `docs` its fingerprint and the smallest id that it is linked to.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with one id keep their own
    fingerprints; a null id is never the smallest unless its component has no other; an empty table gives no rows.
    """
    return _linked(docs, id_col, text_col, shingle, bits).select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row of `docs` for each near-duplicate component: that of the smallest id, and of its smallest text hash if
    unlike texts of the component share the id. All columns stay.

    A null id counts as the largest. Rows alike in id and text are one document and leave one row. Texts that are in different components
    stay, whatever their ids; null and empty texts are near-duplicates of each other.
    """
    return least_of_each(docs, _linked(docs, id_col, text_col, shingle, bits).select("id", "h", "root"), id_col, text_col)


def least_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each root of `found` (id, h, root), h a hash of the text: the least by id, nulls last, and h."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    least = checkpointed(found.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.id").alias("__id"), F.col("least.h").alias("__h")))
    gone = found.join(least, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_anti")
    gone = checkpointed(gone.select(F.col("id").alias("__id"), F.col("h").alias("__gone")).distinct())
    hashed, marks = docs.withColumn("__h", F.xxhash64(text_col)), gone.select(F.col("__gone").alias("__h"))
    # Most rows are surely not among those that go, and aren't moved.
    rest = maybe_in(hashed, "__h", marks).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__gone")), "left")
    rest = rest.filter("__gone is null").drop("__id", "__gone")  # Spark would move an anti-join below the bitmap's
    out = maybe_in(hashed, "__h", marks, others=True).unionByName(rest)
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__h"])
    return out.drop("__h")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
