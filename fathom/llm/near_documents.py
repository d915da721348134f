"""Near-duplicate documents by SimHash, made whole by an exact set-similarity join: no pair is lost to chance.

A document's tokens are its distinct shingles of `shingle` words (A-Z lower-cased; fewer words make one token of them all).
Two documents are linked if the Jaccard similarity of their tokens is at least `similarity`, or if both have no word.

1. Documents of equal token sets are one, under a hash of the set. Each set has a SimHash of its tokens; fingerprints within
   `bits` bits are found by `simhash.links`, and sets that it brings together are linked if their tokens are similar.
2. The rest, similar sets whose fingerprints lie farther apart, is found exactly. Similar sets share at least m tokens of their prefixes, the first ``n - ceil(similarity * n) + m`` of n tokens in any one order
   of all tokens (m, of the smaller set, is 1 and a tenth of n): by how rare their words are together, as the words of their hash buckets occur in all documents (a table of fixed size), then by
   hash. Only prefixes are kept. A set that shares fewer tokens of its prefix with different sets has no near-duplicate and is
   done; so sets that only quote the same passage are never paired. The others list their prefixes (m is 1) anew, by how
   many of them hold a token at all: tokens of one set come first and are not listed, so that edited copies of one
   text, whose own words make up a prefix, don't meet unless they are nearly similar.
3. Under each shared token every set is verified against one leader, so that copies of an original are linked by as
   many pairs as there are copies. Tokens whose sets are all connected by then are done; under tokens that more than `crowd`
   sets hold, other leaders follow for some rounds. What is left is compared in pairs, less those that are
   connected already, that fail the length and positional filters, or whose prefixes share too few tokens: of two similar
   sets, the one whose prefix ends first shares all but its other tokens within both prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash, vec
from .common import BROADCAST_ROWS, checkpointed, connected_components, dropped, kept, maybe_in, picked, small
from .line_dedup import CROWD, _may_match
from .simhash import least_of_each

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of fingerprints that the SimHash search spans.
BITS = 2
#: Rounds of leaders under crowded tokens before their sets are paired.
ROUNDS = 3
#: Share of a set's tokens that a prefix holds, and similar sets share in it, beyond the one of a plain prefix.
MORE = 0.1
#: Rounds in which sets that share too few prefix tokens go, and then tokens that only they shared.
NARROWED = 2
#: Buckets of the table of word counts.
BUCKETS = 1 << 17
STEP = np.uint64(0x9E3779B97F4A7C15)


#: Without counts all tokens are as rare.
ANY = np.zeros(BUCKETS, np.int64)


def _windows(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place of `at` on."""
    out = np.full(len(at), width, np.uint64)
    for j in range(width):
        out = vec.mix(out * STEP + hashes[at + j])
    return out


def token_sets(column: pa.Array, shingle: int, levels: np.ndarray = ANY) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole rows: (first row, row after the last, offsets, tokens, ranks); a row's tokens are distinct and rise.

    A token's rank is the sum of its words' `levels`.
    """
    for first, last, data, ends in vec.slices(column):
        data = vec.LOWER[data]
        starts, stops, row = vec.runs(vec.GRAPH[data], ends)
        hashes = vec.run_hashes(data, starts, stops)
        words = np.bincount(row, minlength=last - first)
        begin = np.cumsum(words) - words
        level = np.concatenate(([0], np.cumsum(levels[_buckets(hashes)])))
        tokens, ranks, rows = [], [], []
        for width in range(1, shingle + 1):
            if width < shingle:
                at = begin[words == width]
            else:
                at = np.flatnonzero(np.arange(len(row)) + width <= (begin + words)[row])
            tokens.append(_windows(hashes, at, width))
            ranks.append(level[at + width] - level[at])
            rows.append(row[at])
        token, rank, owner = np.concatenate(tokens).view(np.int64), np.concatenate(ranks), np.concatenate(rows)
        order = np.lexsort((token, owner))
        token, rank, owner = token[order], rank[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, rank, owner = token[new], rank[new], owner[new]
        yield first, last, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=last - first)))), token, rank


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_levels(docs: DataFrame) -> np.ndarray:
    """How frequent the words of each hash bucket are in all texts: the logarithm of their count, four steps to the double."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, ends in vec.slices(batch.column(0)):
                data = vec.LOWER[data]
                starts, stops, _ = vec.runs(vec.GRAPH[data], ends)
                total += np.bincount(_buckets(vec.run_hashes(data, starts, stops)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    counts = docs.select("text").mapInArrow(work, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(BUCKETS, np.int64)
    levels[counts.column("b").to_numpy()] = np.rint(4 * np.log2(1.0 + counts.column("n").to_numpy()))
    return levels


def _sets(docs: DataFrame, shingle: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(id, h, key, n, fp, prefix) of every row (id, text, h); equal sets have equal keys and fingerprints, and the empty set's are 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ends, tokens, ranks in token_sets(batch.column("text"), shingle, levels):
                size = np.diff(ends)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(vec.mix(tokens.view(np.uint64) ^ STEP))))
                key = vec.mix(total[ends[1:]] - total[ends[:-1]]).view(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((tokens, ranks, row))
                least = np.ceil(size * similarity - 1e-9)
                most = np.where(size > 0, size - least + np.minimum(np.floor(size * MORE) + 1, least), 0).astype(np.int64)
                inside = np.arange(len(row)) - ends[row] < most[row]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))), pa.int32()), pa.array(tokens[order][inside]))
                arrays = [*(batch.column(c).slice(first, last - first) for c in ("id", "h")), pa.array(key), pa.array(size.astype(np.int32)), pa.array(simhash.of_sets(ends, tokens)), prefix]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "key", "n", "fp", "prefix"])

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, h long, key long, n int, fp long, prefix array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the distinct (key, x) pairs of `sets` that are similar; only their texts are fetched from `docs`."""

    def each(column: pa.Array) -> list[np.ndarray]:
        return [t for _, _, ends, tokens, _ in token_sets(column, shingle) for t in np.split(tokens, ends[1:-1])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = list(zip(each(part.column("text")), each(part.column("x_text")), strict=True))
                shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in both], float)
                total = np.array([len(a) + len(b) for a, b in both], float)
                hit = pa.array(shared * (1 + similarity) >= total * similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("key").filter(hit), part.column("x").filter(hit)], ["a", "b"])

    pairs = kept(pairs)
    texts = kept(_texts(docs, sets, pairs.select("key").unionByName(pairs.select(F.col("x").alias("key")))))
    both = pairs.join(texts, "key").join(texts.select(F.col("key").alias("x"), F.col("text").alias("x_text")), "x")
    found = kept(both.select("key", "x", "text", "x_text").mapInArrow(work, "a long, b long"))
    dropped(texts, pairs)
    return found


def _roots(links: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of `links` (a, b), as connected_components finds them; at most `rows` links are joined on the driver."""
    links = checkpointed(links.select("a", "b"))
    if links.limit(rows + 1).count() > rows:
        return checkpointed(connected_components(links))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for r in links.collect():
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    nodes = list(root)
    return links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())}))


def _open(listed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, n, at, token, root, df): the rows of `listed` under tokens whose sets `links` don't connect."""
    roots = _roots(links)
    rooted = listed.select("key", "n", "at", "token").join(small(roots), listed["key"] == roots["node"], "left").select("key", "n", "at", "token", F.coalesce("root", "key").alias("root"))
    wide = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("df"))
    return kept(rooted.join(wide.filter("low <> high").select("token", "df"), "token"))


def _led(listed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(key, x): sets with a leader under one of their tokens that they may match; another leader each `turn`."""
    lead = listed.groupBy("token").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("by"), "key", "n", "at", "root")).alias("lead"))
    lead = kept(lead.select("token", F.col("lead.key").alias("x"), F.col("lead.n").alias("x_n"), F.col("lead.at").alias("x_at"), F.col("lead.root").alias("x_root")))
    return _sharing(listed.join(lead, "token").filter((F.col("root") != F.col("x_root")) & _may_match(similarity)), similarity)


def _common(n: Column, similarity: float) -> Column:
    """How many tokens similar sets share in their prefixes if the smaller set has `n`."""
    return F.least(F.floor(n * MORE) + 1, F.ceil(n * similarity - 1e-9))


def _sharing(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, x): the pairs of `rows` (key, n, x, x_n; one for each shared prefix token) that share enough of them."""
    shared = F.ceil((F.col("n") + F.col("x_n")) * (similarity / (1 + similarity)) - 1e-9)
    others = F.greatest(*(F.ceil(F.col(n) * similarity - 1e-9) - 1 for n in ("n", "x_n")))
    return rows.groupBy("key", "x", "n", "x_n").agg(F.count("*").alias("both")).filter(F.col("both") >= shared - others).select("key", "x")


def _suspects(sets: DataFrame) -> DataFrame:
    """(key, n, at, token): the prefix tokens that different `sets` (key, n, prefix) list."""
    listed = sets.select("key", "n", F.posexplode_outer("prefix").alias("at", "token")).filter("token is not null")
    shared = kept(listed.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("token"))
    return kept(maybe_in(listed, "token", shared).join(shared, "token").distinct())


def _narrowed(listed: DataFrame, similarity: float, rounds: int = NARROWED) -> DataFrame:
    """The rows of `listed` (key, n, at, token) whose sets share enough tokens of their prefixes with any others to be similar to one."""
    need = _common(F.ceil(F.col("n") * similarity - 1e-9), similarity)
    for _ in range(rounds):
        enough = listed.groupBy("key", "n").agg(F.count("*").alias("common")).filter(F.col("common") >= need).select("key")
        left = kept(listed.join(enough, "key"))
        shared = left.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
        before, listed = listed, kept(left.join(shared, "token").select("key", "n", "at", "token"))
        dropped(left, *([before] if hasattr(before, "kept_at") else []))
    return listed


def _by_number(listed: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, n, at, token): the prefixes of the sets of `listed`, with all their tokens ordered by how many of these sets hold them;
    without the tokens of a single set, which come first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ends, tokens, _ in token_sets(batch.column("text"), shingle):
                key = batch.column("key").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))], ["key", "n", "tokens"])

    whole = kept(_texts(docs, sets, listed.select("key")).select("key", "text").mapInArrow(work, "key long, n int, tokens array<long>"))
    every = whole.select("key", "n", F.explode_outer("tokens").alias("token"))
    shared = kept(every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    rows = maybe_in(every, "token", shared).join(shared, "token")
    own = Window.partitionBy("key")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
    rows = rows.withColumn("at", at.cast("int")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9))
    out = kept(rows.select("key", "n", "at", "token"))
    dropped(whole, shared)
    return out


def _texts(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text): a text of each set of `keys`, fetched from `docs` (id, text, h)."""
    keys = kept(keys.distinct())
    one = maybe_in(sets.select("key", "id", "h"), "key", keys).join(keys, "key").groupBy("key").agg(F.min(F.struct("id", "h")).alias("of"))
    one = kept(one.select("key", F.col("of.id").alias("of"), F.col("of.h").alias("of_h")))
    found = maybe_in(docs, "h", one.select(F.col("of_h").alias("h"))).join(one, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")))
    return found.select("key", "text").dropDuplicates(["key"])  # rows may repeat an id and its text


def links_by_fingerprint(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """(a, b): the similar pairs of keys of `sets` that the SimHash search brings together.

    Sets of one fingerprint are held against the first of them, and the firsts of fingerprints within `bits` bits against each
    other. What is similar but has no such link, through other sets either, is left to the exact join.
    """
    prints = kept(sets.filter("n > 0").select("fp", "key").distinct())
    first = kept(prints.groupBy("fp").agg(F.min("key").alias("x")))
    near = kept(simhash.links(first, bits))
    same = prints.join(first, "fp").filter("key <> x").select("key", "x")
    across = near.join(first.select(F.col("fp").alias("a"), F.col("x").alias("key")), "a").join(first.select(F.col("fp").alias("b"), "x"), "b").select("key", "x")
    found = _verified(same.unionByName(across), docs, sets, shingle, similarity)
    dropped(prints, first, near)
    return found


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """(a, b): links that join exactly the keys of `sets` connected by similar pairs; not all such pairs."""
    found = links_by_fingerprint(docs, sets, shingle, similarity, bits)
    listed = _by_number(_narrowed(_suspects(sets), similarity), docs, sets, shingle, similarity)
    for turn in range(rounds):
        listed = _open(listed, found)
        rows = listed if turn == 0 else listed.filter(F.col("df") > crowd)
        if rows.isEmpty():
            break
        found = found.unionByName(_verified(_led(rows, turn, similarity), docs, sets, shingle, similarity))
    listed = _open(listed, found)
    if listed.isEmpty():
        return found
    x = listed.select("token", *(F.col(c).alias(f"x_{c}") for c in ("n", "at", "root")), F.col("key").alias("x"))
    pairs = listed.join(x, "token").filter((F.col("x") < F.col("key")) & (F.col("root") != F.col("x_root")) & _may_match(similarity))
    return found.unionByName(_verified(_sharing(pairs, similarity), docs, sets, shingle, similarity))


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, how: dict) -> DataFrame:
    """(id, h, root, component): a hash of the text; the root names the component among token sets, the other among ids."""
    docs = picked(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    sets = kept(_sets(docs, shingle, similarity, word_levels(docs)))
    distinct = kept(sets.groupBy("key").agg(F.min("id").alias("least")))
    roots = _roots(links(docs, sets, shingle, similarity, **how))
    rooted = kept(distinct.join(roots, distinct["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_key = kept(rooted.join(least, "root").select("key", "root", "component"))
    return sets.select("id", "h", "key").join(by_key, "key").select("id", "h", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, **how) -> DataFrame:
    """(id, component): for every row of `docs` the smallest id that it is linked to.

    Rows with one id keep their own texts; a null id is never the smallest unless its component has no other; null and
    wordless texts are linked with each other; an empty table gives no rows.
    """
    return _linked(docs, id_col, text_col, shingle, similarity, how).select("id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, **how) -> DataFrame:
    """One row of `docs` for each near-duplicate component, as `simhash.least_of_each` chooses it; all columns stay.

    Texts that are in different components stay, whatever their ids.
    """
    return least_of_each(docs, _linked(docs, id_col, text_col, shingle, similarity, how).select("id", "h", "root"), id_col, text_col)
