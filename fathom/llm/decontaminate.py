"""Benchmark decontamination with suffix arrays over the training words.

Every task takes its documents in shards of some megabytes and makes a suffix array of each shard: the word positions
sorted by the words that follow, to the depth of a window. Only suffixes whose opening words also open some benchmark
window are sorted; no other can hold a match. Every benchmark suffix is binary-searched in it; the two places around
the insertion point give its longest verbatim match, the range of equal prefixes gives all locations, and runs of
locations on one diagonal are the maximal matches. Words are compared by 64-bit hashes and each match by its bytes.

The benchmark is searched in blocks of a bounded number of items' bytes, each a broadcast of its own; documents are
read once and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked
from .vec import ALNUM, LOWER, mix, run_hashes, runs, slices

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20
#: Opening words by which suffixes are left out before sorting.
OPENING = 3


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, then start, end, row and hash of each word."""
    data = LOWER[data]
    starts, stops, row = runs(ALNUM[data], ends)
    return data, starts, stops, row, run_hashes(data, starts, stops)


def openings(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on (the last k - 1 are left out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n]
    for j in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


@dataclass
class Block:
    """Some benchmark items: their words one after the other, and the suffixes to search with."""

    ids: list
    words: list[list[bytes]]
    hashes: np.ndarray  # of all words
    first: np.ndarray  # word where each item begins, and the end
    suffixes: np.ndarray  # words where a window begins
    item: np.ndarray  # of each suffix
    need: np.ndarray  # words of its window
    keys: dict[int, np.ndarray]  # sorted openings of the windows by their length

    @classmethod
    def of(cls, items: list[tuple[object, str]], window: int) -> Block:
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        parts, words, counts = [], [], []
        for _, _, data, ends in slices(texts, 1 << 62):
            low, starts, stops, row, h = words_of(data, ends)
            raw = low.tobytes()
            parts.append(h)
            counts = np.bincount(row, minlength=len(items))
            flat = [raw[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
            at = np.concatenate(([0], np.cumsum(counts)))
            words = [flat[at[i] : at[i + 1]] for i in range(len(items))]
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        counts = np.asarray(counts, np.int64)
        first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        suffixes, item, need = [], [], []
        for i, n in enumerate(counts.tolist()):
            size = min(window, n)
            for o in range(n - size + 1 if n else 0):
                suffixes.append(first[i] + o)
                item.append(i)
                need.append(size)
        suffixes, need = np.array(suffixes, np.int64), np.array(need, np.int64)
        keys = {}
        for k in range(1, OPENING + 1):
            at = suffixes[need >= k] if k == OPENING else suffixes[need == k]
            if len(at):
                keys[k] = np.unique(openings(hashes, k)[at])
        return cls([i for i, _ in items], words, hashes, first, suffixes, np.array(item, np.int64), need, keys)


def _table(hashes: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The `depth` words from each place on (0 beyond its room) and how many there are."""
    held = np.minimum(room, depth)
    places = at[:, None] + np.arange(depth)
    inside = np.arange(depth) < held[:, None]
    return np.where(inside, hashes[np.minimum(places, len(hashes) - 1)], np.uint64(0)), held


def _less(a: np.ndarray, b: np.ndarray, upto: np.ndarray, or_equal: bool) -> np.ndarray:
    """Row by row whether a < b (or a <= b) in the order of their first `upto` words."""
    same = (a == b) | (np.arange(a.shape[1]) >= upto[:, None])
    where = same.argmin(axis=1)
    rows = np.arange(len(a))
    return np.where(same.all(axis=1), or_equal, a[rows, where] < b[rows, where])


def _search(table: np.ndarray, wanted: np.ndarray, upto: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each wanted row in the sorted table: the first place not before it, or after all equal."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(table), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = _less(table[np.minimum(mid, len(table) - 1)], wanted, upto, after)
        low = np.where(open_ & before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    return low


class Shard:
    """The words of some documents and the suffix array of those that may match a block."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.stops, self.row, self.hashes = words_of(data, ends)
        self.n_words = np.bincount(self.row, minlength=len(ends) - 1).astype(np.int64)
        self.close = np.cumsum(self.n_words)[self.row] if len(self.row) else self.row  # where each word's document ends
        self.room = self.close - np.arange(len(self.row))

    def matches(self, block: Block, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, its word, item, its word, words) of every maximal match that holds a window of the item."""
        may = np.zeros(len(self.hashes), bool)
        for k, keys in block.keys.items():
            found = openings(self.hashes, k)
            at = np.searchsorted(keys, found)
            may[: len(found)] |= (keys[np.minimum(at, len(keys) - 1)] == found) & (self.room[: len(found)] >= k)
        places = np.flatnonzero(may)
        if not len(places) or not len(block.suffixes):
            return
        table, _ = _table(self.hashes, places, self.room[places], window)
        order = np.lexsort(table.T[::-1])
        array, table = places[order], table[order]
        wanted, _ = _table(block.hashes, block.suffixes, block.need, window)
        low = _search(table, wanted, block.need, False)
        high = _search(table, wanted, block.need, True)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        size = (high - low)[hit]
        which = np.repeat(hit, size)
        place = array[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[hit], size)]
        fits = self.room[place] >= block.need[which]  # the zeros beyond a document's end match nothing
        which, place = which[fits], place[fits]
        offset, item = block.suffixes[which] - block.first[block.item[which]], block.item[which]
        order = np.lexsort((place, place - offset, self.row[place], item))
        which, place, offset, item = which[order], place[order], offset[order], item[order]
        need, row = block.need[which], self.row[place]
        new = np.ones(len(place), bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(new)])) - 1
        for b, e in zip(begin.tolist(), last.tolist(), strict=True):
            n = int(place[e] - place[b] + need[e])
            p, o, words = int(place[b]), int(offset[b]), block.words[int(item[b])]
            # Equal bytes are asked for, whatever the hashes say.
            if all(self.data[self.starts[p + j] : self.stops[p + j]].tobytes() == words[o + j] for j in range(n)):
                yield int(row[b]), p - int(self.close[p] - self.n_words[row[b]]), int(item[b]), o, n


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcasts of blocks; the driver holds one block at a time."""
    context, out, items, size = benchmark.sparkSession.sparkContext, [], [], 0
    for r in picked(benchmark, id_col, text_col).toLocalIterator():
        if items and size + len(r.text or "") > block_bytes:
            out.append(context.broadcast(Block.of(items, window)))
            items, size = [], 0
        items.append((r.id, r.text))
        size += len(r.text or "")
    if items:
        out.append(context.broadcast(Block.of(items, window)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: (id, n_words, hits), hits an array of (item, doc_word, item_word, words) structs,
    the maximal verbatim matches that hold a window of `window` item words (or the whole of a shorter item).

    A null or wordless text has no words and no hits; items without words match nothing; repeated rows and items
    are reported each; item ids are given as strings.
    """
    blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    chosen = picked(docs, id_col, text_col)
    kind = "array<struct<item:string,doc_word:long,item_word:long,words:long>>"
    arrow = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in slices(batch.column("text")):
                shard, hits = Shard(data, ends), [[] for _ in range(b - a)]
                for block in blocks:
                    for row, at, item, offset, n in shard.matches(block.value, window):
                        hits[row].append((None if block.value.ids[item] is None else str(block.value.ids[item]), at, offset, n))
                rows = [[dict(zip(("item", "doc_word", "item_word", "words"), h, strict=True)) for h in sorted(x, key=str)] for x in hits]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(shard.n_words), pa.array(rows, arrow)], ["id", "n_words", "hits"])

    return chosen.mapInArrow(work, f"id {chosen.schema['id'].dataType.simpleString()}, n_words long, hits {kind}")


def digests(found: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of the rows of `matches`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for hits in batch.column("hits").to_pylist():
                covered = last = 0
                for begin, end in sorted((h["doc_word"], h["doc_word"] + h["words"]) for h in hits):
                    covered += max(0, end - max(begin, last))
                    last = max(last, end)
                items = sorted({h["item"] for h in hits if h["item"] is not None})
                out["n_hit"].append(covered)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(out["n_hit"], pa.int64()), pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string())],
                ["id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(work, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` less those that hold a benchmark window; all columns stay, in one pass without a shuffle."""
    blocks = blocks_of(benchmark, "item_id", "text", window, BLOCK_BYTES)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, data, ends in slices(batch.column(at)):
                shard = Shard(data, ends)
                for block in blocks:
                    for hit in shard.matches(block.value, window):
                        clean[a + hit[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(work, docs.schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return digests(found).withColumnRenamed("id", "doc_id")
