"""Token ids packed into rows of one length: best-fit decreasing with a segment tree over the rows' free room.

Documents are encoded, texts longer than a row are split losslessly into pieces of a row, and every task packs its
pieces in windows of a bounded number of tokens: longest first, each into the fullest row that still holds it.
A packed row carries its ids and positions as little-endian unsigned 16-bit matrices' rows, the cumulative lengths of
its segments, and which tokens of which document each segment holds. Nothing is shuffled for packing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, picked

#: Tokens of a row, tokens that a task packs at once, and the id of the padding (free in the vocabularies).
LENGTH, WINDOW_TOKENS, PAD = 2048, 1 << 22, 50256

SCHEMA = "pack_id long, n_tokens int, doc_ids array<{id}>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: ids by a rank file as little-endian unsigned 32-bit binary; null and empty texts have none."""
    chosen = picked(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = [np.array(encoding.encode_ordinary(t.as_py() or ""), "<u4").tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return chosen.mapInArrow(work, f"id {chosen.schema['id'].dataType.simpleString()}, ids binary")


@cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One for each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """How many rows have each amount of free room; a segment tree finds the least room of at least a size."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The room and number of the fullest row that holds `size`, taken out; None if there is none."""
        at = size + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: what follows is to the right of its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces, by number, of each row; every size is 1 to `length`."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if (found := rooms.take(sizes[piece])) is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        rooms.add(room - sizes[piece], row)
    return rows


def packed(tokens: DataFrame, length: int = LENGTH, window: int = WINDOW_TOKENS, pad: int = PAD) -> DataFrame:
    """Packed rows (see SCHEMA) of (id, ids): all tokens of all documents, each once.

    Documents without tokens are in no row; repeated rows are packed each; a null id stays null in `doc_ids`.
    `starts` has where in its document each segment begins.
    """
    if not (0 < length <= 1 << 16 and 0 <= pad < 1 << 16):
        raise ValueError("length and pad must fit into 16 bits")
    kind = tokens.schema["id"].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]

    def rows_of(pieces: list[tuple[object, int, np.ndarray]], first: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        made = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for a in range(0, len(made), 512):
            out: list[list] = [[] for _ in names]
            for k, row in enumerate(made[a : a + 512], a):
                held = [pieces[i] for i in row]
                sizes = [len(p[2]) for p in held]
                ids, places = np.full(length, pad, "<u2"), np.zeros(length, "<u2")
                ids[: sum(sizes)] = np.concatenate([p[2] for p in held])
                places[: sum(sizes)] = np.concatenate([np.arange(s) for s in sizes])
                for column, value in zip(out, (first + k, sum(sizes), [p[0] for p in held], [p[1] for p in held], [0, *np.cumsum(sizes).tolist()], ids.tobytes(), places.tobytes()), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        pieces, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column("id").type
            for doc, ids in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_py(), "<u4")
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("ids of more than 16 bits can't be packed into 16-bit rows")
                ids = ids.astype("<u2")
                pieces += [(doc, s, ids[s : s + length]) for s in range(0, len(ids), length)]
                held += len(ids)
                if held >= window:
                    for out in rows_of(pieces, number, id_type):
                        number += out.num_rows
                        yield out
                    pieces, held = [], 0
        if pieces:
            yield from rows_of(pieces, number, id_type)

    return tokens.select("id", "ids").mapInArrow(work, SCHEMA.format(id=kind))


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the segments of packed rows, ids as little-endian 16-bit binary."""
    x = rows.select(F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("k", "x"), "cu_seqlens", "ids")
    begin, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return x.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.starts").alias("start"), F.substring("ids", 2 * begin + 1, 2 * (end - begin)).alias("ids"))


def write_packed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = token_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed(tokens)
