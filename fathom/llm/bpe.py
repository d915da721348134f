"""Byte-level BPE encoding and decoding by a rank file, with overlapping chunks for long texts.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from where it begins; the pattern only
looks ahead, so once two neighbouring chunks agree on one pre-token boundary they agree on all that follow. Chunks are
stitched at the first such boundary, and the pieces between are merged by rank. Texts of more than one chunk are
dealt out chunk by chunk over the cluster and put together again by document; shorter ones are one chunk.
Decoding looks up each id's bytes and concatenates them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked

#: Characters of a chunk, and by how many it reaches into the next; both in code points.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces whose ids a task remembers before it starts anew.
REMEMBERED = 1 << 18
#: Rows whose ids are held at once.
ROWS = 256


class Codec(dict):
    """The ids of pieces as little-endian 32-bit bytes, worked out once: codec[piece] encodes a piece."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 256:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none, get = len(ranks), ranks.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at] = merged = parts[at] + parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + merged, none)
            if at < len(pairs):
                pairs[at] = get(merged + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same merges for long pieces, by a heap of pairs over a linked list."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, prev, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n

        def pair(i: int):
            j = end[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, upto = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != upto:
                continue
            alive[j] = False
            end[i] = upto
            if upto < n:
                prev[upto] = i
            for k in (prev[i], i):
                if k >= 0 and (s := pair(k)) is not None:
                    heapq.heappush(heap, (s, k, end[end[k]]))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.merged(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def boundaries(c: Codec, text: str, start: int) -> list[int]:
    """Where the pre-tokens of a chunk begin, and the end, in the whole text.

    A chunk's last pre-token may be cut short by the chunk's end, and "'r" of "'re" falls apart there, so the last two
    boundaries of a chunk that isn't the last are never trusted.
    """
    at = [m.start() + start for m in c.pattern.finditer(text)]
    return [*at, start + len(text)]


def _as_ids(c: Codec, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary())]


def _as_digests(c: Codec, ids: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(i) // 4 for i in ids], pa.int64()),
        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
        pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string()),
    ]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, made_of: Callable[[Codec, list[bytes]], list[pa.Array]] = _as_ids, columns: str = "ids binary") -> DataFrame:
    """(id, ids) for every row of `docs`: ids are little-endian unsigned 32-bit, the same that the whole text gives.

    Null and empty texts have no ids. Texts of more than `chunk` code points are encoded chunk by chunk on different
    tasks: each task encodes what its chunk surely owns and hands over the boundaries of its overlaps.
    In place of ids come the `columns` that `made_of` makes of them in the same Python worker; a step of its own would need a second worker for each task.
    """
    chosen, names = picked(docs, id_col, text_col), ["id", *(c.split()[0] for c in columns.split(", "))]
    kind = chosen.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in parts(batches):
            out = [c.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made_of(c, out)], names)

    size = F.length(F.coalesce("text", F.lit("")))
    whole = chosen.filter(size <= chunk).mapInArrow(short, f"id {kind}, {columns}")
    cuts = chosen.filter(size > chunk).select(
        "id", F.xxhash64("text").alias("h"), F.length("text").alias("n"),
        F.posexplode(F.expr(f"transform(sequence(0, length(text) - 1, {chunk}), s -> substring(text, s + 1, {chunk + overlap}))")).alias("k", "part"),
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk: the boundaries in the overlap at its head, those at its tail, and the ids of each stretch."""
        c = codec(path, pattern)
        for batch in batches:
            out = []
            for k, n, t in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), batch.column("part").to_pylist(), strict=True):
                at = boundaries(c, t, k * chunk)
                last = k * chunk + len(t) >= n
                head = at if last else at[:-2]
                pieces = [c[t[a - k * chunk : b - k * chunk]] for a, b in zip(at, at[1:], strict=False)]
                sizes = np.cumsum([0, *map(len, pieces)])
                # Boundaries that a neighbour may share, with the place of their ids.
                edge = [(b, int(sizes[i])) for i, b in enumerate(head) if k and b <= k * chunk + overlap or not last and b > (k + 1) * chunk]
                out.append((b"".join(pieces), [e[0] for e in edge], [e[1] for e in edge]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), batch.column("n"), batch.column("k"), batch.column("part"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                ["id", "h", "n", "k", "part", "ids", "at", "place"],
            )

    made = cuts.repartition(F.xxhash64("id", "h", "k")).mapInArrow(own, f"id {kind}, h long, n int, k int, part string, ids binary, at array<long>, place array<long>")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        rows = table.to_pylist()
        copies = sum(r["k"] == 0 for r in rows)  # equal rows under one id
        rows = rows[::copies]
        ids: bytes | None = b""
        begin = 0
        for r, after in zip(rows, [*rows[1:], None], strict=True):
            if after is None:
                ids += r["ids"][begin:]
                break
            theirs = dict(zip(after["at"], after["place"], strict=True))
            shared = next(((p, theirs[b]) for b, p in zip(r["at"], r["place"], strict=True) if b > after["k"] * chunk and b in theirs and p >= begin), None)
            if shared is None:
                text = rows[0]["part"]
                for x in rows[1:]:
                    text = text[: x["k"] * chunk] + x["part"]
                ids = codec(path, pattern).encode(text)
                break
            ids += r["ids"][begin : shared[0]]
            begin = shared[1]
        return pa.table([pa.array([rows[0]["id"]] * copies, table.schema.field("id").type), *made_of(codec(path, pattern), [ids] * copies)], names)

    return whole.unionByName(made.groupBy("id", "h").applyInArrow(join, f"id {kind}, {columns}"))


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, bytes): the raw bytes of every row's ids, concatenated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in parts(batches):
            yield batch.append_column("bytes", pa.array([c.decode(i.as_py()) for i in batch.column("ids")], pa.binary()))

    return tokens.mapInArrow(work, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tokens.schema)}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encodes, decodes and hashes."""
    return encoded(docs, path, pattern, id_col, text_col, chunk, overlap, _as_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
