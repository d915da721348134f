"""Document quality from lines: a linear-chain CRF labels every line good or bad.

A line's features are shares of letters, capitals, symbols, repeated words and the like, its own and its neighbours'.
The chain's forward and backward passes give each line's chance of being good; a document's score is a calibrated
length-weighted mean of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, picked
from .toxicity import held_out, logistic
from .vec import ALNUM, GRAPH, LOWER, byte_table, run_hashes, runs, slices

#: Labelled documents that the model is fitted on, at most: those of the smallest id hash.
FITTED_MOST = 5000
#: Lines of their documents, at most; each takes a few hundred bytes of the driver.
LINES_MOST = 200_000
STEPS, RATE, SHRINK = 120, 0.1, 1e-4

_UPPER, _DIGIT, _HIGH = byte_table((65, 90)), byte_table((48, 57)), byte_table((128, 255))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&<>@^~=+{}[]\\/_", np.uint8)] = True
_BAR, _BANG, _STOP = (byte_table((c, c)) for c in b"|!.")
#: Numbers of a line by itself.
OWN = 14


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that holds a word, its document's row, and its length in bytes."""
    starts, stops, row = runs(data != 10, ends)
    words, word_ends, _ = runs(GRAPH[data], ends)
    line = np.searchsorted(starts, words, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts)).astype(float)
    size = (stops - starts).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return (total[stops] - total[starts]) / np.maximum(size, 1)

    low = LOWER[data]
    hashes = run_hashes(low, words, word_ends)
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line)) if len(words) else np.zeros(0, np.int64)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    bare = np.bincount(line, weights=(word_ends - words == 1), minlength=len(starts))
    letters = share(byte_table((97, 122)) | _HIGH) + share(_UPPER)
    n = np.maximum(n_words, 1)
    x = np.stack([
        share(_SYMBOL), share(_BANG), share(_BAR), share(_STOP), share(_DIGIT), share(_UPPER) / np.maximum(letters, 1e-3), 1 - letters, share(~ALNUM),
        np.bincount(line, weights=same, minlength=len(starts)) / n, 1 - distinct / n, np.log1p(size) / 5, np.minimum(size / n, 30) / 10, bare / n, (n_words < 4).astype(float),
    ], axis=1)
    held = n_words > 0
    return x[held], row[held], size[held]


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A 1, a line's own features, and those of the lines before and after it in its document (0 where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([np.ones((len(x), 1)), x, before, after], axis=1)


class Chains:
    """Lines of documents as chains, stepped together: the k-th lines of all documents that have one."""

    def __init__(self, row: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(row)))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        self.steps = [first[: int(np.searchsorted(-sizes, -k))] + k for k in range(int(sizes[0]) if len(sizes) else 0)]

    def passes(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log sums of each line for the labels bad and good."""
        a, b = unary.copy(), np.zeros_like(unary)
        for before, at in zip(self.steps, self.steps[1:], strict=False):
            prev = a[before[: len(at)]]
            a[at] += np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
        for before, at in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            nxt = unary[at] + b[at]
            b[before[: len(at)]] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
        return a, b

    def marginals(self, unary: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The chance that each line is good."""
        a, b = self.passes(unary, move)
        z = a + b
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))

    def pair_sums(self, unary: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Expected counts of each pair of neighbouring labels."""
        a, b = self.passes(unary, move)
        out = np.zeros((2, 2))
        for before, at in zip(self.steps, self.steps[1:], strict=False):
            joint = a[before[: len(at)], :, None] + move + (unary[at] + b[at])[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            out += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    calibration: np.ndarray
    share: float  # of good documents, the score of one without lines

    def unary(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        good = with_neighbours((x - self.mean) / self.spread, row) @ self.weights
        return np.stack([np.zeros(len(x)), good], axis=1)

    def line_chances(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        return Chains(row).marginals(self.unary(x, row), self.move)

    def scores(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        chance = self.line_chances(x, row)
        weight = np.bincount(row, weights=size, minlength=rows)
        mean = np.bincount(row, weights=size * chance, minlength=rows) / np.maximum(weight, 1)
        return np.where(weight > 0, 1 / (1 + np.exp(-np.clip(_calibrated(mean) @ self.calibration, -30, 30))), self.share)


def _calibrated(mean: np.ndarray) -> np.ndarray:
    p = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)), p], axis=1)


def train(x: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray) -> Model:
    """Maximises the chains' conditional likelihood, each line labelled as its document, by Adam from zero."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    full, chains = with_neighbours((x - mean) / spread, row), Chains(row)
    y = label[row].astype(float)
    inside = row[1:] == row[:-1]
    seen = np.array([[np.sum(inside & (y[:-1] == i) & (y[1:] == j)) for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        unary = np.stack([np.zeros(len(y)), full @ w], axis=1)
        slope = np.concatenate([full.T @ (y - chains.marginals(unary, move)), (seen - chains.pair_sums(unary, move)).ravel()]) / max(len(y), 1) - SHRINK * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), np.zeros(3), float(label.mean()))
    chance = model.line_chances(x, row)
    weight = np.bincount(row, weights=size, minlength=len(label))
    doc = np.bincount(row, weights=size * chance, minlength=len(label)) / np.maximum(weight, 1)
    model.calibration = logistic(_calibrated(doc[weight > 0]), label[weight > 0].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = FITTED_MOST) -> Model:
    """Learns from the labelled rows of (id, text) and (id, quality): at most `most` labels by the id's hash, and of their
    documents, in that order, as many as have `LINES_MOST` lines together.

    Null texts and null ids say nothing; without labelled lines every score is 0.5.
    """
    labels = labels.filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    chosen = checkpointed(labels.orderBy(F.xxhash64("id"), "id").limit(most))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in slices(batch.column("text")):
                x, row, size = line_features(data, ends)
                at = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary()), pa.array([size[i:j].tolist() for i, j in zip(at, at[1:], strict=False)], pa.list_(pa.float64()))],
                    ["id", "y", "x", "size"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    sample = docs.join(F.broadcast(chosen), "id").select("id", "text", F.col("quality").cast("int").alias("quality"), F.xxhash64("id").alias("h"), F.xxhash64("text").alias("h2"), F.size(F.split("text", "\n")).alias("lines"))
    sample = checkpointed(sample.filter("text is not null").dropDuplicates(["id", "h2"]))
    total, cut = 0, None
    for r in sample.select("h", "h2", "lines").orderBy("h", "h2").limit(most).collect():
        total += r.lines
        if total > LINES_MOST:
            break
        cut = (r.h, r.h2)
    if cut:
        sample = sample.filter(F.struct("h", "h2") <= F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).alias("h2")))
    else:
        sample = sample.limit(0)
    rows = sample.mapInArrow(numbers, f"id {kind}, y int, x binary, size array<double>").toArrow().sort_by("id").to_pylist()
    rows = [r for r in rows if r["size"]]
    if not rows:
        return Model(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 1), np.zeros((2, 2)), np.zeros(3), 0.5)
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, OWN) for r in rows]).astype(float)
    size = np.concatenate([np.array(r["size"]) for r in rows])
    return train(x, np.repeat(np.arange(len(rows)), [len(r["size"]) for r in rows]), size, np.array([r["y"] for r in rows]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, n_lines, n_bad_lines) for every row of (id, text).

    A document without a word has the share of good documents for its score and no lines.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in slices(batch.column("text")):
                x, row, size = line_features(data, ends)
                bad = model.line_chances(x, row) < 0.5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(model.scores(x, row, size, b - a)), pa.array(np.bincount(row, minlength=b - a)), pa.array(np.bincount(row[bad], minlength=b - a))],
                    ["id", "score", "n_lines", "n_bad_lines"],
                )

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, score double, n_lines long, n_bad_lines long")


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    docs, out = picked(documents(spark, sf_dir)), held_out(fold=4, at=2)
    labels = documents(spark, sf_dir, "labels").filter(~out).select(F.col("doc_id").alias("id"), "quality")
    found = scored(docs, fit(docs, labels)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
