"""Language identification by nearest centroid: TF-IDF byte n-grams, several clustered centroids a language, cosine.

Letters' bytes are kept (A-Z lower-cased, anything else ASCII is a space), n-grams of two and three bytes are hashed into
`DIMENSIONS`, weighted by inverse document frequency over all training documents, and normalised. The centroids of each
language come from spherical k-means. A document goes to the language of the closest centroid; one farther from all
centroids than `REJECT` is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, picked
from .toxicity import held_out
from .vec import LOWER, slices

DIMENSIONS = 4096
#: Training rows that the centroids are fitted on, about, in all; document frequencies take every training row.
FITTED_ROWS = 2400
CLUSTERS = 4
#: Languages that are learned: those of most training rows.
LANGS_MOST = 256
#: Texts whose dense counts are held at once: some 8 MB.
ROWS = 256
#: Least cosine with some centroid of a document that isn't rejected.
REJECT = 0.15

_KEPT = LOWER.copy()
_KEPT[:128] = np.where(np.isin(np.arange(128), np.r_[65:91, 97:123]), LOWER[:128], 32)


def ngram_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; n-grams of nothing but spaces don't count."""
    rows = len(ends) - 1
    b = _KEPT[data].astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(ends))
    out = np.zeros(rows * DIMENSIONS)
    code, solid = b, b != 32
    for n in (2, 3):
        if len(b) < n:
            break
        code = code[:-1] * 257 + b[n - 1 :]
        solid = solid[:-1] | (b[n - 1 :] != 32)
        at = np.flatnonzero(solid & (row[: len(code)] == row[n - 1 :]))
        place = (code[at] * 0x9E3779B1 >> 15) % DIMENSIONS
        out += np.bincount(row[at] * DIMENSIONS + place, minlength=rows * DIMENSIONS)
    return out.reshape(rows, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Unit centroids by spherical k-means; the first is the row closest to the mean, each next the row farthest away."""
    k = min(k, len(x))
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < k:
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid


def fit(rows: DataFrame, fitted_rows: int = FITTED_ROWS, clusters: int = CLUSTERS) -> Model:
    """Learns from (id, text, lang); rows without a text or language say nothing, and rows that repeat all three count once.

    About `fitted_rows` texts are fitted on, at least 20 for each of at most `LANGS_MOST` languages, by the hash of id and text.
    """
    rows = rows.filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for a, b, data, ends in slices(batch.column("text"), most_rows=ROWS):
                total += (ngram_counts(data, ends) > 0).sum(axis=0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([n], total)))], ["k", "n"])

    found = rows.select("text").mapInArrow(frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(DIMENSIONS + 1)
    seen[found.column("k").to_numpy() + 1] = found.column("n").to_numpy()
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS_MOST).collect()
    if not sizes:
        return Model(idf, np.zeros((0, DIMENSIONS)), [])
    each = max(20, fitted_rows // len(sizes))
    share = rows.sparkSession.createDataFrame([(r.lang, r["count"]) for r in sizes], "lang string, n long")
    sample = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.col("n")) < each)
    sample = sample.select("text", "lang", F.xxhash64("id", "text").alias("h")).dropDuplicates(["lang", "h"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in slices(batch.column("text"), most_rows=ROWS):
                x = vectors(ngram_counts(data, ends), idf).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    table = sample.mapInArrow(made, "lang string, x binary").toArrow()
    x = np.stack([np.frombuffer(v, np.float32) for v in table.column("x").to_pylist()]).astype(float)
    order = np.array(sorted(range(len(x)), key=lambda i: x[i].tobytes()))
    x, lang = x[order], np.array(table.column("lang").to_pylist(), object)[order]
    groups = {v: clustered(x[lang == v], clusters) for v in sorted(set(lang.tolist()))}
    return Model(idf, np.concatenate(list(groups.values())), [v for v, c in groups.items() for _ in range(len(c))])


def identified(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(id, lang_pred, score, rejected) of every row of (id, text): the closest centroid's language and the cosine.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is all if nothing was learned.
    A text of letters always gets a learned language; `rejected` says that it is farther than `reject` from each.
    """
    docs = docs.select("id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column("text").is_null())
            for a, b, data, ends in slices(batch.column("text"), most_rows=ROWS):
                if not model.langs:
                    lang, score = ["und"] * (b - a), np.zeros(b - a)
                else:
                    cosine = vectors(ngram_counts(data, ends), model.idf) @ model.centroids.T
                    lang = [model.langs[k] for k in cosine.argmax(axis=1)]
                    score = np.clip(cosine.max(axis=1), 0, 1)
                out = none[a:b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(["und" if o else v for o, v in zip(out, lang, strict=True)], pa.string()), pa.array(np.where(out, 0.0, score)), pa.array(out | (score < reject))],
                    ["id", "lang_pred", "score", "rejected"],
                )

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(fold=3, at=1)
    learned = docs.filter(~out).select(F.col("doc_id").alias("id"), "text", "lang")
    found = identified(picked(docs), fit(learned)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
