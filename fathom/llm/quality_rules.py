"""Rule-based quality with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into `buckets`. Two multinomials are estimated over them: one of a trusted target, one
of the whole raw corpus. A document's score is the mean of ``log p_target(b) - log p_raw(b)`` over its n-grams, and it is
kept if the base rules pass and the score reaches a fixed threshold, so the decision is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, small

BUCKETS = 1 << 16
#: Mean log ratio that a kept document reaches.
THRESHOLD = -0.12
#: Pseudo-counts of each bucket.
SMOOTHING = 0.5
SPACE = r"[ \t-\r]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds words, their hashes and the buckets of words and neighbouring pairs to (id, text)."""
    return (
        docs.withColumn("words", _words(F.coalesce("text", F.lit(""))))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("pairs", F.zip_with(F.expr("slice(hashes, 1, greatest(size(hashes) - 1, 0))"), F.expr("slice(hashes, 2, greatest(size(hashes) - 1, 0))"), lambda a, b: F.xxhash64(a, b)))
    )


def _buckets(buckets: int) -> Column:
    return F.transform(F.concat("hashes", "pairs"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket, from all `docs` (id, text); `trusted` (id) marks the target documents among them.

    The result has `buckets` numbers whatever the corpus; without trusted documents all are 0.
    """
    marked = docs.join(small(checkpointed(trusted.select(F.col("id").alias("__t")).distinct())), F.col("id") == F.col("__t"), "left")
    counts = (
        _hashed(marked).select(F.explode(_buckets(buckets)).alias("b"), F.col("__t").isNotNull().cast("long").alias("t"))
        .groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).toArrow()
    )
    import numpy as np

    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = counts.column("b").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    if not target.sum():
        return [0.0] * buckets
    share = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * buckets))
    return (share(target) - share(raw)).tolist()


def quality(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) for every row.

    Null and empty texts have no words, fail the base rules and score 0; repeated rows are scored each.
    """
    text = F.coalesce("text", F.lit(""))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    n = F.size("windows")
    staged = (
        _hashed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        .withColumn("windows", F.transform(F.expr("slice(hashes, 1, greatest(size(hashes) - 2, 0))"), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))))
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
        # Windows with their places, sorted, only where some window comes twice.
        .withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < n, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("array()")))
        .withColumn("twice", F.sort_array(F.array_compact(F.transform("sorted", lambda x, i: F.when((x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]), x["i"])))))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("n_repeat_words", F.aggregate(F.transform("twice", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("twice", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("llr", F.aggregate(_buckets(len(weights)), F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size("hashes") + F.size("pairs"), F.lit(1)))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return staged.select(
        "id", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id): all documents labelled good."""
    return labels.filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = bucket_weights(docs.select(F.col("doc_id").alias("id"), "text"), trusted_ids(documents(spark, sf_dir, "labels")))
    return quality(docs, weights).withColumnRenamed("id", "doc_id")
