"""What several operators share: reliable checkpoints, document selection, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three longs that may be broadcast once counted: about 4 MB.
BROADCAST_ROWS = 1 << 17
#: Bits of a bitmap of hashes: it is broadcast, as 8 MB at most.
BITMAP = 1 << 26
#: Rows of a batch that goes to Python, where several operators share a session.
BATCH_ROWS = 1000
#: Spark's switch for deleting a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by all executors: the one set for checkpoints, which is
    ``spark.checkpoint.dir``. Only a local master gets a temporary folder of its own; a cluster without a setting is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fathom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder, its lineage cut."""
    scratch(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, and columns can be left out in reading.

    Its shuffle files go as soon as it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, cleanup = f"{scratch(spark)}/kept-{uuid.uuid4().hex}", spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, cleanup)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what `kept` wrote for these tables, once nothing is to read them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (already checkpointed, so counting is cheap) marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitmap(column: str, values: DataFrame) -> DataFrame:
    """A table of BITMAP bits that are set at the places of the hashes in `column` of `values`, for any number of calls of `maybe_in`."""
    place = F.pmod(column, F.lit(BITMAP))
    bits = values.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
    # As longs, which a probe reads one by one; of a binary it would copy all.
    made = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bytes"))
    longs = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("__bytes", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return kept(made.select("__bucket", longs.alias("__bitmap")))


def maybe_in(rows: DataFrame, column: str, values: DataFrame, others: bool = False) -> DataFrame:
    """Those of `rows` whose `column`, a hash, may be among that of `values`, or of a `bitmap` of them; with `others`, those that are surely not.

    A bitmap of fixed size is broadcast. What it lets through by chance, the more the fuller it is, is for an exact join after it.
    """
    bits = values if "__bitmap" in values.columns else bitmap(column, values)
    place = F.pmod(column, F.lit(BITMAP))
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__bucket"), "left" if others else "inner")
    bit = F.bitmap_bit_position(place).cast("int")
    word = F.get("__bitmap", F.shiftright(bit, 6))
    hit = F.coalesce(F.getbit(word, 56 - F.shiftright(bit, 3) % 8 * 8 + bit % 8) == 1, F.lit(False))
    return joined.filter(~hit if others else hit).select(rows.columns)


def small_batches(spark: SparkSession) -> None:
    """From now on batches of at most BATCH_ROWS rows go to the session's Python workers, which keep the memory of their largest batch."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, BATCH_ROWS)


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names that the operators use; other columns can't clash."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a minimum per node and a join,
    so no neighbourhood is ever gathered. The minima are checkpointed before the join, which leaves both of its
    sides to an exchange of their own, and adaptive execution can split a hub.
    """

    def stars(edges: DataFrame, both_ways: bool) -> DataFrame:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if both_ways:
            pairs = pairs.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = checkpointed(pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        moved = pairs.join(least, "x")
        if both_ways:
            moved = moved.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(F.col("x").alias("u"), F.col("m").alias("v"))
            )
        return moved.filter("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = mark(edges)
    for _ in range(rounds if seen[0] else 0):
        edges = checkpointed(stars(checkpointed(stars(edges, True)), False))
        if (now := mark(edges)) == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
