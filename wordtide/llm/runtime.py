"""What the training-data operators share: the shared folder, and joins against id lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: An Arrow batch for Python ends with the row that takes it to so many bytes.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless it has a lower limit.

    By rows alone 10,000 texts are a batch, tens of megabytes. The executor's direct buffers double as one is
    written, a worker holds it too, and neither gives all of it back: a long session adds up its stages' peaks.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (a local test session) a temporary folder
    becomes the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wordtide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wordtide-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: its lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handed_over(df: DataFrame, base: str) -> DataFrame:
    """``df`` written beside the working folder ``base``, which goes with all that it holds: only the result stays."""
    out = stored(df, f"{base}-result")
    forget(df.sparkSession, base)
    return out


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` wrote."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its known row count makes it small enough."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def cast_ids(docs: DataFrame) -> DataFrame:
    """Only (doc_id LONG, text STRING) of a documents table, without null ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone(doc_id)``; all columns stay."""
    name = fresh(docs, "_gone")
    ids = gone.select(F.col("doc_id").alias(name))
    return docs.join(ids, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(spark: SparkSession, edges: DataFrame, path: str | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root), root the smallest node, written to ``path``.

    Alternating star contraction (Kiveris et al. 2014): every round is two
    grouped minima; the number of rounds grows with the logarithm of the
    component size. Nodes without an edge don't appear.
    """
    base = shared_dir(spark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            out = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
            out = e.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return out.filter("a <> b").distinct()

    def measure(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{base}/0")
    seen, n = measure(now), 0
    while True:
        n += 1
        now = stored(star(star(now, True), False), f"{base}/{n}")
        forget(spark, f"{base}/{n - 1}")
        if (new := measure(now)) == seen:
            out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")), path or f"{base}-result")
            forget(spark, base)
            return out
        seen = new
