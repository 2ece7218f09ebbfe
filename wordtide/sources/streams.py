"""Labelled document streams: (seq LONG, ts TIMESTAMP, label INT, text STRING)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Class codes of the known label vocabularies.
LABEL_CODES: dict[str, int] = {"4": 0, "0": 1, "spam": 0, "ham": 1, "legitimate": 1}


def encode_label(code: Column, codes: Mapping[str, int] = LABEL_CODES) -> Column:
    """A class code as 0 or 1; an unknown one is null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, v in codes.items():
        out = out.when(F.lower(F.trim(code.cast("string"))) == k, F.lit(v))
    return out


def epoch_seconds(date: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A date text as seconds since 1970; one that can't be parsed is 1."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(date, F.lit(pattern))), F.lit(1)).cast("double")


@dataclass(frozen=True)
class StreamConfig:
    """Where a stream comes from: a Spark source, and the columns of class, text, time and order."""

    format: str
    options: Mapping[str, str] = field(default_factory=dict)
    path: str | None = None
    schema: str | None = None
    label: str = "class"
    text: str = "text"
    time: str = "timestamp"
    time_format: str = "yyyy-MM-dd HH:mm:ss"
    order: str | None = None
    codes: Mapping[str, int] = field(default_factory=lambda: LABEL_CODES)
    limit: int | None = None
    offset: int = 0


def load_stream(spark: SparkSession, config: StreamConfig) -> DataFrame:
    """Read a stream through any Spark source (jdbc, parquet, csv, json, orc, text, ...).

    Without an order column rows are ordered by time, label and text. ``limit`` and
    ``offset`` take a slice of that order.
    """
    reader = spark.read.format(config.format).options(**config.options)
    if config.schema:
        reader = reader.schema(config.schema)
    raw = reader.load(config.path) if config.path else reader.load()
    time = F.col(config.time)
    ts = time.cast("timestamp") if dict(raw.dtypes)[config.time].startswith(("timestamp", "date")) else F.try_to_timestamp(time.cast("string"), F.lit(config.time_format))
    out = raw.select(*([F.col(config.order).cast("long").alias("seq")] if config.order else []), F.date_trunc("second", ts).alias("ts"), encode_label(F.col(config.label), config.codes).alias("label"), F.col(config.text).cast("string").alias("text"))
    keys = ["ts", "seq"] if config.order else ["ts", "label", "text"]
    if config.limit is not None or config.offset:
        out = out.orderBy(*keys).offset(config.offset)
        out = out.limit(config.limit) if config.limit is not None else out
    if not config.order:
        # sorted partitions are numbered one after the other
        out = out.orderBy(*keys).withColumn("seq", F.monotonically_increasing_id())
    return out.select("seq", "ts", "label", "text")


def labelled_stream(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """The labelled documents, timed by the event with the same number."""
    return _labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, label)


def live_stream(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """The same as a stream: documents as they are added, with the labels and times that the tables have then."""
    path = f"{sf_dir}/documents.parquet"
    # as a pattern, which may name a file as well as a folder
    return _labelled(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"), sf_dir, label)


def _labelled(documents: DataFrame, sf_dir: str, label: str) -> DataFrame:
    read = lambda name: documents.sparkSession.read.parquet(f"{sf_dir}/{name}.parquet")
    d = documents.select(F.col("doc_id").alias("seq"), "text")
    chosen = read("labels").select(F.col("doc_id").alias("seq"), F.col(label).cast("int").alias("label"))
    timed = read("events").select(F.col("event_id").alias("seq"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return d.join(chosen, "seq").join(timed, "seq").select("seq", "ts", "label", "text")


def random_order(df: DataFrame, key: str, seed: int, to: str = "position") -> DataFrame:
    """``df`` with the place of each row in a repeatable random order, by a hash of its key."""
    h = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    h = h.withColumn("_p", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    from pyspark.sql import Window

    # 65536 parts, ranked side by side; the table of their sizes is small
    h = h.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h")))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = h.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n"))
    return h.join(F.broadcast(parts), "_p").withColumn(to, F.col("_n") + F.col("_r")).drop("_h", "_p", "_r", "_n")


def replaced(stream: DataFrame, update: DataFrame | None) -> DataFrame:
    """The stream that training goes on with: the update if there is one, else the stream."""
    return stream if update is None else update.select(stream.columns)
