"""Result tables as files: daily reports, votes for significance tests, learners, forecasts, class counts, logs."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "MM/dd/yyyy"


def dated(day: Column) -> Column:
    return F.date_format(day, DATE)


def daily_performance(daily: DataFrame) -> DataFrame:
    return daily.orderBy("day").withColumn("day", dated(F.col("day")))


def elapsed(seconds: float) -> str:
    """A span of time as hours, minutes and seconds."""
    whole = int(seconds)
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


def write(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists", by: str | None = None, **options) -> None:
    """Write a report; a folder that exists is an error unless ``mode`` says otherwise.

    Formats are those of Spark (csv, parquet, orc, json, text, jdbc); csv has a header.
    """
    out = df.write.mode(mode).format(format).options(**({"header": "true"} if format == "csv" else {}), **options)
    if by:
        out = out.partitionBy(by)
    if format == "jdbc":
        out.save()
    else:
        out.save(path)


def write_all(reports: Mapping[str, DataFrame], folder: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """One folder for each report; forecasts of tracked words are cut by word."""
    for name, df in reports.items():
        write(df, f"{folder}/{name}", format, mode, "word" if name == "forecasts" else None)


class RunLog:
    """Messages of a run with their times, as a table."""

    def __init__(self):
        self.began, self.rows = time.time(), []

    def add(self, step: str, message: str = "") -> None:
        now = time.time()
        self.rows.append((len(self.rows), step, message, now - self.began, elapsed(now - self.began)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "n int, step string, message string, seconds double, elapsed string")
