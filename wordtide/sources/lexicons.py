"""Readers of lexicon files. The files are small; their lines are numbered in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, from 0, without line ends."""
    whole = spark.read.text(path, wholetext=True)
    cut = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return cut.filter("value <> ''")


def keys(spark: SparkSession, path: str) -> DataFrame:
    """(key): every line is a key."""
    return lines(spark, path).select(F.col("value").alias("key")).distinct()


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines ``key::value``; values that begin with a space are skipped, the last one of a key stays."""
    at = F.split("value", "::", 2)
    pairs = lines(spark, path).filter(F.size(at) == 2).select("line", at[0].alias("key"), at[1].alias("value")).filter("value NOT LIKE ' %'")
    return pairs.groupBy("key").agg(F.max_by("value", "line").alias("value"))


def opposites(spark: SparkSession, path: str) -> DataFrame:
    """(word, opposite) in both directions of a file whose lines are opposites in turn."""
    from pyspark.sql import Window

    rows = lines(spark, path).withColumn("n", F.row_number().over(Window.orderBy("line")) - 1).withColumn("pair", F.floor(F.col("n") / 2))
    pairs = rows.groupBy("pair").agg(F.min_by("value", "n").alias("a"), F.max_by("value", "n").alias("b"), F.count("*").alias("k")).filter("k = 2")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("opposite")).union(pairs.select("b", "a"))
    return both.dropDuplicates(["word"])


def word_sentiment(spark: SparkSession, path: str, averaged: bool = False) -> DataFrame:
    """(word, line, pos, neg) of a tab-separated file; an averaged one has a column more before the counts."""
    cells = F.filter(F.split("value", "\t"), lambda c: c != "")
    at = 4 if averaged else 3
    number = lambda k: F.get(cells, k).try_cast("double")
    return lines(spark, path).select(F.get(cells, 0).alias("word"), "line", number(at).alias("pos"), number(at + 1).alias("neg")).filter("pos IS NOT NULL AND neg IS NOT NULL")


def document_scores(spark: SparkSession, path: str, unused: Sequence[str] = ()) -> DataFrame:
    """(idx, pos_tag, word, pos, neg) of lines ``idx,TAG<tab>word<tab>pos<tab>neg``; the first of a document and word stays, unused words are left out."""
    cells = F.split("value", "\t")
    head = F.split(F.get(cells, 0), ",")
    rows = lines(spark, path).select("line", F.get(head, 0).try_cast("long").alias("idx"), F.get(head, 1).alias("pos_tag"), F.get(cells, 1).alias("word"), F.get(cells, 2).try_cast("double").alias("pos"), F.get(cells, 3).try_cast("double").alias("neg"))
    rows = rows.filter("word IS NOT NULL AND pos IS NOT NULL AND neg IS NOT NULL")
    if unused:
        rows = rows.filter(~F.col("word").isin(*unused))
    first = F.min_by(F.struct("pos_tag", "pos", "neg"), "line").alias("r")
    return rows.groupBy("idx", "word").agg(first).select("idx", "r.pos_tag", "word", "r.pos", "r.neg")


def entities(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """(word) from a list, or from the first field of the lines of a tab-separated file, in lower case."""
    if isinstance(source, str):
        rows = lines(spark, source).select(F.get(F.split("value", "\t"), 0).alias("word"))
    else:
        rows = spark.createDataFrame([(w,) for w in source], "word string")
    return rows.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()
