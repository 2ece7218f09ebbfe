"""Word time series: anchored aggregation periods, full trajectories, time trees and inverted indexes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prior
from .windows import UNITS

#: Seconds of a period: of a word, and of the pseudo-word that stands for the classes.
WORD_PERIOD = 60
CLASS_PERIOD = 1
CLASS_WORD = "classLabel"

PERIODS = "word string, period_id long, t_first long, t_open long, t_close long, close_seq long, n0 double, n1 double"


def occurrences(counted: DataFrame) -> DataFrame:
    """(word, seq, s, n0, n1): tokens as counts of each class; s is the time in seconds."""
    return counted.select("word", "seq", F.unix_seconds("ts").alias("s"), *(F.when(F.col("label") == c, F.col("x")).otherwise(0.0).alias(f"n{c}") for c in (0, 1)))


def class_occurrences(stream: DataFrame) -> DataFrame:
    """The documents themselves as occurrences of the pseudo-word for the classes."""
    return occurrences(stream.select(F.lit(CLASS_WORD).alias("word"), "seq", "ts", "label", F.lit(1.0).alias("x")))


def _fold(limit: int):
    """Close a period with the first row later than ``limit`` seconds after its anchor; the row belongs to it and anchors the next.

    Rows come sorted by word and time. What is kept of a word from batch to batch is its open
    period, so a word may have any number of rows.
    """
    names = ["word", "period_id", "t_first", "t_open", "t_close", "close_seq", "n0", "n1"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.float64(), pa.float64()]

    def run(batches):
        key, number, first, anchor, n0, n1 = None, 0, 0, 0, 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column("word").dictionary_encode()
            code, names_of = word.indices.to_numpy(), word.dictionary.to_pylist()
            s, seq = b.column("s").to_numpy(), b.column("seq").to_numpy()
            c0, c1 = (np.r_[0.0, np.cumsum(b.column(c).to_numpy())] for c in ("n0", "n1"))
            edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            rows = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if (name := names_of[code[lo]]) != key:
                    key, number, first, anchor, n0, n1 = name, 0, int(s[lo]), int(s[lo]), 0.0, 0.0
                at = lo
                while s[hi - 1] > anchor + limit:
                    j = at + int(np.searchsorted(s[at:hi], anchor + limit, "right"))
                    if j >= hi:
                        break
                    rows.append((key, number, first, anchor, int(s[j]), int(seq[j]), n0 + c0[j + 1] - c0[at], n1 + c1[j + 1] - c1[at]))
                    number, anchor, at, n0, n1 = number + 1, int(s[j]), j + 1, 0.0, 0.0
                    if at >= hi:
                        break
                if at < hi:
                    n0, n1 = n0 + c0[hi] - c0[at], n1 + c1[hi] - c1[at]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def anchored(rows: DataFrame, period: int = WORD_PERIOD, unit: str = "second") -> DataFrame:
    """Closed periods of ``rows(word, seq, s, n0, n1)``: the whole units since the anchor exceed ``period``."""
    limit = (period + 1) * UNITS[unit] - 1
    sorted_ = rows.select("word", "seq", "s", "n0", "n1").repartition("word").sortWithinPartitions("word", "s", "seq")
    return sorted_.mapInArrow(_fold(limit), PERIODS)


def by_count(rows: DataFrame, size: int) -> DataFrame:
    """(word, period_id, close_seq, n0, n1): periods that close with more than ``size`` sightings of a word; open ones are left out."""
    at = prior(rows, ["word"], "seq", {"before": F.lit(1).cast("long")}).withColumn("period_id", F.floor(F.col("before") / (size + 1)))
    full = at.groupBy("word", "period_id").agg(F.count("*").alias("n"), F.max("seq").alias("close_seq"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return full.filter(F.col("n") > size).select("word", "period_id", "close_seq", "n0", "n1")


def cumulative(rows: DataFrame) -> DataFrame:
    """(word, seq, s, n0, n1, sum0, sum1): every sighting with the running counts of its word."""
    sums = prior(rows, ["word"], "seq", {"b0": F.col("n0"), "b1": F.col("n1")})
    return sums.select("word", "seq", "s", "n0", "n1", (F.col("b0") + F.col("n0")).alias("sum0"), (F.col("b1") + F.col("n1")).alias("sum1"))


def time_tree(counted: DataFrame, stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((s, word, n0, n1), (s, documents0, documents1, tokens0, tokens1)): what happened at every time."""
    rows = occurrences(counted)
    words = rows.groupBy("s", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    tokens = rows.groupBy("s").agg(F.sum("n0").alias("tokens0"), F.sum("n1").alias("tokens1"))
    docs = class_occurrences(stream).groupBy("s").agg(F.sum("n0").alias("documents0"), F.sum("n1").alias("documents1"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tokens0", "tokens1")]
    return words, docs.join(tokens, "s", "left").select("s", "documents0", "documents1", *zero)


def inverted_index(counted: DataFrame) -> DataFrame:
    """(word, times): the distinct times at which every word occurred, in order."""
    return counted.groupBy("word").agg(F.sort_array(F.collect_set(F.unix_seconds("ts"))).alias("times"))


def class_trajectory(stream: DataFrame, counted: DataFrame, stop: int, span: int) -> DataFrame:
    """One row (prior0, prior1, total0, total1): one more than the documents and tokens of each class in the ``span`` seconds up to ``stop``."""
    at = lambda df: between(df, stop - span, stop)
    plus = lambda c, name: (1.0 + F.coalesce(F.sum(c), F.lit(0.0))).alias(name)
    docs = at(class_occurrences(stream)).agg(plus("n0", "prior0"), plus("n1", "prior1"))
    return docs.crossJoin(at(occurrences(counted)).agg(plus("n0", "total0"), plus("n1", "total1")))


def between(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows whose time lies from ``start`` to ``stop``, both included."""
    return rows.filter(F.col("s").between(start, stop))


def tail(rows: DataFrame, stop: int, span: int) -> DataFrame:
    """The trajectory from ``span`` seconds before ``stop`` on; also what a trimmed one keeps."""
    return rows.filter(F.col("s") >= stop - span)


def or_zero(words: DataFrame, rows: DataFrame, stop: int) -> DataFrame:
    """Trajectories of ``words(word)``; one that has none gets a zero at ``stop``."""
    both = words.select("word").join(rows.select("word", "s", "n0", "n1"), "word", "left")
    return both.select("word", F.coalesce("s", F.lit(stop)).alias("s"), *(F.coalesce(f"n{c}", F.lit(0.0)).alias(f"n{c}") for c in (0, 1)))


def without_words(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the words of ``gone(word)``."""
    return rows.join(gone.select("word"), "word", "left_anti")
