"""Combining learners: votes (seq, label, learner, p0, p1) become one vote for each document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation as ev
from . import learners as ln
from .settle import settled
from .windows import SPANS

CHUNK = 2 * 3600
_EPSILON = 1e-9


def sliding_votes(stream: DataFrame, spans: Mapping[str, int] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Votes of plain learners over several sliding windows; without any, of the one that never forgets."""
    spans = {f"w{k}": s for k, s in enumerate(SPANS, 1)} if spans is None else spans
    each = ln.windowed_all(stream, list(spans.values()), counted) if spans else []
    out = [v.withColumn("learner", F.lit(name)) for name, v in zip(spans, each)] or [ln.vanilla(stream, counted).withColumn("learner", F.lit("all"))]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return settled(whole)


def _voted(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", F.when(F.col("p0") >= F.col("p1"), 0).otherwise(1))


def average(votes: DataFrame) -> DataFrame:
    """The mean vote of the learners."""
    return _voted(votes.groupBy("seq", "label").agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1")))


def weighted_average(votes: DataFrame) -> DataFrame:
    """The mean of votes with a ``weight``."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias(c)
    return _voted(votes.groupBy("seq", "label").agg(mean("p0"), mean("p1")))


def scaled_votes(votes: DataFrame) -> DataFrame:
    """Votes times their weight over one more than the number of learners, summed up, as shares of both classes: a weight may be next to infinite."""
    scale = lambda c: (F.sum(F.col(c) * F.col("weight")) / (F.count("*") + 1)).alias(f"_{c}")
    share = lambda c: F.coalesce(F.try_divide(F.col(f"_{c}"), F.col("_p0") + F.col("_p1")), F.lit(0.0)).alias(c)
    return _voted(votes.groupBy("seq", "label").agg(scale("p0"), scale("p1")).select("seq", "label", share("p0"), share("p1")))


def _chunked(votes: DataFrame, stream: DataFrame, seconds: int) -> DataFrame:
    timed = stream.select("seq", F.floor(F.unix_seconds("ts") / seconds).alias("chunk"))
    return votes.join(timed, "seq")


def g_mean_weights(votes: DataFrame, stream: DataFrame, seconds: int = CHUNK) -> DataFrame:
    """(chunk, learner, weight): exp(G-mean of the learner / G-mean of the shares of the classes) in every chunk of time."""
    counts = ev.confusion(_chunked(votes, stream, seconds), ["chunk", "learner"])
    n = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    full = lambda c: F.when(c == 0, 1.0).otherwise(c)
    chance = F.sqrt(full((F.col("tp") + F.col("fn")) / n) * full((F.col("tn") + F.col("fp")) / n))
    return counts.select("chunk", "learner", F.exp(ev.g_mean() / 100.0 / chance).alias("weight"))


def mse_weights(votes: DataFrame, stream: DataFrame, seconds: int = CHUNK) -> DataFrame:
    """(chunk, learner, weight): 1 / (squared error of chance + that of the learner) in every chunk of time; a vote of nothing errs by 1."""
    at = _chunked(votes, stream, seconds)
    p = F.when(F.col("label") == 0, F.col("p0")).otherwise(F.col("p1"))
    error = F.when(F.col("p0") + F.col("p1") > 0, F.pow(1 - p, 2.0)).otherwise(1.0)
    share = F.avg((F.col("label") == 0).cast("double"))
    sums = at.groupBy("chunk", "learner").agg(F.avg(error).alias("_i"), share.alias("_s"))
    chance = F.col("_s") * F.pow(1 - F.col("_s"), 2.0) + (1 - F.col("_s")) * F.pow(F.col("_s"), 2.0)
    return sums.select("chunk", "learner", (1 / (chance + F.col("_i") + _EPSILON)).alias("weight"))


def with_weights(votes: DataFrame, stream: DataFrame, weights: DataFrame, seconds: int = CHUNK) -> DataFrame:
    """Votes with their learner's weight from the last chunk before that has documents; 1 in the first."""
    w = Window.partitionBy("learner").orderBy("chunk")
    old = weights.withColumn("weight", F.coalesce(F.lag("weight").over(w), F.lit(1.0)))
    return _chunked(votes, stream, seconds).join(old, ["chunk", "learner"]).drop("chunk")


def normaliser(*values: Column, smoothing: float = 1.0) -> Column:
    """The sum over the classes of value + smoothing; NaN counts as 0."""
    return sum((F.nanvl(v, F.lit(0.0)) + smoothing for v in values), F.lit(0.0))
