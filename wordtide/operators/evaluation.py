"""Measures of votes: confusion counts, windowed accuracy and kappa, daily reports, diversity of learners.

The positive class is 0. Votes are (seq, label, p0, p1, pred), those of several learners also
have (learner). A measure that is undefined has the value given with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import ordinal, prior
from .settle import settled
from .windows import UNITS, day_batches

WINDOW = 1000
BATCH = 50
DIVERSITY_BATCH = 100
#: Fading factors of the estimators; each reads what the one before it gives.
FACTORS = (0.9, 0.1)

CELLS = {"tp": (0, 0), "fn": (0, 1), "tn": (1, 1), "fp": (1, 0)}


def cell(name: str) -> Column:
    label, pred = CELLS[name]
    return F.when((F.col("label") == label) & (F.col("pred") == pred), 1).otherwise(0)


def confusion(votes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fn, tn, fp of each group."""
    return votes.groupBy(*by).agg(*(F.coalesce(F.sum(cell(k)), F.lit(0)).cast("long").alias(k) for k in CELLS))


def _ratio(top: Column, below: Column, undefined: float) -> Column:
    return F.coalesce(F.try_divide(top * 100.0, below), F.lit(undefined))


def accuracy() -> Column:
    return _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), 0.0)


def recall(undefined: float = 0.0) -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"), undefined)


def specificity(undefined: float = 0.0) -> Column:
    return _ratio(F.col("tn"), F.col("tn") + F.col("fp"), undefined)


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)


def f1() -> Column:
    p, r = precision(), recall()
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(1e-5))


def g_mean() -> Column:
    """Geometric mean of recall and specificity; one of them that is 0 counts as 100."""
    full = lambda c: F.when(c == 0, 100.0).otherwise(c)
    return F.sqrt(full(recall(100.0)) * full(specificity(100.0)))


def kappa() -> Column:
    """Cohen's kappa in percent; undefined and negative ones are 0."""
    n = (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).cast("double")
    seen = F.try_divide(F.col("tp") + F.col("tn"), n)
    chance = F.try_divide((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")), n * n)
    return normalised(F.try_divide(seen - chance, 1 - chance))


def normalised(k: Column) -> Column:
    return F.greatest(F.coalesce(F.nanvl(k, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * 100.0


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, recall, specificity, precision, F1, G-mean and kappa, in percent, of confusion counts."""
    return counts.withColumns({"accuracy": accuracy(), "recall": recall(), "specificity": specificity(), "precision": precision(), "f1": f1(), "g_mean": g_mean(), "kappa": kappa()})


def running_totals(votes: DataFrame) -> DataFrame:
    """(seq, n0, n1): documents of each class so far, the document's own included."""
    own = lambda c: (F.col("label") == c).cast("long")
    counted = prior(votes.select("seq", "label"), [], "seq", {"b0": own(0), "b1": own(1)})
    return counted.select("seq", (F.col("b0") + own(0)).alias("n0"), (F.col("b1") + own(1)).alias("n1"))


def windowed(votes: DataFrame, width: int = WINDOW) -> DataFrame:
    """(seq, pos, accuracy, kappa) over the last ``width`` votes: the difference of two prefix sums."""
    at = settled(ordinal(votes.select("seq", "label", "pred"), "seq", "pos"))
    sums = prior(at, [], "pos", {f"c_{k}": cell(k).cast("long") for k in CELLS}).withColumns({f"c_{k}": F.col(f"c_{k}") + cell(k) for k in CELLS})
    old = sums.select((F.col("pos") + width).alias("pos"), *(F.col(f"c_{k}").alias(f"o_{k}") for k in CELLS))
    both = sums.join(old, "pos", "left")
    both = both.select("seq", "pos", *((F.col(f"c_{k}") - F.coalesce(F.col(f"o_{k}"), F.lit(0))).alias(k) for k in CELLS))
    return both.select("seq", "pos", accuracy().alias("accuracy"), kappa().alias("kappa"))


def _reach(factor: float) -> int:
    """After how many rows a fading factor has forgotten all that a double can hold."""
    from math import ceil, log

    return ceil(log(1e-18) / log(factor))


def faded(df: DataFrame, position: str, x: str, factor: float, to: str) -> DataFrame:
    """``df`` with the mean of ``x`` so far, each older row weighing ``factor`` times the next.

    Rows meet in blocks of positions together with the rows before the block that still weigh.
    """
    reach = _reach(factor)
    block = max(reach, min(4096, int(250 / -_log10(factor)) - reach))
    home = F.floor((F.col(position) - 1) / block)
    spread = df.withColumn("_copy", F.explode(F.when((F.col(position) - 1) % block >= block - reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("_block", home + F.col("_copy"))
    w = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(factor), F.col("_block") * block - F.col(position).cast("double"))
    return spread.withColumn(to, F.sum(F.col(x) * weight).over(w) / F.sum(weight).over(w)).filter("_copy = 0").drop("_copy", "_block")


def _log10(x: float) -> float:
    from math import log10

    return log10(x)


def fading_estimates(measured: DataFrame, factors: Sequence[float] = FACTORS) -> DataFrame:
    """(seq, pos, accuracy, kappa) with faded means fade<k>_accuracy and fade<k>_kappa, each of the one before."""
    out = settled(measured)
    for c in ("accuracy", "kappa"):
        of = c
        for k, factor in enumerate(factors, 1):
            out = faded(out, "pos", of, factor, f"fade{k}_{c}")
            of = f"fade{k}_{c}"
    return out


def daily(measured: DataFrame, stream: DataFrame, values: Sequence[str] = ("accuracy", "kappa"), by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of ``values`` on each calendar day."""
    timed = measured.join(stream.select("seq", F.col("ts").cast("date").alias("day")), "seq")
    return timed.groupBy("day", *by).agg(F.count("*").alias("n"), *(f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))))


def anchored_daily(measured: DataFrame, stream: DataFrame, values: Sequence[str] = ("accuracy", "kappa")) -> DataFrame:
    """Mean and standard deviation of ``values`` in batches of a day that begin with a document.

    Documents and batches meet by the calendar days that a batch touches: no more than two batches touch one.
    """
    day = UNITS["day"]
    batches = settled(day_batches(stream))
    last = F.floor((F.coalesce("stop", F.col("start") + day) - 1) / day)
    open_ = stream.agg(F.unix_seconds(F.max("ts")).alias("_end"))
    batches = batches.crossJoin(F.broadcast(open_)).withColumn("_last", F.when(F.col("stop").isNull(), F.floor(F.col("_end") / day)).otherwise(last))
    batches = batches.select("start", "stop", F.explode(F.sequence(F.floor(F.col("start") / day), F.col("_last"))).alias("_day"))
    timed = measured.join(stream.select("seq", F.unix_seconds("ts").alias("_s"), F.floor(F.unix_seconds("ts") / day).alias("_day")), "seq")
    inside = timed.join(batches, "_day").filter((F.col("_s") >= F.col("start")) & (F.col("stop").isNull() | (F.col("_s") < F.col("stop"))))
    return inside.groupBy("start").agg(F.count("*").alias("n"), *(f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))))


def count_batches(votes: DataFrame, size: int = BATCH) -> DataFrame:
    """Measures of each batch of ``size`` votes in a row."""
    at = ordinal(votes.select("seq", "label", "pred"), "seq", "pos").withColumn("batch", F.floor((F.col("pos") - 1) / size))
    return metrics(confusion(at, ["batch"]))


def significance(votes: DataFrame) -> DataFrame:
    """(num, predicted, correct) of every vote, numbered in order: input of significance tests."""
    at = ordinal(votes, "seq", "num")
    return at.select("num", F.col("pred").alias("predicted"), (F.col("pred") == F.col("label")).cast("int").alias("correct"))


def misclassified(votes: DataFrame) -> DataFrame:
    return votes.filter(F.col("pred") != F.col("label"))


def pairwise(votes: DataFrame, batch: int = DIVERSITY_BATCH) -> DataFrame:
    """(batch, learner_i, learner_j, theta1, theta2, kappa): how far two learners agree on each batch of documents.

    theta1 is the share of documents on which they agree, theta2 the share by chance.
    """
    docs = ordinal(votes.select("seq").distinct(), "seq", "pos").withColumn("batch", F.floor((F.col("pos") - 1) / batch)).select("seq", "batch")
    v = votes.select("seq", "learner", "pred")
    i, j = (v.select("seq", F.col("learner").alias(f"learner_{k}"), F.col("pred").alias(f"pred_{k}")) for k in "ij")
    both = i.join(j, "seq").filter("learner_i < learner_j").join(docs, "seq")
    share = lambda c: F.avg(c.cast("double"))
    a, b = F.col("pred_i") == 0, F.col("pred_j") == 0
    out = both.groupBy("batch", "learner_i", "learner_j").agg(share(a == b).alias("theta1"), share(a).alias("_a"), share(b).alias("_b"))
    out = out.withColumn("theta2", F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))).drop("_a", "_b")
    return out.withColumn("kappa", F.coalesce(F.try_divide(F.col("theta1") - F.col("theta2"), 1 - F.col("theta2")), F.lit(0.0)))


def by_learner(votes: DataFrame, stream: DataFrame) -> DataFrame:
    """(day, learner, n, mean_correct, std_correct): accuracy of every learner on each day."""
    right = votes.withColumn("correct", F.when(F.col("pred") == F.col("label"), 100.0).otherwise(0.0))
    return daily(right.select("seq", "learner", "correct"), stream, ["correct"], ["learner"])
