"""Forecasts of word counts: simple experts, and their combination by multiplicative weights.

Experts forecast the counts of each class in a word's next period from its closed ones (PERIODS of
``trajectories``). What they say after a period holds until the next one closes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import trajectories as tj
from .prefix import prior
from .settle import settled

CLASSES = (0, 1)
EXPERTS = ("poisson", "seasonal", "arima", "ewma")
#: Forecasts are capped; the loss is divided by 2 * CAP ** 2 in the exponent of a weight.
CAP = 5.0
WEEKS = 2
SEASONAL = 0.9
EWMA = {"alpha": 0.1, "span": 22}
ARIMA_SPAN = 100
WEEK = 604_800
#: Width of a block of periods; those of a block and the ones just before it meet in a task.
BLOCK = 4096


def recent(df: DataFrame, by: Sequence[str], index: str, span: int, values: dict[str, Column]) -> DataFrame:
    """``df`` with arrays of the last ``span`` values, a row's own last; ``index`` is a dense number."""
    from pyspark.sql import Window

    home = F.floor(F.col(index) / BLOCK)
    copies = F.when(F.col(index) % BLOCK > BLOCK - span, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.withColumns({f"_v_{k}": v for k, v in values.items()}).withColumn("_copy", F.explode(copies)).withColumn("_block", home + F.col("_copy"))
    w = Window.partitionBy(*by, "_block").orderBy(index).rowsBetween(1 - span, 0)
    return spread.withColumns({k: F.collect_list(f"_v_{k}").over(w) for k in values}).filter("_copy = 0").drop("_copy", "_block", *(f"_v_{k}" for k in values))


def poisson(periods: DataFrame) -> DataFrame:
    """poisson_0, poisson_1: the mean of all closed periods."""
    before = prior(periods, ["word"], "period_id", {f"_p{c}": F.col(f"n{c}") for c in CLASSES})
    return before.withColumns({f"poisson_{c}": (F.col(f"_p{c}") + F.col(f"n{c}")) / (F.col("period_id") + 1) for c in CLASSES}).drop("_p0", "_p1")


def seasonal(periods: DataFrame, alpha: float = SEASONAL) -> DataFrame:
    """seasonal_0, seasonal_1: means of the word's current week and the one before, weighed by age.

    Weeks are counted from the word's first occurrence; one without a period has the mean 0.
    """
    p = periods.withColumn("_week", F.floor((F.col("t_close") - F.col("t_first")) / WEEK))
    sums = {"_k": F.lit(1.0)} | {f"_s{c}": F.col(f"n{c}") for c in CLASSES}
    inside = prior(p, ["word", "_week"], "period_id", sums)
    old = p.groupBy("word", "_week").agg(*(F.avg(f"n{c}").alias(f"_o{c}") for c in CLASSES)).withColumn("_week", F.col("_week") + 1)
    both = inside.join(old, ["word", "_week"], "left")
    below = sum(alpha * alpha**i for i in range(WEEKS))
    value = lambda c: (alpha * (F.col(f"_s{c}") + F.col(f"n{c}")) / (F.col("_k") + 1) + alpha * (1 - alpha) * F.coalesce(f"_o{c}", F.lit(0.0))) / below
    return both.withColumns({f"seasonal_{c}": value(c) for c in CLASSES}).drop("_week", "_k", *(f"_{k}{c}" for k in "so" for c in CLASSES))


def ewma_of(series: Column, alpha: float = EWMA["alpha"]) -> Column:
    """The exponentially weighted average of an array, the newest last, over the norm of its length."""
    top = F.aggregate(series, F.lit(0.0), lambda s, x: alpha * s + (1 - alpha) * x)
    return top / ((1 - F.pow(F.lit(1 - alpha), F.size(series))) / (1 - alpha))


def ewma(periods: DataFrame, alpha: float = EWMA["alpha"], span: int = EWMA["span"]) -> DataFrame:
    """ewma_0, ewma_1 over the last ``span`` periods."""
    kept = recent(periods, ["word"], "period_id", span, {f"_e{c}": F.col(f"n{c}") for c in CLASSES})
    return kept.withColumns({f"ewma_{c}": ewma_of(F.col(f"_e{c}"), alpha) for c in CLASSES}).drop("_e0", "_e1")


def arima_fit(d: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One-step forecasts of ARIMA(1,1,1) by conditional least squares.

    ``d`` has a row of differences for each series, padded with zeros on the left, ``last`` the
    newest values. All series are fitted at once: a grid of coefficients, refined around the best.
    """
    n, m = d.shape
    best = np.full(n, np.inf)
    phi, theta, out = np.zeros(n), np.zeros(n), last.copy()
    steps = np.ascontiguousarray(d.T)

    def trial(p: np.ndarray, q: np.ndarray) -> None:
        e, before, loss = np.zeros(n), np.zeros(n), np.zeros(n)
        for now in steps:
            e = now - p * before - q * e
            before = now
            loss += e * e
        better = loss < best - 1e-12
        best[better], phi[better], theta[better] = loss[better], p[better], q[better]
        out[better] = (last + p * before + q * e)[better]

    trial(np.zeros(n), np.zeros(n))
    grid = np.array([-0.9, -0.6, -0.3, 0.0, 0.3, 0.6, 0.9])
    for a in grid:
        for b in grid:
            trial(np.full(n, a), np.full(n, b))
    for step in (0.15, 0.075, 0.0375):
        p, q = phi.copy(), theta.copy()
        for a in (-step, 0, step):
            for b in (-step, 0, step):
                if a or b:
                    trial(np.clip(p + a, -0.99, 0.99), np.clip(q + b, -0.99, 0.99))
    return np.maximum(np.nan_to_num(out), 0)


@F.pandas_udf(DoubleType())
def arima_of(series: pd.Series) -> pd.Series:
    """The forecast of every array; those with fewer than two values forecast 0. Equal arrays are fitted once, those of all lengths together."""
    out = np.zeros(len(series))
    sizes = series.map(len).to_numpy()
    same: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(sizes >= 2).tolist():
        same.setdefault(series.iat[k].tobytes(), []).append(k)
    # alike lengths together, short ones with zeros in front: differences of 0 before a series begins add nothing to its loss
    keys = sorted(same, key=len)
    for lo in range(0, len(keys), 1024):
        part = [np.frombuffer(k) for k in keys[lo : lo + 1024]]
        d = np.zeros((len(part), len(part[-1]) - 1))
        for row, y in zip(d, part):
            row[len(row) + 1 - len(y) :] = np.diff(y)
        for k, x in zip(keys[lo : lo + 1024], arima_fit(d, np.array([y[-1] for y in part]))):
            out[same[k]] = x
    return pd.Series(out)


def arima(periods: DataFrame, span: int = ARIMA_SPAN) -> DataFrame:
    """arima_0, arima_1 over the last ``span`` periods."""
    kept = recent(periods, ["word"], "period_id", span, {f"_a{c}": F.col(f"n{c}") for c in CLASSES})
    return kept.withColumns({f"arima_{c}": arima_of(f"_a{c}") for c in CLASSES}).drop("_a0", "_a1")


_MODELS = {"poisson": poisson, "seasonal": seasonal, "arima": arima, "ewma": ewma}


def poisson_draw(rate: Column, key: Column, seed: int = 0) -> Column:
    """A whole number drawn with a Poisson rate, the same for the same key: the inverse of the distribution, in up to 64 steps."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("s"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        on = u > a["s"]
        return F.struct(F.when(on, p).otherwise(a["p"]).alias("p"), F.when(on, a["s"] + p).otherwise(a["s"]).alias("s"), F.when(on, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda a: a["k"])


def experts(periods: DataFrame, names: Sequence[str] = EXPERTS, cap: float = CAP) -> DataFrame:
    """``periods`` with the capped forecast <expert>_<class> of every expert after each period; an unknown name forecasts -1."""
    periods = settled(periods)
    for name in names:
        if name in _MODELS:
            periods = settled(_MODELS[name](periods))
        else:
            periods = periods.withColumns({f"{name}_{c}": F.lit(-1.0) for c in CLASSES})
    return periods.withColumns({f"{n}_{c}": F.least(f"{n}_{c}", F.lit(cap)) for n in names for c in CLASSES})


def weighted(forecast: DataFrame, names: Sequence[str] = EXPERTS, cap: float = CAP, floor: float = 0.0) -> DataFrame:
    """With weights w_<expert>_<class> after each period and the combined forecast f0, f1.

    A weight is multiplied by exp(-loss / c) whenever a period closes, so it is the softmax of the
    summed loss; the loss is the squared error of the forecast before, 0 before the first.
    """
    keys = [f"{n}_{c}" for n in names for c in CLASSES]
    before = prior(settled(forecast), ["word"], "period_id", {}, {"_before": F.struct("period_id", *keys)})
    loss = {f"_l_{k}": F.pow(F.col(f"n{k[-1]}") - F.coalesce(F.col(f"_before.{k}"), F.lit(0.0)), 2.0) for k in keys}
    before = settled(before.withColumns(loss).drop("_before"))
    sums = prior(before, ["word"], "period_id", {f"_c_{k}": F.col(f"_l_{k}") for k in keys})
    c = 2 * cap * cap
    total = {k: F.col(f"_c_{k}") + F.col(f"_l_{k}") for k in keys}
    out = sums
    for cl in CLASSES:
        mine = [f"{n}_{cl}" for n in names]
        low = F.least(*(total[k] for k in mine)) if len(mine) > 1 else total[mine[0]]
        raw = {k: F.exp(-(total[k] - low) / c) for k in mine}
        whole = sum((raw[k] for k in mine), F.lit(0.0))
        weight = {k: F.greatest(raw[k] / whole, F.lit(floor)) for k in mine}
        out = out.withColumns({f"w_{k}": weight[k] for k in mine}).withColumn(f"f{cl}", sum((weight[k] * F.col(k) for k in mine), F.lit(0.0)))
    return out.drop(*(f"_{p}_{k}" for p in "lc" for k in keys))


def asked(rows: DataFrame, states: DataFrame, by: Sequence[str] = ("word",), values: Sequence[str] = ("f0", "f1")) -> DataFrame:
    """``rows(…, seq)`` with the ``values`` of the last state whose close_seq is smaller than seq; 0 where there is none."""
    none = {v: F.lit(None).cast("double") for v in values}
    a = rows.withColumns({f"_s_{v}": x for v, x in none.items()}).withColumn("_ask", F.lit(True))
    b = states.select(*by, F.col("close_seq").alias("seq"), *(F.col(v).alias(f"_s_{v}") for v in values), F.lit(False).alias("_ask"))
    state = F.when(~F.col("_ask"), F.struct("seq", *(f"_s_{v}" for v in values)))
    both = prior(a.unionByName(b, allowMissingColumns=True), list(by), "seq", {}, {"_state": state}).filter("_ask")
    found = {v: F.greatest(F.nanvl(F.coalesce(F.col(f"_state._s_{v}"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for v in values}
    return both.withColumns(found).drop("_state", "_ask", *(f"_s_{v}" for v in values))


def document_forecasts(counted: DataFrame, stream: DataFrame, names: Sequence[str] = EXPERTS, period: int = tj.WORD_PERIOD, class_period: int = tj.CLASS_PERIOD) -> tuple[DataFrame, DataFrame]:
    """((seq, word, x, f0, f1), (seq, label, f0, f1)): what is forecast for the words and classes of every document before it is learned."""
    words = weighted(experts(tj.anchored(tj.occurrences(counted), period), names), names)
    classes = weighted(experts(tj.anchored(tj.class_occurrences(stream), class_period), names), names)
    return asked(counted.select("seq", "word", "x"), words), asked(stream.select("seq", "label"), classes, ())


def tracked(periods: DataFrame, words: Sequence[str], names: Sequence[str] = EXPERTS) -> DataFrame:
    """Truth and forecasts of some words (case is ignored): a row for each closed period, forecasts made before it closed."""
    mine = periods.filter(F.lower("word").isin(*[w.lower() for w in words]))
    keys = [f"{n}_{c}" for n in names for c in CLASSES] + ["f0", "f1"]
    done = settled(weighted(experts(mine, names), names))
    before = prior(done, ["word"], "period_id", {}, {"_b": F.struct("period_id", *keys)})
    return before.select("word", "period_id", "t_close", F.col("n0").alias("true_0"), F.col("n1").alias("true_1"), *(F.coalesce(F.col(f"_b.{k}"), F.lit(0.0)).alias(k) for k in keys))


def instance_buckets(rows: DataFrame, size: int = 25, buckets: int = WEEKS) -> DataFrame:
    """(word, bucket, n0, n1, points, rate0, rate1): rates without times, over buckets of ``size`` sightings; the newest ``buckets`` stay."""
    at = prior(rows, ["word"], "seq", {"_n": F.lit(1).cast("long")}).withColumn("bucket", F.floor(F.col("_n") / size))
    newest = at.groupBy("word").agg(F.max("bucket").alias("_last"))
    kept = at.join(newest, "word").filter(F.col("bucket") > F.col("_last") - buckets)
    sums = kept.groupBy("word", "bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("points"))
    return sums.withColumns({f"rate{c}": F.col(f"n{c}") / F.col("points") for c in CLASSES})


def window_predictors(rows: DataFrame, stop: int, span: int, by: str = "word") -> DataFrame:
    """(by, avg0, avg1, sum0, sum1, trend0, trend1): mean, sum and least-squares line at ``stop`` over the ``span`` seconds before.

    Times are centred at ``stop``, so the line's value there is its intercept; where all times are one it is the mean.
    """
    at = tj.between(rows, stop - span, stop).withColumn("_t", (F.col("s") - stop).cast("double"))
    sums = [f(f"n{c}").alias(f"{name}{c}") for name, f in (("avg", F.avg), ("sum", F.sum)) for c in CLASSES]
    lines = [F.coalesce(F.regr_intercept(F.col(f"n{c}"), F.col("_t")), F.avg(f"n{c}")).alias(f"trend{c}") for c in CLASSES]
    return at.groupBy(by).agg(*sums, *lines)


def binarised(forecast: Column) -> Column:
    return (forecast > 0).cast("int")


def longest_series(periods: DataFrame) -> DataFrame:
    """One row (word, n): the word with the most periods in which it occurred; of ties the first in the alphabet."""
    return periods.filter("n0 + n1 > 0").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(1)
