"""Ordered operators that don't need one partition: prefix sums, ordinals and range frames in two levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block of the order column. Rows of a block meet in one task; blocks are summed up first.
BLOCK = 1 << 16


def prior(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column] = {}, maxima: Mapping[str, Column] = {}, block: int = BLOCK) -> DataFrame:
    """``df`` with aggregates over the rows of the same ``by`` whose ``order`` (a whole number) is strictly less.

    Sums without such a row are 0, maxima null. The order is cut into blocks: a
    window over the totals of the blocks gives what lies before a block, one over
    a block's rows the rest, so neither a key with very many rows nor an empty
    ``by`` puts all rows in one task.
    """
    values = {f"_prior_v_{k}": v for k, v in {**sums, **maxima}.items()}
    df = df.withColumns({**values, "_prior_block": F.floor(F.col(order) / block)})
    keys = [*by, "_prior_block"]
    totals = df.groupBy(*keys).agg(*(F.sum(f"_prior_v_{k}").alias(f"_prior_t_{k}") for k in sums), *(F.max(f"_prior_v_{k}").alias(f"_prior_t_{k}") for k in maxima))
    before = Window.partitionBy(*by).orderBy("_prior_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *(F.sum(f"_prior_t_{k}").over(before).alias(f"_prior_o_{k}") for k in sums), *(F.max(f"_prior_t_{k}").over(before).alias(f"_prior_o_{k}") for k in maxima))
    inside = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({**{f"_prior_i_{k}": F.sum(f"_prior_v_{k}").over(inside) for k in sums}, **{f"_prior_i_{k}": F.max(f"_prior_v_{k}").over(inside) for k in maxima}})
    on = [df[k].eqNullSafe(totals[k]) for k in keys]
    both = df.join(totals, on, "left").drop(*(totals[k] for k in keys))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {k: zero(f"_prior_i_{k}") + zero(f"_prior_o_{k}") for k in sums} | {k: F.greatest(f"_prior_i_{k}", f"_prior_o_{k}") for k in maxima}
    return both.withColumns(out).drop("_prior_block", *values, *(f"_prior_{p}_{k}" for p in "io" for k in [*sums, *maxima]))


def ordinal(df: DataFrame, order: str, to: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the 1-based position of every row in the order of a unique whole number."""
    df = prior(df, [], order, {to: F.lit(1).cast("long")}, block=block)
    return df.withColumn(to, F.col(to) + 1)


def earliest_within(df: DataFrame, time: str, span: int, value: str, to: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the least ``value`` and number of rows whose ``time`` (in seconds) lies within ``span`` before a row's, its own included.

    Times are cut into buckets of the span's length, so a span is the end of one bucket and the beginning of the next. Both are
    running aggregates over the different times of a bucket: the work grows with the rows, however many lie within a span.
    """
    keys = [*by, "_bucket"]
    seconds = df.groupBy(*by, F.col(time).alias("_t")).agg(F.min(value).alias("_m"), F.count("*").alias("_n"))
    bucket = F.floor(F.col("_t") / span)
    own = seconds.select(*by, "_t", bucket.alias("_bucket"), F.col("_t").alias("_o"), "_m", "_n", F.lit(True).alias("_own"))
    none = F.lit(None)
    ask = seconds.filter("_t IS NOT NULL").select(*by, "_t", (bucket - 1).alias("_bucket"), (F.col("_t") - span).alias("_o"), none.cast(seconds.schema["_m"].dataType).alias("_m"), none.cast("long").alias("_n"), F.lit(False).alias("_own"))
    upto, since = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_o"), F.desc("_o")))
    over = lambda f: F.when(F.col("_own"), f.over(upto)).otherwise(f.over(since))
    parts = own.unionByName(ask).select(*by, "_t", over(F.min("_m")).alias("_m"), over(F.sum("_n")).alias("_n"))
    found = parts.groupBy(*by, "_t").agg(F.min("_m").alias(to), F.coalesce(F.sum("_n"), F.lit(0)).alias(f"{to}_rows"))
    on = [df[k].eqNullSafe(found[k]) for k in by] + [df[time].eqNullSafe(found["_t"])]
    return df.join(found, on).drop("_t", *(found[k] for k in by))
