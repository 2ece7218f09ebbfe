"""Values that stand in for word counts: from loaded sentiment, and from predictors over a word's own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled
from .trajectories import occurrences

MONTHS = 2
#: A list of so many words, some megabytes, may be broadcast.
MOST_BROADCAST = 1 << 16
PREDICTORS = ("average", "sum", "regression")


def latest(sentiment: DataFrame, months: int = MONTHS) -> DataFrame:
    """(word, v0, v1): the mean of a word's last ``months`` lines of ``sentiment(word, line, pos, neg)``."""
    w = Window.partitionBy("word").orderBy(F.desc("line"))
    kept = sentiment.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= months)
    return kept.groupBy("word").agg(F.avg("pos").alias("v0"), F.avg("neg").alias("v1"))


def monthly_sentiment(counted: DataFrame) -> DataFrame:
    """(word, line, pos, neg): a word's occurrences in each class and month; line is the month's number."""
    month = (F.year("ts") * 12 + F.month("ts")).alias("line")
    of = lambda c, name: F.sum(F.when(F.col("label") == c, F.col("x")).otherwise(0.0)).alias(name)
    return counted.groupBy("word", month).agg(of(0, "pos"), of(1, "neg"))


def loaded(counted: DataFrame, sentiment: DataFrame, months: int = MONTHS) -> DataFrame:
    """(seq, word, v0, v1) for the words of documents that are in the lexicon."""
    return counted.select("seq", "word").join(latest(sentiment, months), "word")


def loaded_before(counted: DataFrame, sentiment: DataFrame, months: int = MONTHS) -> DataFrame:
    """(seq, word, v0, v1): the mean of a word's last ``months`` lines before the month of the document.

    Lines are asked for in the order of time together with the months that ask; a word's lines are few, one for each month.
    """
    line = (F.year("ts") * 12 + F.month("ts")).alias("line")
    asked = counted.select("word", line).distinct()
    w = Window.partitionBy("word").orderBy("line", "_ask")
    none = F.lit(None).cast("double")
    both = sentiment.select("word", "line", "pos", "neg", F.lit(1).alias("_ask")).union(asked.select("word", "line", none, none, F.lit(0)))
    # of equal lines the question comes first, so its own month isn't among the answers
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = both.withColumn("_n", F.sum("_ask").over(past))
    given = lines.filter("_ask = 1").select("word", F.coalesce("_n", F.lit(0)).alias("_k"), "pos", "neg")
    ask = lines.filter("_ask = 0 AND _n > 0").select("word", "line", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_n") - months), F.col("_n") - 1)).alias("_k"))
    found = ask.join(given, ["word", "_k"]).groupBy("word", "line").agg(F.avg("pos").alias("v0"), F.avg("neg").alias("v1"))
    return counted.select("seq", "word", line).join(found, ["word", "line"]).select("seq", "word", "v0", "v1")


def _before(rows: DataFrame, span: int) -> DataFrame:
    """(word, ask, k, y0, y1, u, uu, uy0, uy1, lo, hi, at, last): sums over the rows of a word in the ``span`` seconds before each one.

    Times are cut into buckets of the span's length, so the rows before are the end of one bucket and the beginning of the next:
    two running sums. u is a row's time from the start of the asking row's bucket, at that of the asking row itself; last is the greatest
    seq of the rows, and the sums hold where it is less than ask.
    """
    value = ["u", "n0", "n1", "seq"]
    own = rows.select("word", F.col("seq").alias("ask"), F.col("_b").alias("_bucket"), F.col("s").alias("_o"), (F.col("s") - F.col("_b") * span).cast("double").alias("at"), F.lit(True).alias("_own"), (F.col("s") - F.col("_b") * span).cast("double").alias("u"), "n0", "n1", "seq")
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in value]
    back = rows.select("word", F.col("seq").alias("ask"), (F.col("_b") - 1).alias("_bucket"), (F.col("s") - span).alias("_o"), (F.col("s") - F.col("_b") * span).cast("double").alias("at"), F.lit(False).alias("_own"), *none)
    w = Window.partitionBy("word", "_bucket")
    upto = w.orderBy("_o", "ask").rowsBetween(Window.unboundedPreceding, -1)
    since = w.orderBy(F.desc("_o")).rangeBetween(Window.unboundedPreceding, 0)
    over = lambda f: F.when(F.col("_own"), f.over(upto)).otherwise(f.over(since))
    u = F.col("u")
    sums = {"k": F.count("seq"), "y0": F.sum("n0"), "y1": F.sum("n1"), "u": F.sum(u), "uu": F.sum(u * u), "uy0": F.sum(u * F.col("n0")), "uy1": F.sum(u * F.col("n1"))}
    both = own.unionByName(back).select("word", "ask", "at", "_own", *(over(f).alias(f"_{k}") for k, f in sums.items()), over(F.min("u")).alias("_lo"), over(F.max("u")).alias("_hi"), over(F.max("seq")).alias("last"))
    # the bucket before lies a span further back
    k, d = F.col("_k"), F.when(F.col("_own"), F.lit(0.0)).otherwise(F.lit(float(span)))
    moved = {"k": k, "y0": F.col("_y0"), "y1": F.col("_y1"), "u": F.col("_u") - k * d, "uu": F.col("_uu") - 2 * d * F.col("_u") + k * d * d, "uy0": F.col("_uy0") - d * F.col("_y0"), "uy1": F.col("_uy1") - d * F.col("_y1")}
    parts = both.select("word", "ask", "at", "_own", "last", *(x.alias(c) for c, x in moved.items()), (F.col("_lo") - d).alias("lo"), (F.col("_hi") - d).alias("hi"))
    return parts.groupBy("word", "ask").agg(*(F.sum(c).alias(c) for c in moved), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("at").alias("at"), F.max("last").alias("last"), F.count_if("_own").alias("times"))


def predicted(counted: DataFrame, words: DataFrame, span: int, predictor: str = "average") -> DataFrame:
    """(seq, word, v0, v1) for ``words(word)``: what a predictor makes of the word's occurrences in the ``span`` seconds before.

    They are those with a lower number and a time from ``span`` seconds before the document's up to it. Where numbers follow the times all come from
    running sums; a document that lies in its span before one with a lower number is joined with the span's rows.
    """
    if predictor not in PREDICTORS:
        raise ValueError(f"predictor must be one of {', '.join(PREDICTORS)}")
    words = words.select("word").distinct()
    words = F.broadcast(words) if words.count() <= MOST_BROADCAST else words
    rows = settled(occurrences(counted).join(words, "word", "left_semi").withColumn("_b", F.floor(F.col("s") / span)))
    late = (F.col("last") >= F.col("ask")) | (F.col("times") > 1)
    sums = settled(_before(rows, span).withColumn("_late", F.coalesce(late, F.lit(False))))

    def line(c: int) -> Column:
        k, u, y = F.col("k"), F.col("u"), F.col(f"y{c}")
        slope = (k * F.col(f"uy{c}") - u * y) / (k * F.col("uu") - u * u)
        return F.greatest(F.when(F.col("hi") > F.col("lo"), (y + slope * (k * F.col("at") - u)) / k).otherwise(y / k), F.lit(0.0))

    of = {"average": lambda c: F.col(f"y{c}") / F.col("k"), "sum": lambda c: F.col(f"y{c}"), "regression": line}[predictor]
    value = lambda c: F.when(F.col("k") > 0, of(c)).otherwise(0.0).alias(f"v{c}")
    out = sums.filter("NOT _late").select(F.col("ask").alias("seq"), "word", value(0), value(1))
    if sums.filter("_late").isEmpty():
        return out
    asked = rows.join(sums.filter("_late").select("word", F.col("ask").alias("seq")), ["word", "seq"])
    return out.unionByName(_joined(asked, rows, span, predictor))


def _joined(asked: DataFrame, rows: DataFrame, span: int, predictor: str) -> DataFrame:
    """The same by a join of each asking row with the rows of its bucket and the one before."""
    ask = asked.select("word", F.col("seq").alias("ask"), F.col("s").alias("at"), F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
    past = ask.join(rows, ["word", "_b"]).filter((F.col("seq") < F.col("ask")) & (F.col("s") >= F.col("at") - span) & (F.col("s") <= F.col("at")))
    t = (F.col("s") - F.col("at")).cast("double")
    value = {
        "average": lambda c: F.avg(f"n{c}"),
        "sum": lambda c: F.sum(f"n{c}"),
        "regression": lambda c: F.greatest(F.coalesce(F.regr_intercept(F.col(f"n{c}"), t), F.avg(f"n{c}")), F.lit(0.0)),
    }[predictor]
    found = past.groupBy("word", "ask").agg(value(0).alias("v0"), value(1).alias("v1"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    every = asked.select("word", F.col("seq").alias("ask")).distinct()
    return every.join(found, ["word", "ask"], "left").select(F.col("ask").alias("seq"), "word", zero("v0"), zero("v1"))
