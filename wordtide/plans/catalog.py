"""The registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ensembles, evaluation, forecasts, learners, lexical, sketches, trajectories, windows
from ..operators import tokens as tk
from ..operators.prefix import prior
from ..operators.settle import settled, shared_dir
from ..sources import lexicons, streams
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Seconds of a period of the event series.
EVENT_PERIOD = 3600
EVENT_EXPERTS = ("poisson", "seasonal", "ewma")
TRACKED = ("the", "and", "of", "to", "in", "die", "und", "der", "la", "de", "le", "et", "el", "en")
TOP = 100
BAG_WORDS = 3000
LIVE_LIMIT = 1000


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: the last ones hang on the order of summation."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.labelled_stream(spark, sf_dir)


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as occurrences of their type; the parity of the user is the class."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = lambda c: F.when(F.col("user_id") % 2 == c, 1.0).otherwise(0.0).alias(f"n{c}")
    return e.select(F.col("event_type").alias("word"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), one(0), one(1))


def _event_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.anchored(_event_rows(spark, sf_dir), EVENT_PERIOD)


# learners


@query
def prequential_mnb(spark, sf_dir):
    """Votes of plain multinomial Naive Bayes, tested on each document before it trains on it."""
    return learners.vanilla(_stream(spark, sf_dir))


@query
def mnb_sketch_exact(spark, sf_dir):
    return learners.sketch_form(_stream(spark, sf_dir))


@query
def mnb_fading(spark, sf_dir):
    return learners.fading(_stream(spark, sf_dir))


@query
def mnb_aggressive(spark, sf_dir):
    return learners.aggressive(_stream(spark, sf_dir))


@query
def mnb_time_series(spark, sf_dir):
    return learners.time_series(_stream(spark, sf_dir))


@query
def mnb_lexicon(spark, sf_dir):
    """Plain Naive Bayes in which means of the last two months before a document's stand for the counts of its words."""
    s = _stream(spark, sf_dir)
    counted = settled(tk.tokens(s))
    return learners.vanilla_with(s, lexical.loaded_before(counted, lexical.monthly_sentiment(counted)), counted)


@query
def mnb_predictor(spark, sf_dir):
    """Plain Naive Bayes in which means over a day stand for the counts of the tracked words."""
    s = _stream(spark, sf_dir)
    counted = settled(tk.tokens(s))
    words = spark.createDataFrame([(w,) for w in TRACKED], "word string")
    return learners.vanilla_with(s, lexical.predicted(counted, words, 86_400), counted)


@query
def model_description(spark, sf_dir):
    return learners.model(_stream(spark, sf_dir))


@query
def holdout_split(spark, sf_dir):
    return learners.holdout(_stream(spark, sf_dir))


# windows and ensembles


@query
def mnb_window_12h(spark, sf_dir):
    return learners.windowed(_stream(spark, sf_dir), windows.SPANS[1])


@query
def ensemble_2(spark, sf_dir):
    return ensembles.average(ensembles.sliding_votes(_stream(spark, sf_dir)))


@query
def ensemble_weighted(spark, sf_dir):
    s = _stream(spark, sf_dir)
    v = ensembles.sliding_votes(s)
    return ensembles.weighted_average(ensembles.with_weights(v, s, ensembles.g_mean_weights(v, s)))


@query
def ensemble_mse(spark, sf_dir):
    s = _stream(spark, sf_dir)
    v = ensembles.sliding_votes(s)
    return ensembles.scaled_votes(ensembles.with_weights(v, s, ensembles.mse_weights(v, s)))


@query
def sliding_window_counts(spark, sf_dir):
    return windows.sliding(_stream(spark, sf_dir), windows.SPANS[1])


for _period in ("day", "week", "month"):
    QUERIES[f"class_counts_{_period}"] = lambda spark, sf_dir, p=_period: windows.class_counts(_stream(spark, sf_dir), p)


for _period in ("day", "week"):
    QUERIES[f"class_periods_{_period}"] = lambda spark, sf_dir, p=_period: windows.anchored_counts(_stream(spark, sf_dir), p)


@query
def tumbling_counts(spark, sf_dir):
    t = windows.tumbling(_stream(spark, sf_dir), "6 hours")
    return t.select(F.unix_seconds("start").alias("start"), "n0", "n1")


@query
def shift_matrix(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    labelled = rows.select("word", F.timestamp_seconds("s").alias("ts"), F.when(F.col("n0") > 0, 0).otherwise(1).alias("label"), F.lit(1.0).alias("x"))
    return windows.shift_matrix(labelled, "word")


# texts


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def tokenize_tf(spark, sf_dir):
    return tk.tokens(_stream(spark, sf_dir)).select("seq", "word", "x")


@query
def running_tfidf(spark, sf_dir):
    return tk.running_tfidf(_stream(spark, sf_dir))


@query
def bag_of_words(spark, sf_dir):
    return tk.bag_of_words(_stream(spark, sf_dir), BAG_WORDS).select("seq", "word", "x")


@query
def document_lengths(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return tk.documents(s, tk.tokens(s)).select("seq", "n", "v")


@query
def clean_emoticons(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.rejoin(tx.emoticons(tx.split_words(F.col("text")))).alias("text"))


@query
def resolve_negations(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.rejoin(tx.negations(tx.split_words(F.col("text")))).alias("text"))


@query
def squeeze_repeats(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.squeeze(F.lower("text")).alias("text"))


@query
def strip_letters(spark, sf_dir):
    words = tx.unmark(tx.split_words(F.col("text")))
    return _documents(spark, sf_dir).select("doc_id", tx.rejoin(F.transform(words, tx.letters)).alias("text"))


@query
def expand_colloquial(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.rejoin(tx.colloquial(tx.split_words(F.col("text")))).alias("text"))


@query
def stopword_antijoin(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.rejoin(tx.without_stop_words(tx.split_words(F.col("text")))).alias("text"))


@query
def cleaned_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("text"))


@query
def stemmed_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.stemmed(tx.clean(F.col("text"))).alias("text"))


@query
def cleaning_counters(spark, sf_dir):
    """How often each step of the cleaning applies in the corpus, and how many distinct words come out."""
    words = _documents(spark, sf_dir).select(F.explode(tx.split_words(F.col("text"))).alias("w")).withColumn("e", tx.emoticon(F.col("w")))
    mark = lambda c, name: F.count_if(c).alias(name)
    changed = F.col("e") != F.col("w")
    return words.agg(
        *(mark(changed & (F.col("e") == k), k) for k in ("positive", "negative", "smile", "love")),
        mark(tx.is_negation(F.col("w")), "negations"),
        mark(tx.squeeze(F.col("w")) != F.col("w"), "repetitions"),
        mark(F.col("w").isin(*tx.lexicons.COLLOQUIAL), "colloquial"),
        mark(F.col("w").isin(*tx.lexicons.VERBS), "verbs"),
        mark(F.col("w").isin(*tx.lexicons.ANTONYMS), "opposites"),
        mark(F.col("w").isin(*tx.lexicons.STOP_WORDS), "stop_words"),
        F.countDistinct(F.when(F.col("w") != "", F.col("w"))).alias("distinct_words"),
    )


@query
def label_encode(spark, sf_dir):
    """Class codes to 0 and 1: the codes of the ratings, and those of mail."""
    raw = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stars, mail = F.when(F.col("quality") == 1, "4").otherwise("0"), F.when(F.col("toxic") == 1, "spam").otherwise("Ham ")
    return raw.select("doc_id", streams.encode_label(stars).alias("rating"), streams.encode_label(mail).alias("mail"), streams.encode_label(F.lit("?")).alias("unknown"))


@query
def date_seconds(spark, sf_dir):
    """Order dates as seconds, one in seven of them spoilt."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", streams.epoch_seconds(text).alias("seconds"))


# sketches


@query
def topk_words(spark, sf_dir):
    return sketches.top_words(tk.tokens(_stream(spark, sf_dir)), TOP)


@query
def relative_frequency(spark, sf_dir):
    return sketches.relative_frequency(tk.tokens(_stream(spark, sf_dir)))


@query
def decayed_counts(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return sketches.decayed_counts(tk.tokens(s), s)


@query
def chi2_words(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return sketches.chi_square(tk.tokens(s), s).filter(F.col("chi2") > sketches.CHI2)


@query
def chi2_batches(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return sketches.chi_square_batches(tk.tokens(s), s, 100)


@query
def spacesaving_bounded(spark, sf_dir):
    return sketches.space_saving(tk.tokens(_stream(spark, sf_dir)))


@query
def spacesaving_lanes(spark, sf_dir):
    return sketches.survivors(sketches.space_saving(tk.tokens(_stream(spark, sf_dir)), lanes=16))


@query
def adwin_counts(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return sketches.adwin_counts(tk.tokens(s), s, sketches.CAPACITY)


@query
def mnb_sketch_bounded(spark, sf_dir):
    """The sketch learner over a bounded sketch: counts of a word that was evicted begin anew."""
    s = _stream(spark, sf_dir)
    counted = settled(tk.tokens(s))
    return learners.sketch_form(s, sketches.with_epochs(counted, sketches.space_saving(counted)), counted)


# time series


@query
def anchored_periods(spark, sf_dir):
    return _event_periods(spark, sf_dir)


@query
def word_periods(spark, sf_dir):
    return trajectories.anchored(trajectories.occurrences(tk.tokens(_stream(spark, sf_dir))))


@query
def count_periods(spark, sf_dir):
    return trajectories.by_count(_event_rows(spark, sf_dir), 25)


@query
def cumulative_trajectory(spark, sf_dir):
    return trajectories.cumulative(_event_rows(spark, sf_dir))


@query
def time_tree(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return trajectories.time_tree(tk.tokens(s), s)[1]


@query
def time_tree_words(spark, sf_dir):
    """The other half of the time tree: the words of every second."""
    s = _stream(spark, sf_dir)
    return trajectories.time_tree(tk.tokens(s), s)[0]


@query
def inverted_index(spark, sf_dir):
    rows = trajectories.inverted_index(tk.tokens(_stream(spark, sf_dir)))
    return rows.select("word", F.array_join(F.transform("times", lambda t: t.cast("string")), ",").alias("times"))


@query
def class_trajectory(spark, sf_dir):
    """Documents and tokens of each class in the last day of the stream."""
    s = _stream(spark, sf_dir)
    stop = s.agg(F.unix_seconds(F.max("ts"))).first()[0] or 0
    return trajectories.class_trajectory(s, tk.tokens(s), stop, 86_400)


@query
def poisson_rate(spark, sf_dir):
    return forecasts.poisson(_event_periods(spark, sf_dir)).select("word", "period_id", "poisson_0", "poisson_1")


@query
def seasonal_rate(spark, sf_dir):
    return forecasts.seasonal(_event_periods(spark, sf_dir)).select("word", "period_id", "seasonal_0", "seasonal_1")


@query
def ewma_forecast(spark, sf_dir):
    return forecasts.ewma(_event_periods(spark, sf_dir)).select("word", "period_id", "ewma_0", "ewma_1")


@query
def arima_forecast(spark, sf_dir):
    return forecasts.arima(_event_periods(spark, sf_dir)).select("word", "period_id", "arima_0", "arima_1")


@query
def instance_rates(spark, sf_dir):
    return forecasts.instance_buckets(_event_rows(spark, sf_dir))


@query
def window_predictors(spark, sf_dir):
    """Mean, sum and trend of every event type over the last week."""
    rows = _event_rows(spark, sf_dir)
    stop = rows.agg(F.max("s")).first()[0] or 0
    hourly = rows.groupBy("word", (F.floor(F.col("s") / 3600) * 3600).alias("s")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return forecasts.window_predictors(hourly, stop, 7 * 86_400)


@query
def expert_weights(spark, sf_dir):
    done = forecasts.weighted(forecasts.experts(_event_periods(spark, sf_dir), EVENT_EXPERTS), EVENT_EXPERTS)
    return done.select("word", "period_id", *(f"w_{e}_{c}" for e in EVENT_EXPERTS for c in (0, 1)))


@query
def expert_forecast(spark, sf_dir):
    done = forecasts.weighted(forecasts.experts(_event_periods(spark, sf_dir), EVENT_EXPERTS), EVENT_EXPERTS)
    return done.select("word", "period_id", "f0", "f1")


@query
def expert_forecast_all(spark, sf_dir):
    """Weights and forecasts of all four experts, ARIMA among them."""
    return forecasts.weighted(forecasts.experts(_event_periods(spark, sf_dir), forecasts.EXPERTS), forecasts.EXPERTS)


@query
def tracked_forecasts(spark, sf_dir):
    """Truth and forecasts, of all four experts, for every closed period of the tracked words."""
    return forecasts.tracked(trajectories.anchored(trajectories.occurrences(tk.tokens(_stream(spark, sf_dir)))), TRACKED)


# evaluation


def _votes(spark, sf_dir):
    return learners.vanilla(_stream(spark, sf_dir))


@query
def metrics(spark, sf_dir):
    return evaluation.metrics(evaluation.confusion(_votes(spark, sf_dir)))


@query
def running_totals(spark, sf_dir):
    return evaluation.running_totals(_votes(spark, sf_dir))


@query
def window_kappa(spark, sf_dir):
    return evaluation.windowed(_votes(spark, sf_dir))


@query
def fading_estimates(spark, sf_dir):
    return evaluation.fading_estimates(evaluation.windowed(_votes(spark, sf_dir)))


@query
def daily_performance(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return evaluation.daily(evaluation.windowed(learners.vanilla(s)), s)


@query
def anchored_daily_performance(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return evaluation.anchored_daily(evaluation.windowed(learners.vanilla(s)), s)


@query
def count_batches(spark, sf_dir):
    return evaluation.count_batches(_votes(spark, sf_dir))


@query
def significance_rows(spark, sf_dir):
    return evaluation.significance(_votes(spark, sf_dir))


def _three(s):
    named = {"vanilla": learners.vanilla, "sketch": learners.sketch_form, "fading": learners.fading}
    one, two, three = (f(s).withColumn("learner", F.lit(k)) for k, f in named.items())
    return settled(one.unionByName(two).unionByName(three))


@query
def pairwise_kappa(spark, sf_dir):
    return evaluation.pairwise(_three(_stream(spark, sf_dir)))


@query
def learner_daily(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return evaluation.by_learner(_three(s), s)


# scans


@query
def random_order(spark, sf_dir):
    return streams.random_order(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", 7)


@query
def ordered_scan(spark, sf_dir):
    """Every document of the stream with its place in the order of time."""
    s = _stream(spark, sf_dir).withColumn("_t", F.unix_seconds("ts"))
    # a document's number among those of its second, after all seconds before
    at = F.row_number().over(Window.partitionBy("_t").orderBy("seq"))
    return prior(s.withColumn("_k", at), [], "_t", {"_n": F.lit(1).cast("long")}, block=86_400).select("seq", "label", (F.col("_n") + F.col("_k")).alias("position"))


@query
def scan_page(spark, sf_dir):
    """A page of the ordered scan of a relation: limit and offset."""
    c = streams.StreamConfig(path=f"{sf_dir}/orders.parquet", format="parquet", label="o_orderstatus", text="o_orderpriority", time="o_orderdate", order="o_orderkey", codes={"f": 0, "o": 1, "p": 1}, limit=500, offset=250)
    return streams.load_stream(spark, c).select("seq", F.unix_seconds("ts").alias("s"), "label", "text")


@query
def time_units(spark, sf_dir):
    """How many whole minutes, hours, days and weeks lie between the first event of a user and each one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    both = e.join(first, "user_id")
    return both.select("event_id", *(windows.whole_units(F.col("ts"), F.col("first"), u).alias(u) for u in ("minute", "hour", "day", "week")))


def _lexicon(spark, lines):
    """The lines of a column as a file in the shared folder."""
    path = f"{shared_dir(spark)}/lexicon"
    lines.coalesce(1).write.text(path)
    return path


@query
def lexicon_keys(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("value"))
    return lexicons.keys(spark, _lexicon(spark, p))


@query
def lexicon_key_values(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    return lexicons.key_values(spark, _lexicon(spark, p.select(F.concat_ws("::", F.col("n_regionkey").cast("string"), "n_name").alias("value"))))


@query
def lexicon_opposites(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select(F.lower("n_name").alias("value"))
    return lexicons.opposites(spark, _lexicon(spark, n))


@query
def tracked_tail(spark, sf_dir):
    """The last day of the trajectories of the tracked words; a word without any gets a zero at its end."""
    rows = trajectories.occurrences(tk.tokens(_stream(spark, sf_dir)))
    stop = _stream(spark, sf_dir).agg(F.unix_seconds(F.max("ts"))).first()[0] or 0
    words = spark.createDataFrame([(w,) for w in (*TRACKED, "wordthatnoonesays")], "word string")
    kept = trajectories.without_words(trajectories.tail(rows, stop, 86_400), words.filter("word = 'und'"))
    return trajectories.or_zero(words, kept, stop)


@query
def spacesaving_merged(spark, sf_dir):
    """The words of the merged sketches of all tasks, with the bound on their error."""
    return sketches.merged_sketch(tk.tokens(_stream(spark, sf_dir)))


@query
def learner_fading_behind_sketch(spark, sf_dir):
    """The fading learner behind a bounded sketch of 5000 words."""
    s = _stream(spark, sf_dir)
    return learners.fading(s, settled(sketches.sketched(settled(tk.tokens(s)))))


@query
def live_slice(spark, sf_dir):
    """The first documents of the stream in the order of time: the slice that the live relation has."""
    return _stream(spark, sf_dir).orderBy("ts", "seq").limit(LIVE_LIMIT).select("seq", "label")
