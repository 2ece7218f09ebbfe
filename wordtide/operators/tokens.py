"""Tokens, term frequencies and document lengths of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ordinal, prior


def _runs(words: Column) -> Column:
    """(word, x) for every distinct word of an array; an empty array gives none.

    The words are sorted and cut where one differs from the word before. A lambda's parameter is computed once, unlike a
    column that a lambda refers to.
    """
    first = lambda w: F.filter(F.transform(w, lambda t, i: F.when((i == 0) | (t != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
    run = lambda w, at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("double").alias("x")))
    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(words)), lambda w: F.transform(F.array(first(w)), lambda at: run(w, at)))))


def tokens(stream: DataFrame) -> DataFrame:
    """(seq, ts, label, word, x): how often each lower-case word, split at single spaces, stands in a document.

    Words are counted within their document, so no task holds a table of the words of all its documents.
    """
    whole = stream.groupBy("seq", "ts", "label").agg(F.array_join(F.collect_list(F.lower(F.rtrim("text"))), " ").alias("text"))
    words = F.filter(F.split("text", " "), lambda t: t != "")
    return whole.select("seq", "ts", "label", F.inline(_runs(words)))


def documents(stream: DataFrame, counted: DataFrame) -> DataFrame:
    """(seq, ts, label, n, v): tokens and distinct words of every document; one without a word has zeros."""
    sizes = counted.groupBy("seq").agg(F.sum("x").alias("n"), F.count("*").alias("v"))
    zero = F.lit(0)
    return stream.select("seq", "ts", "label").join(sizes, "seq", "left").select("seq", "ts", "label", F.coalesce("n", zero).cast("double").alias("n"), F.coalesce("v", zero).alias("v"))


def running_tfidf(stream: DataFrame) -> DataFrame:
    """(seq, word, x, tf, idf, tfidf) with the documents and occurrences seen up to and with each document.

    The length of a document counts empty tokens; idf is log10(documents / (occurrences + 1)).
    """
    counted = tokens(stream)
    sized = ordinal(stream.select("seq", F.size(F.split(F.rtrim("text"), " ")).alias("len")), "seq", "docs")
    seen = prior(counted.select("seq", "word", "x"), ["word"], "seq", {"before": F.col("x")})
    tf, idf = F.col("x") / F.col("len"), F.log10(F.col("docs") / (F.col("before") + F.col("x") + 1))
    return seen.join(sized, "seq").select("seq", "word", "x", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tfidf"))


def bag_of_words(stream: DataFrame, keep: int) -> DataFrame:
    """Word counts of the ``keep`` most frequent words (of ties the first in the alphabet)."""
    counted = tokens(stream)
    total = counted.groupBy("word").agg(F.sum("x").alias("total"))
    top = total.orderBy(F.desc("total"), "word").limit(keep)
    return counted.join(top.select("word"), "word", "left_semi")


def first_vocabulary(docs: DataFrame) -> DataFrame:
    """One row (v1): the number of distinct words of the first document."""
    return docs.agg(F.min_by("v", "seq").cast("double").alias("v1"))

