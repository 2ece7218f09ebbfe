"""The operators on unbounded streams: prequential learning, anchored periods and bounded sketches as state.

A micro-batch is scored with the model as it was plus what comes before within the batch, so
the votes of a stream are those of the same rows as a table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import learners as ln
from ..operators import tokens as tk
from ..operators.prefix import ordinal, prior
from ..operators.sketches import SpaceSaving
from ..operators.trajectories import WORD_PERIOD

TIMED = "seq long, ts timestamp, label int, text string"


#: Learners whose state is a word's counts and last positions, and the totals of the documents.
LEARNERS = {"mnb": ln.vanilla_scores, "mnb4sketch": ln.sketch_scores, "mnbfading": ln.fading_scores}
#: Micro-batches between two compactions of the model.
EVERY = 16

_WORDS = "word string, n0 double, n1 double, last0 long, last1 long"
_TOTALS = "n0 double, n1 double, t0 double, t1 double, last0 long, last1 long, pos long, v1 double"


class Model:
    """Word counts and totals in a folder, log-structured: every micro-batch leaves what it adds, every EVERY-th the whole.

    A batch that is run again starts from the same state; what is older than the whole before the last is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, learner: str = "mnb"):
        if learner not in LEARNERS:
            raise ValueError(f"learners of streams are {', '.join(LEARNERS)}")
        self.spark, self.folder, self.scores = spark, folder.rstrip("/"), LEARNERS[learner]

    def _words(self, batch: int) -> DataFrame:
        """The words' state after a batch."""
        whole = (batch + 1) // EVERY * EVERY - 1
        paths = [f"{self.folder}/whole-{whole}"] * (whole >= 0) + [f"{self.folder}/words-{k}" for k in range(max(0, whole + 1), batch + 1)]
        if not paths:
            return self.spark.createDataFrame([], _WORDS)
        both = self.spark.read.schema(_WORDS).parquet(*paths)
        return both.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("last0").alias("last0"), F.max("last1").alias("last1"))

    def _forget(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def learn(self, batch: DataFrame, number: int) -> DataFrame:
        """Votes for a batch whose documents come after all before; the model then holds them too."""
        counted = tk.tokens(batch)
        docs = ordinal(tk.documents(batch, counted), "seq", "pos")
        counted = counted.join(docs.select("seq", "pos"), "seq")
        totals = self.spark.read.schema(_TOTALS).parquet(f"{self.folder}/totals-{number - 1}") if number else self.spark.createDataFrame([], _TOTALS)
        zero = lambda c: F.coalesce(c, F.lit(0))
        old = totals.agg(*(zero(F.first(c)).alias(f"o_{c}") for c in ("n0", "n1", "t0", "t1", "pos")), *(F.first(c).alias(f"o_{c}") for c in ("last0", "last1", "v1")))
        first = tk.first_vocabulary(docs).select(F.col("v1").alias("f_v1"))
        known = F.broadcast(old.crossJoin(first).withColumn("v1", F.coalesce("o_v1", "f_v1")).drop("o_v1", "f_v1"))
        sums = {f"n{c}": ln._of(c, F.lit(1.0)) for c in ln.CLASSES} | {f"t{c}": ln._of(c, F.col("n")) for c in ln.CLASSES}
        last = {f"last{c}": ln._at(c) for c in ln.CLASSES}
        later = {f"last{c}": F.coalesce(F.col(f"last{c}") + F.col("o_pos"), F.col(f"o_last{c}")) for c in ln.CLASSES}
        d = prior(docs, [], "seq", sums, last).crossJoin(known)
        d = d.withColumns({k: F.col(k) + F.col(f"o_{k}") for k in sums} | later).withColumn("pos", F.col("pos") + F.col("o_pos"))
        words = self._words(number - 1).withColumnsRenamed({k: f"o_{k}" for k in ("n0", "n1", "last0", "last1")})
        w = prior(counted, ["word"], "seq", {f"c{c}": ln._of(c, F.col("x")) for c in ln.CLASSES}, last)
        w = w.join(words, "word", "left").crossJoin(known.select("o_pos"))
        w = w.withColumns({f"c{c}": F.col(f"c{c}") + F.coalesce(F.col(f"o_n{c}"), F.lit(0.0)) for c in ln.CLASSES} | later)
        out = ln.votes(self.scores(d, w.withColumn("pos", F.col("pos") + F.col("o_pos"))))

        placed = counted.crossJoin(known.select("o_pos")).withColumn("pos", F.col("pos") + F.col("o_pos"))
        new = placed.groupBy("word").agg(*(F.sum(ln._of(c, F.col("x"))).alias(f"n{c}") for c in ln.CLASSES), *(F.max(ln._at(c)).alias(f"last{c}") for c in ln.CLASSES))
        new.write.mode("overwrite").parquet(f"{self.folder}/words-{number}")
        more = docs.agg(*(F.coalesce(F.sum(x), F.lit(0.0)).alias(k) for k, x in sums.items()), *(F.max(ln._at(c)).alias(f"last{c}") for c in ln.CLASSES), zero(F.max("pos")).alias("pos"))
        more = more.crossJoin(known).select(*((F.col(k) + F.col(f"o_{k}")).alias(k) for k in sums), *(x.alias(k) for k, x in later.items()), (F.col("pos") + F.col("o_pos")).alias("pos"), "v1")
        more.write.mode("overwrite").parquet(f"{self.folder}/totals-{number}")
        if number % EVERY == EVERY - 1:
            self._words(number - 1).unionByName(self.spark.read.schema(_WORDS).parquet(f"{self.folder}/words-{number}")).groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("last0").alias("last0"), F.max("last1").alias("last1")).write.mode("overwrite").parquet(f"{self.folder}/whole-{number}")
            for k in range(number - 2 * EVERY + 1, number - EVERY + 1):
                self._forget(f"words-{k}")
                self._forget(f"totals-{k - 1}")
            self._forget(f"whole-{number - 2 * EVERY}")
        return out


def learn_stream(stream: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], learner: str = "mnb", **trigger) -> StreamingQuery:
    """Start a query that votes on every micro-batch of ``stream`` and hands the votes to ``sink``."""
    model = Model(stream.sparkSession, folder, learner)

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            sink(model.learn(kept, number), number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def anchored_stream(rows: DataFrame, period: int = WORD_PERIOD) -> DataFrame:
    """(word, period_id, t_open, t_close, close_seq, n0, n1) of a stream ``rows(word, seq, s, n0, n1)``.

    Rows of a word must come in order; those within a micro-batch are sorted.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["s", "seq"])
        number, anchor, n0, n1 = state.get if state.exists else (0, int(pdf["s"].iloc[0]), 0.0, 0.0)
        out = []
        for seq, s, a, b in zip(pdf["seq"], pdf["s"], pdf["n0"], pdf["n1"]):
            n0, n1 = n0 + a, n1 + b
            if s - anchor > period:
                out.append((key[0], number, anchor, int(s), int(seq), n0, n1))
                number, anchor, n0, n1 = number + 1, int(s), 0.0, 0.0
        state.update((number, anchor, n0, n1))
        yield pd.DataFrame(out, columns=["word", "period_id", "t_open", "t_close", "close_seq", "n0", "n1"])

    schema = "word string, period_id long, t_open long, t_close long, close_seq long, n0 double, n1 double"
    return rows.groupBy("word").applyInPandasWithState(fold, schema, "number long, anchor long, n0 double, n1 double", "append", GroupStateTimeout.NoTimeout)


def sketch_stream(counted: DataFrame, capacity: int, lanes: int = 1) -> DataFrame:
    """(lane, slot, word, count, n): the sketch of every lane after each micro-batch that touched it; n numbers a lane's updates."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, sketch = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, SpaceSaving(-(-capacity // lanes)))
        pdf = pd.concat(list(parts)).sort_values(["seq", "word"])
        for word, x in zip(pdf["word"], pdf["x"]):
            sketch.add(word, x)
        state.update((n + 1, pickle.dumps(sketch)))
        yield pd.DataFrame([(key[0], sketch.slot[w], w, c, n + 1) for w, c in sketch.count.items()], columns=["lane", "slot", "word", "count", "n"])

    keyed = counted.withColumn("lane", F.pmod(F.xxhash64("word"), F.lit(lanes)).cast("int"))
    return keyed.groupBy("lane").applyInPandasWithState(fold, "lane int, slot int, word string, count double, n long", "n long, sketch binary", "update", GroupStateTimeout.NoTimeout)
