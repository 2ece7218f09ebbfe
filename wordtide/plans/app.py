"""Runs from a configuration or the command line: which learner, which evaluation, over which stream, into which folder."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensembles, evaluation, forecasts, learners, sketches, trajectories, windows
from ..operators import tokens as tk
from ..operators.settle import settled
from ..sinks import reports
from ..sources import lexicons, streams
from ..streaming import prequential

MODES = ("preprocess", "offline", "online")
SCHEMES = ("prequential", "holdout")

#: Each takes the stream, and the tokens that it may see.
LEARNERS: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] = {
    "mnb": learners.vanilla,
    "mnb4sketch": learners.sketch_form,
    "mnb4timeseries": learners.time_series,
    "mnbfading": learners.fading,
    "mnbaggressive": learners.aggressive,
}


def learner(name: str, capacity: int | None = sketches.CAPACITY) -> Callable[[DataFrame], DataFrame]:
    """The pipeline of a learner's name; ``ensemble_N`` averages plain learners over N sliding windows.

    Learners stand behind a bounded sketch of ``capacity`` words and forget what it evicts; without a capacity they see all words.
    """
    bare = _learner(name)
    if capacity is None:
        return lambda stream: bare(stream, None)
    return lambda stream: bare(stream, settled(sketches.sketched(settled(tk.tokens(stream)), capacity)))


def _learner(name: str) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    lower = name.lower()
    if lower in LEARNERS:
        return LEARNERS[lower]
    if (n := base_learners(lower)) is not None:
        if n == 1:
            return learners.vanilla
        spans = {f"w{k}": s for k, s in enumerate(windows.SPANS[:n], 1)}
        if n == len(spans):
            return lambda stream, counted: ensembles.average(ensembles.sliding_votes(stream, spans, counted))
        raise ValueError(f"an ensemble has at most {len(windows.SPANS)} windows")
    raise ValueError(f"unknown learner {name}; known are {', '.join(LEARNERS)} and ensemble_N")


def base_learners(name: str) -> int | None:
    """N of ``ensemble_N``, or None."""
    head, _, n = name.partition("_")
    return int(n) if head == "ensemble" and n.isdigit() and int(n) > 0 else None


@dataclass(frozen=True)
class Run:
    mode: str
    data: str = ""
    scheme: str | None = None
    learner: str | None = None
    label: str = "toxic"
    output: str | None = None
    capacity: int = sketches.CAPACITY
    track: str = ""
    verbs: str | None = None
    antonyms: str | None = None
    colloquial: str | None = None

    def problems(self) -> list[str]:
        """What is wrong with the configuration."""
        out = []
        if self.mode not in MODES:
            out.append(f"mode must be one of {', '.join(MODES)}")
        if self.scheme is not None and self.scheme not in SCHEMES:
            out.append(f"scheme must be one of {', '.join(SCHEMES)}")
        if self.mode in ("offline", "online") and not (self.learner and self.scheme):
            out.append("evaluation needs a learner and a scheme")
        if self.mode in ("offline", "online") and not self.data:
            out.append("evaluation needs data")
        if self.mode == "online" and (self.scheme == "holdout" or self.learner not in prequential.LEARNERS or not self.output):
            out.append(f"online evaluation is prequential, of {', '.join(prequential.LEARNERS)}, and needs an output folder")
        if self.mode == "preprocess" and (self.learner or self.scheme):
            out.append("preprocessing takes no learner and no scheme")
        if self.learner:
            try:
                _learner(self.learner)
            except ValueError as wrong:
                out.append(str(wrong))
        return out


@dataclass(frozen=True)
class Result:
    """The tables of an evaluation."""

    votes: DataFrame
    metrics: DataFrame
    reports: dict[str, DataFrame]


def evaluate(stream: DataFrame, name: str, scheme: str = "prequential", capacity: int | None = sketches.CAPACITY, tracked: Sequence[str] = ()) -> Result:
    """Votes of a learner on a stream, with all reports: of an ensemble those of its base learners too, of ``tracked`` words their forecasts."""
    votes = settled(learners.holdout(stream) if scheme == "holdout" else learner(name, capacity)(stream))
    measured = settled(evaluation.windowed(votes))
    tables = {
        "daily_performance": evaluation.anchored_daily(measured, stream).withColumn("start", reports.dated(F.timestamp_seconds("start"))),
        "significance": evaluation.significance(votes),
        "statistics": evaluation.metrics(evaluation.confusion(votes)),
        "window_counts": windows.sliding(stream, windows.SPANS[-1]),
        **{f"class_counts_{p}": windows.anchored_counts(stream, p).withColumn("start", reports.dated(F.timestamp_seconds("start"))) for p in ("day", "week", "month")},
    }
    if scheme == "prequential" and (base_learners(name.lower()) or 0) > 1:
        each = ensembles.sliding_votes(stream)
        weights = ensembles.g_mean_weights(each, stream)
        tables |= {"base_learners": evaluation.by_learner(each, stream), "base_learner_weights": weights, "diversity": evaluation.pairwise(each)}
    if tracked:
        tables["forecasts"] = forecasts.tracked(trajectories.anchored(trajectories.occurrences(tk.tokens(stream))), tracked)
    return Result(votes, tables["statistics"], tables)


def follow(spark: SparkSession, config: Run) -> Result:
    """Evaluate online: documents are read as a stream and voted on by micro-batch; votes, model and progress stay in the output folder."""
    votes = f"{config.output}/votes"
    live = streams.live_stream(spark, config.data, config.label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{votes}/batch={number}")

    query = prequential.learn_stream(live, f"{config.output}/model", f"{config.output}/progress", keep, config.learner)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    done = spark.read.schema("seq long, label int, p0 double, p1 double, pred int").parquet(votes)
    measured = evaluation.metrics(evaluation.confusion(done))
    return Result(done, measured, {"statistics": measured})


def run(spark: SparkSession, config: Run) -> Result | DataFrame:
    """Do what a valid configuration says; reports are written where it names a folder."""
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    stream = streams.labelled_stream(spark, config.data, config.label)
    if config.mode == "online":
        return follow(spark, config)
    if config.mode == "preprocess":
        from ..functions import text

        # lexicon files are small; without them the lists of our own are used
        given = {}
        if config.verbs:
            given["verbs"] = [r["key"] for r in lexicons.keys(spark, config.verbs).collect()]
        if config.antonyms:
            given["antonyms"] = {r["word"]: r["opposite"] for r in lexicons.opposites(spark, config.antonyms).collect()}
        if config.colloquial:
            given["terms"] = {r["key"]: r["value"] for r in lexicons.key_values(spark, config.colloquial).collect()}
        cleaned = stream.withColumn("text", text.stemmed(text.clean(F.col("text"), **given)))
        if config.output:
            reports.write(cleaned, config.output, "parquet")
        return cleaned
    result = evaluate(stream, config.learner, config.scheme, config.capacity or None, config.track.split())
    if config.output:
        reports.write_all(result.reports, config.output)
    return result


def parse(args: Sequence[str] | None = None) -> Run:
    p = argparse.ArgumentParser(description="Evaluate learners on a stream of labelled texts.")
    p.add_argument("mode", choices=MODES)
    p.add_argument("--data", default="", help="folder with the tables")
    p.add_argument("--scheme", choices=SCHEMES)
    p.add_argument("--learner", help=f"{', '.join(LEARNERS)} or ensemble_N")
    p.add_argument("--label", default="toxic", choices=("toxic", "quality"))
    p.add_argument("--capacity", type=int, default=sketches.CAPACITY, help="words of the sketch in front of the learner; 0 for none")
    p.add_argument("--track", default="", help="words whose forecasts are reported, with spaces between them")
    for name in ("verbs", "antonyms", "colloquial"):
        p.add_argument(f"--{name}", help="lexicon file for preprocessing, in the place of our own list")
    p.add_argument("--output", help="folder for the reports; it must not exist")
    config = Run(**vars(p.parse_args(args)))
    if problems := config.problems():
        p.error("; ".join(problems))
    return config


def main(args: Sequence[str] | None = None) -> None:
    config = parse(args)
    done = run(SparkSession.builder.getOrCreate(), config)
    (done.metrics if isinstance(done, Result) else done).show()


if __name__ == "__main__":
    main()
