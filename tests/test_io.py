"""Readers, sinks, streaming and the command line."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordtide.operators import learners, sketches, trajectories, windows
from wordtide.operators import tokens as tk
from wordtide.plans import app
from wordtide.sinks import reports
from wordtide.sources import lexicons, streams
from wordtide.streaming import prequential

DATA = "/root/testdata/sf0.001"


def test_load_stream(spark, tmp_path):
    (tmp_path / "in.csv").write_text("class,text,timestamp\nham,b c,2024-01-02 00:00:00\nspam,a,2024-01-01 00:00:01\n?,x,no time\n")
    config = streams.StreamConfig("csv", {"header": "true"}, str(tmp_path / "in.csv"))
    rows = streams.load_stream(spark, config).orderBy("seq").collect()
    assert [(r["label"], r["text"]) for r in rows] == [(None, "x"), (0, "a"), (1, "b c")]
    part = streams.load_stream(spark, streams.StreamConfig("csv", {"header": "true"}, str(tmp_path / "in.csv"), limit=1, offset=1)).collect()
    assert [r["text"] for r in part] == ["a"]
    a = streams.random_order(spark.range(50).withColumnRenamed("id", "k"), "k", 3)
    assert sorted(r["position"] for r in a.collect()) == list(range(1, 51))


def test_lexicons(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {r[0] for r in lexicons.keys(spark, file("k", "go\nrun\n\ngo\n")).collect()} == {"go", "run"}
    assert sorted(map(tuple, lexicons.key_values(spark, file("kv", "u::you\nx:: skip\nomg::oh my\n")).collect())) == [("omg", "oh my"), ("u", "you")]
    assert dict(map(tuple, lexicons.opposites(spark, file("o", "good\nbad\nup\ndown\n")).collect())) == {"good": "bad", "bad": "good", "up": "down", "down": "up"}
    w = lexicons.word_sentiment(spark, file("w", "a\t1\t2\t3\t4\nb\tx\ty\tz\n"))
    assert [(r["word"], r["pos"], r["neg"]) for r in w.collect()] == [("a", 3, 4)]
    d = lexicons.document_scores(spark, file("d", "1,n\ta\t0.5\t0.1\n1,n\ta\t9\t9\n2,v\tthe\t1\t1\n"), ["the"])
    assert [tuple(r) for r in d.collect()] == [(1, "n", "a", 0.5, 0.1)]
    assert {r[0] for r in lexicons.entities(spark, file("e", "Foo\t1\nbar\n")).collect()} == {"foo", "bar"} == {r[0] for r in lexicons.entities(spark, ["FOO", "bar"]).collect()}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")
    reports.write_all({"forecasts": df, "plain": df}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/forecasts").count() == 2 and (tmp_path / "out/forecasts/word=a").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        reports.write(df, str(tmp_path / "out/plain"))
    assert reports.elapsed(3725.5) == "01:02:05"
    log = reports.RunLog()
    log.add("read", "ok")
    assert log.table(spark).first()["step"] == "read"


@pytest.mark.parametrize(("learner", "method"), [("mnb", learners.vanilla), ("mnb4sketch", learners.sketch_form), ("mnbfading", learners.fading)])
def test_stream_gives_what_the_table_gives(spark, monkeypatch, tmp_path, learner, method):
    monkeypatch.setattr(prequential, "EVERY", 2)
    table = streams.labelled_stream(spark, DATA).orderBy("seq").collect()
    cuts = [table[:20], table[20:50], table[50:]]
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, prequential.TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)
    stream = spark.readStream.schema(prequential.TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    votes = []
    q = prequential.learn_stream(stream, str(tmp_path / "model"), str(tmp_path / "check"), lambda df, n: votes.extend(map(tuple, df.collect())), learner)
    q.awaitTermination(300)
    want = {r["seq"]: r for r in method(streams.labelled_stream(spark, DATA)).collect()}
    assert len(votes) == len(want)
    for seq, label, p0, p1, pred in votes:
        assert (label, pred) == (want[seq]["label"], want[seq]["pred"]) and p0 == pytest.approx(want[seq]["p0"], abs=1e-9)


def _run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_stateful_streams(spark, tmp_path):
    rows = [("w", k, k * 25, float(k % 2), float(k % 3)) for k in range(40)] + [("v", 100 + k, k * 100, 1.0, 0.0) for k in range(5)]
    schema = "word string, seq long, s long, n0 double, n1 double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    got = _run(spark, prequential.anchored_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))), "periods", "append", tmp_path)
    want = trajectories.anchored(df)
    key = lambda t: sorted(map(tuple, t.select("word", "period_id", "t_open", "t_close", "close_seq", "n0", "n1").collect()))
    assert key(got) == key(want)

    tokens = spark.createDataFrame([(k, f"w{k * 7 % 30}", 1.0) for k in range(200)], "seq long, word string, x double")
    tokens.coalesce(1).write.parquet(str(tmp_path / "tokens"))
    live = spark.readStream.schema(tokens.schema).parquet(str(tmp_path / "tokens"))
    got = _run(spark, prequential.sketch_stream(live, 12), "sketch", "update", tmp_path)
    assert {(r["word"], r["count"]) for r in got.collect()} == {(r["word"], r["n"]) for r in sketches.survivors(sketches.space_saving(tokens, 12)).collect()}


def test_watermarked_windows(spark, tmp_path):
    table = streams.labelled_stream(spark, DATA)
    table.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, windows.tumbling(live, "6 hours", "12 hours"), "tumbling", "complete", tmp_path)
    key = lambda t: sorted((r["start"], r["n0"], r["n1"]) for r in t.collect())
    assert key(got) == key(windows.tumbling(table, "6 hours"))


def test_app(spark, tmp_path):
    assert app.Run("offline", DATA, "prequential", "ensemble_2").problems() == []
    for wrong in (app.Run("fly"), app.Run("offline", DATA, "prequential"), app.Run("offline", "", "holdout", "mnb"), app.Run("preprocess", DATA, None, "mnb"), app.Run("online", DATA, "other", "mnb"), app.Run("offline", DATA, "holdout", "tree"), app.Run("offline", DATA, "holdout", "ensemble_9")):
        assert wrong.problems()
    with pytest.raises(ValueError):
        app.run(spark, app.Run("fly"))
    with pytest.raises(SystemExit):
        app.parse(["offline", "--learner", "tree"])
    config = app.parse(["offline", "--data", DATA, "--scheme", "holdout", "--learner", "mnb", "--output", str(tmp_path / "out")])
    result = app.run(spark, config)
    assert result.metrics.first()["accuracy"] > 0 and (tmp_path / "out/daily_performance").exists()
    assert app.run(spark, app.Run("preprocess", DATA)).filter(F.col("text").rlike("[A-Z]{4}")).count() >= 0
    assert app.base_learners("ensemble_3") == 3 and app.base_learners("mnb") is None


def test_online(spark, tmp_path):
    """Documents read as a stream get the votes of the batch."""
    config = app.parse(["online", "--data", DATA, "--scheme", "prequential", "--learner", "mnb", "--output", str(tmp_path / "out")])
    got = {r["seq"]: r for r in app.run(spark, config).votes.collect()}
    want = {r["seq"]: r for r in learners.vanilla(streams.labelled_stream(spark, DATA)).collect()}
    assert got.keys() == want.keys() and all(got[k]["p0"] == pytest.approx(want[k]["p0"], abs=1e-9) for k in want)
    assert app.Run("online", "", "prequential", "mnb", output="x").problems() and app.Run("online", DATA, "prequential", "mnb4timeseries", output="x").problems()


def test_reports_of_an_ensemble(spark):
    stream = streams.labelled_stream(spark, DATA).filter("seq < 60")
    tables = app.evaluate(stream, "ensemble_2", tracked=("the",)).reports
    assert {"base_learners", "base_learner_weights", "diversity", "forecasts", "window_counts"} <= set(tables)
    assert tables["base_learners"].count() and tables["base_learner_weights"].count() and tables["window_counts"].count()


def test_library_stands_without_the_training_data_operators(tmp_path):
    """The entry imports when that subpackage is gone, and other import errors are not hidden."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "wordtide", tmp_path / "wordtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'prequential_mnb' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1_') for k in e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
