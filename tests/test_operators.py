"""Operators on small inputs with results computed by hand or by plain loops."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.functions import text as tx
from wordtide.functions.stemmer import stem
from wordtide.operators import ensembles, evaluation, forecasts, learners, lexical, prefix, sketches, trajectories, windows
from wordtide.operators import tokens as tk

STREAM = "seq long, ts timestamp, label int, text string"
VOTES = "seq long, label int, p0 double, p1 double, pred int"


def stream(spark, rows, start=datetime(2024, 1, 1)):
    """From (seq, second, label, text)."""
    df = spark.createDataFrame(rows, "seq long, s long, label int, text string")
    return df.select("seq", F.timestamp_seconds(F.col("s") + int(start.timestamp())).alias("ts"), "label", "text")


@pytest.fixture(scope="module")
def noisy():
    r = random.Random(1)
    words = "a b c d e f g h".split()
    t, rows = 0, []
    for i in range(120):
        t += r.choice((0, 1, 20, 45, 90, 4000))
        rows.append((i * 3, t, r.randrange(2), " ".join(r.choice(words) for _ in range(r.randint(0, 6)))))
    return rows


def test_prior_state_by_hand(spark):
    s = stream(spark, [(1, 0, 0, "a a b"), (2, 1, 1, "b c"), (3, 2, 0, "a b")])
    last = {r["seq"]: r for r in learners.scores_vanilla(s).collect()}[3]
    assert (last["s0"], last["s1"]) == pytest.approx((-1.406914, -2.197225), abs=1e-6)
    assert {r["seq"]: r["p0"] for r in learners.vanilla(s).collect()}[3] == pytest.approx(0.687898, abs=1e-6)
    assert {r["seq"]: r["p0"] for r in learners.sketch_form(s).collect()}[3] == pytest.approx(0.719101, abs=1e-6)


def test_prior_in_blocks(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), k, float(r.randrange(9))) for k in r.sample(range(400), 150)] + [(None, 5, 1.0), (None, 9, 2.0)]
    got = prefix.prior(spark.createDataFrame(rows, "k int, o long, x double"), ["k"], "o", {"t": F.col("x")}, {"m": F.col("x")}, block=16).collect()
    assert len(got) == len(rows)
    for g in got:
        before = [x for k, o, x in rows if k == g["k"] and o < g["o"]]
        assert g["t"] == sum(before) and g["m"] == (max(before) if before else None)


def test_aggressive_and_fading_loops(spark, noisy):
    """The decayed learners as loops over the documents."""
    got = {k: {r["seq"]: (r["p0"], r["p1"]) for r in f(stream(spark, noisy)).collect()} for k, f in (("f", learners.fading), ("a", learners.aggressive))}
    v1 = len(set(noisy[0][3].split()))
    n, t, last = [0, 0], [0, 0], [0, 0]
    c, seen = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for pos, (seq, _, label, text) in enumerate(noisy, 1):
        w = text.split()
        if pos > 1:
            f = lambda then: 2 ** (-0.1 * (pos - 1 - then) / 100)
            p = [(1 + n[k]) * f(last[k]) for k in (0, 1)]
            q = [(v1 - 1 + t[k]) * f(last[k]) for k in (0, 1)]
            score = []
            for k in (0, 1):
                x = math.log((p[k] + 1) / (sum(p) + 2)) - len(w) * math.log((q[k] + 1) / (sum(q) + 2))
                for u in w:
                    m = [(1 + c[u][j]) * f(seen[u][j]) if c[u][j] else 0 for j in (0, 1)]
                    x += math.log((m[k] + 1) / (sum(m) + 2))
                score.append(x)
            assert got["f"][seq][0] == pytest.approx(1 / (1 + math.exp(score[1] - score[0])), abs=1e-9)
        n[label] += 1
        t[label] += len(w)
        last[label] = pos
        for u in w:
            c[u][label] += 1
            seen[u][label] = pos
    assert set(got["a"]) == set(got["f"])


def test_windowed_learner_loop(spark, noisy):
    """Un-learning: only documents that the window of the document before still holds."""
    span = 100
    got = {r["seq"]: r["p0"] for r in learners.windowed(stream(spark, noisy), span).collect()}
    v1 = len(set(noisy[0][3].split()))
    for k in range(1, len(noisy)):
        seq, _, _, text = noisy[k]
        held = [d for d in noisy[:k] if d[1] >= noisy[k - 1][1] - span]
        w, score = text.split(), []
        for c in (0, 1):
            mine = [d[3].split() for d in held if d[2] == c]
            total = sum(map(len, mine))
            score.append(math.log(1 + len(mine)) - len(w) * math.log(v1 + 2 + total) + sum(math.log(1 + sum(m.count(u) for m in mine)) for u in w))
        assert got[seq] == pytest.approx(1 / (1 + math.exp(score[1] - score[0])), abs=1e-9)


def test_time_series_learner_without_history_is_undecided(spark):
    got = learners.time_series(stream(spark, [(1, 0, 0, "a"), (2, 0, 1, "b")])).collect()
    assert sorted((r["seq"], r["p0"], r["p1"]) for r in got) == [(1, 0.0, 0.0), (2, 0.5, 0.5)]


def test_time_series_learner_loop(spark, noisy):
    """Forecasts as of each document, replayed period by period with two of the experts."""
    names = ("poisson", "ewma")
    got = {r["seq"]: r["p0"] for r in learners.time_series(stream(spark, noisy), names).collect()}

    class Series:
        def __init__(self, period):
            self.period, self.anchor, self.open, self.closed = period, None, [0, 0], []
            self.loss, self.said, self.out = {}, {}, (0.0, 0.0)

        def add(self, s, n):
            if self.anchor is None:
                self.anchor = s
            self.open = [a + b for a, b in zip(self.open, n)]
            if s - self.anchor > self.period:
                self.closed.append(self.open)
                self.anchor, true, self.open = s, self.open, [0, 0]
                out = []
                for c in (0, 1):
                    y = [p[c] for p in self.closed]
                    new = {"poisson": sum(y) / len(y), "ewma": 0.0}
                    for v in y[-22:]:
                        new["ewma"] = 0.1 * new["ewma"] + 0.9 * v
                    k = len(y[-22:])
                    new["ewma"] /= (1 - 0.9**k) / 0.9
                    for e in names:
                        self.loss[e, c] = self.loss.get((e, c), 0) + (true[c] - self.said.get((e, c), 0)) ** 2
                        self.said[e, c] = min(new[e], 5)
                    w = [math.exp(-self.loss[e, c] / 50) for e in names]
                    out.append(sum(a * self.said[e, c] for a, e in zip(w, names)) / sum(w))
                self.out = tuple(out)

    words, classes = defaultdict(lambda: Series(60)), Series(1)
    for k, (seq, s, label, text) in enumerate(noisy):
        if k:
            ratio = lambda f: math.log((f[0] + 1) / (f[1] + 1))
            d = ratio(classes.out) + sum(ratio(words[u].out) for u in text.split())
            assert got[seq] == pytest.approx(1 / (1 + math.exp(-d)), abs=1e-9)
        one = [1 - label, label]
        classes.add(s, one)
        for u in sorted(set(text.split())):
            words[u].add(s, [x * text.split().count(u) for x in one])


def test_space_saving(spark):
    s = sketches.SpaceSaving(2)
    assert [s.add(w, 1) for w in "abac"] == [(0, None), (1, None), (0, None), (1, "b")]
    assert s.count == {"a": 2, "c": 2} and s.slot == {"a": 0, "c": 1}
    r = random.Random(0)
    rows = [(i, i, 0, r.choice("abcdefghij") + str(r.randrange(8))) for i in range(400)]
    counted = tk.tokens(stream(spark, rows))
    exact = {x["word"]: x["n"] for x in sketches.top_words(counted, 10**6).collect()}
    for lanes in (1, 4):
        bound = {x["word"]: x["n"] for x in sketches.survivors(sketches.space_saving(counted, 20, lanes)).collect()}
        assert len(bound) <= 20 + lanes and all(n >= exact[w] for w, n in bound.items())
        whole = {x["word"]: x["n"] for x in sketches.survivors(sketches.space_saving(counted, 10_000, lanes)).collect()}
        assert whole == exact
    stays = sketches.space_saving(counted, 20)
    epochs = sketches.with_epochs(counted, stays).collect()
    starts = defaultdict(list)
    for x in stays.collect():
        starts[x["word"]].append(x["from_seq"])
    assert all(e["epoch"] == max(1, sum(f <= e["seq"] for f in starts[e["word"]])) for e in epochs)


def test_adwin_drops_the_past():
    w = sketches.Adwin(0.01)
    for x in [0.0] * 300 + [5.0] * 300:
        w.add(x)
    assert w.n < 400 and w.mean > 4.5
    steady = sketches.Adwin(0.01)
    for _ in range(500):
        steady.add(2.0)
    assert steady.n == 500 and steady.mean == 2.0


def test_adwin_counts_zeros(spark):
    rows = [(i, i, 0, "a" if i < 5 else "b") for i in range(10)]
    s = stream(spark, rows)
    got = {r["word"]: r for r in sketches.adwin_counts(tk.tokens(s), s, 5).collect()}
    assert got["a"]["mean"] == pytest.approx(0.5) and got["a"]["width"] == 10 and got["b"]["width"] == 5 and got["b"]["mean"] == 1.0


def test_anchored_periods(spark):
    rows = [("w", 1, 0, 1.0, 0.0), ("w", 2, 30, 0.0, 2.0), ("w", 3, 61, 1.0, 0.0), ("w", 4, 100, 0.0, 1.0), ("w", 5, 121, 1.0, 0.0), ("w", 6, 122, 1.0, 0.0), ("v", 7, 0, 1.0, 0.0)]
    got = trajectories.anchored(spark.createDataFrame(rows, "word string, seq long, s long, n0 double, n1 double"), 60).collect()
    assert [(r["period_id"], r["t_open"], r["t_close"], r["close_seq"], r["n0"], r["n1"]) for r in sorted(got, key=lambda r: r["period_id"])] == [(0, 0, 61, 3, 2, 2), (1, 61, 122, 6, 2, 1)]


def test_trajectory_helpers(spark):
    rows = spark.createDataFrame([("w", 1, 10, 1.0, 0.0), ("w", 2, 50, 0.0, 1.0)], "word string, seq long, s long, n0 double, n1 double")
    assert trajectories.tail(rows, 60, 20).count() == 1 and trajectories.between(rows, 10, 49).count() == 1
    words = spark.createDataFrame([("w",), ("x",)], "word string")
    assert sorted((r["word"], r["s"]) for r in trajectories.or_zero(words, rows, 99).collect()) == [("w", 10), ("w", 50), ("x", 99)]
    assert trajectories.without_words(rows, words).count() == 0


def test_experts(spark):
    schema = "word string, period_id long, t_first long, t_open long, t_close long, close_seq long, n0 double, n1 double"
    week = 604_800
    p = spark.createDataFrame([("w", 0, 0, 0, 100, 1, 1.0, 0.0), ("w", 1, 0, 100, week + 5, 2, 3.0, 4.0)], schema)
    last = lambda df: df.filter("period_id = 1").first()
    assert last(forecasts.poisson(p))["poisson_0"] == 2.0
    assert last(forecasts.seasonal(p))["seasonal_0"] == pytest.approx(1.631579, abs=1e-6)
    two = spark.createDataFrame([("w", 0, 0, 0, 1, 1, 2.0, 0.0), ("w", 1, 0, 1, 2, 2, 4.0, 0.0)], schema)
    assert last(forecasts.ewma(two))["ewma_0"] == pytest.approx(17.905263, abs=1e-6)
    assert last(forecasts.experts(two, ("ewma", "nothing")))["ewma_0"] == 5.0
    assert last(forecasts.experts(two, ("ewma", "nothing")))["nothing_1"] == -1.0


def test_recent_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(forecasts, "BLOCK", 10)
    df = spark.range(57).selectExpr("'w' AS word", "id AS i")
    got = forecasts.recent(df, ["word"], "i", 4, {"v": F.col("i")}).collect()
    assert all(r["v"] == list(range(max(0, r["i"] - 3), r["i"] + 1)) for r in got) and len(got) == 57


def test_weights_are_multiplicative(spark):
    r = random.Random(2)
    schema = "word string, period_id long, t_first long, t_open long, t_close long, close_seq long, n0 double, n1 double"
    rows = [("w", k, 0, k, k + 1, k, float(r.randrange(6)), float(r.randrange(3))) for k in range(40)]
    names = ("poisson", "ewma")
    done = sorted(forecasts.weighted(forecasts.experts(spark.createDataFrame(rows, schema), names), names).collect(), key=lambda x: x["period_id"])
    w, said = np.full(2, 0.5), np.zeros(2)
    for x in done:
        w = w * np.exp(-((x["n0"] - said) ** 2) / 50)
        w /= w.sum()
        said = np.array([x["poisson_0"], x["ewma_0"]])
        assert [x["w_poisson_0"], x["w_ewma_0"]] == pytest.approx(w, abs=1e-9)
    one = np.exp(-((np.arange(1, 5) - 2.0) ** 2) / 50) / 4
    assert one / one.sum() == pytest.approx([0.252400, 0.257499, 0.252400, 0.237701], abs=1e-6)


def test_arima_finds_its_coefficients():
    rng = np.random.default_rng(0)
    y, d, e = [1000.0], 0.0, 0.0
    for _ in range(400):
        new = rng.normal()
        d, e = 0.7 * d + new + 0.2 * e, new
        y.append(y[-1] + d)
    y = np.array(y)
    said = np.array([forecasts.arima_fit(np.diff(y[k - 100 : k])[None], y[k - 1 : k])[0] for k in range(150, 400)])
    true = y[150:400]
    assert np.abs(said - true).mean() < 0.85 * np.abs(true - y[149:399]).mean()
    assert forecasts.arima_fit(np.zeros((1, 5)), np.array([3.0]))[0] == 3.0


def test_poisson_draw(spark):
    df = spark.range(20_000).select(forecasts.poisson_draw(F.lit(2.5), F.col("id")).alias("k"))
    m = df.agg(F.avg("k"), F.var_samp("k")).first()
    assert m[0] == pytest.approx(2.5, abs=0.06) and m[1] == pytest.approx(2.5, abs=0.15)


def test_metrics(spark):
    votes = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 4 + [(1, 0)] * 2
    df = spark.createDataFrame([(k, a, 0.0, 0.0, b) for k, (a, b) in enumerate(votes)], VOTES)
    m = evaluation.metrics(evaluation.confusion(df)).first()
    assert (m["accuracy"], m["recall"], m["specificity"], m["precision"], m["f1"]) == pytest.approx((70, 75, 66.666667, 60, 66.666667), abs=1e-5)
    none = evaluation.metrics(evaluation.confusion(spark.createDataFrame([], VOTES))).first()
    assert (none["accuracy"], none["f1"], none["kappa"], none["g_mean"]) == (0, 1e-5, 0, 100)


def test_faded_mean(spark):
    r = random.Random(4)
    x = [r.random() for _ in range(900)]
    df = spark.createDataFrame([(k + 1, v) for k, v in enumerate(x)], "pos long, x double")
    for factor in (0.9, 0.1):
        got = {g["pos"]: g["f"] for g in evaluation.faded(df, "pos", "x", factor, "f").collect()}
        top = below = 0.0
        for k, v in enumerate(x, 1):
            top, below = factor * top + v, factor * below + 1
            assert got[k] == pytest.approx(top / below, abs=1e-9)


def test_windows(spark):
    s = stream(spark, [(1, 0, 0, "a"), (2, 3 * 86_400, 1, "b")])
    assert sorted((str(r["start"]), r["n0"], r["n1"]) for r in windows.class_counts(s, "day").collect()) == [("2024-01-01", 1, 0), ("2024-01-02", 0, 0), ("2024-01-03", 0, 0), ("2024-01-04", 0, 1)]
    hours = spark.createDataFrame([(h,) for h in (2, 5, 6, 21, 22, 1)], "h int")
    shift = windows.shift_index(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), "h", F.lit(0), F.lit(0)))
    assert [r[0] for r in hours.select(shift).collect()] == [0, 0, 1, 4, 5, 5]
    back = spark.range(1).select(windows.back(F.timestamp_seconds(F.lit(1_709_164_800)), 1, "month").cast("string"), windows.back(F.timestamp_seconds(F.lit(100)), 2, "minute").cast("long")).first()
    assert back[0] == "2024-01-29 00:00:00" and back[1] == -20
    units = [windows.whole_units(F.timestamp_seconds(F.lit(200_000)), F.timestamp_seconds(F.lit(0)), u) for u in ("minute", "day", "month", "millisecond", "fortnight")]
    assert tuple(spark.range(1).select(*units).first()) == (3333, 2, 0, 200_000_000, 0)


def test_empty_stream(spark):
    none = spark.createDataFrame([], STREAM)
    for f in (learners.vanilla, learners.fading, learners.aggressive, learners.time_series, learners.holdout, lambda s: learners.windowed(s, 60)):
        assert f(none).count() == 0
    assert windows.class_counts(none, "day").count() == 0


def test_text(spark):
    one = lambda f, *texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(tx.split_words(F.col("t")))).collect()]
    assert one(tx.negations, "it is not bad", "do n't like it", "not so good x", "not the table", "not", "nor very", "knot not bad") == [
        ["it", "is", "good"], ["do", "NOTlike", "it"], ["bad", "x"], ["not", "table"], ["not"], ["nor", "very"], ["knot", "good"],
    ]
    assert one(tx.emoticons, ":-) ;( haha &lt;33 plain") == [["positive", "negative", "smile", "love", "plain"]]
    assert one(lambda w: F.transform(w, tx.squeeze), "soooo haaappy goood") == [["so", "happy", "god"]]
    assert one(tx.colloquial, "omg u") == [["oh", "my", "god", "you"]]
    assert one(tx.unmark, "@me #tag http://x.y end") == [["tag", "end"]]
    assert spark.createDataFrame([(None,)], "t string").select(tx.clean(F.col("t"))).first()[0] is None
    assert [stem(w) for w in ("relational", "happy", "hopping", "sky")] == ["relat", "happi", "hop", "sky"]


def test_ensembles(spark):
    rows = [(1, 0, 0.9, 0.1, 0, "a"), (1, 0, 0.4, 0.6, 1, "b")]
    v = spark.createDataFrame(rows, VOTES + ", learner string")
    assert ensembles.average(v).first()["p0"] == pytest.approx(0.65)
    w = v.withColumn("weight", F.when(F.col("learner") == "a", 1.0).otherwise(3.0))
    assert ensembles.weighted_average(w).first()["p0"] == pytest.approx((0.9 + 1.2) / 4)
    assert ensembles.scaled_votes(w).first()["p0"] == pytest.approx((0.9 + 1.2) / 3)
    nan = spark.createDataFrame([(float("nan"), 2.0)], "a double, b double")
    assert nan.select(ensembles.normaliser(F.col("a"), F.col("b"))).first()[0] == 4.0


def test_predictors(spark):
    s = stream(spark, [(1, 0, 0, "a"), (2, 50, 0, "a a a"), (3, 100, 1, "a"), (4, 500, 1, "a")])
    words = spark.createDataFrame([("a",)], "word string")
    got = {k: {r["seq"]: (r["v0"], r["v1"]) for r in lexical.predicted(tk.tokens(s), words, 100, k).collect()} for k in lexical.PREDICTORS}
    assert got["average"] == {1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (0, 0)}
    assert got["sum"][3] == (4, 0) and got["regression"][3] == (pytest.approx(5), pytest.approx(0))
    with pytest.raises(ValueError):
        lexical.predicted(tk.tokens(s), words, 100, "oracle")


def test_adwin_counts_holds_the_sketch_capacity(spark):
    from wordtide.plans import catalog

    data = "/root/testdata/sf0.001"
    words = tk.tokens(catalog._stream(spark, data)).select("word").distinct().count()
    assert words > 100 and catalog.QUERIES["adwin_counts"](spark, data).count() == min(words, sketches.CAPACITY)


def test_adwin_skips_only_where_nothing_is_cut():
    """Cuts are the same whether or not the bound on the variance is tried first."""
    class Full(sketches.Adwin):
        def _cut(self):
            cut = False
            while True:
                d = math.log(2 * max(1.0, math.log(max(self.n, 2))) / self.delta)
                values = [(s, 1 << k) for k in range(len(self.rows) - 1, -1, -1) for s, _ in self.rows[k]]
                n0, s0, found = 0, 0.0, False
                for s, size in values:
                    n0, s0 = n0 + size, s0 + s
                    n1, s1 = self.n - n0, self.sum - s0
                    if n0 < 5 or n1 < 5:
                        continue
                    m = 1 / n0 + 1 / n1
                    found |= abs(s0 / n0 - s1 / n1) > math.sqrt(2 * m * self.m2 / self.n * d) + 2 / 3 * m * d
                if not found:
                    return cut
                cut = True
                self._drop()

    r = random.Random(2)
    for p, q in ((0.002, 0.05), (0.3, 0.01), (0.02, 0.02)):
        a, b = sketches.Adwin(), Full()
        for i in range(900):
            x = float(r.random() < (p if i < 450 else q))
            assert a.add(x) == b.add(x) and a.n == b.n


def test_learners_behind_a_sketch(spark):
    """A word that was evicted and comes back begins anew: the learner over renamed tokens, by plain loops."""
    r = random.Random(11)
    rows = [(i, datetime(2020, 1, 1) + timedelta(seconds=i), i % 2, " ".join(f"w{r.randrange(12)}" for _ in range(4))) for i in range(40)]
    stream = spark.createDataFrame(rows, "seq long, ts timestamp, label int, text string")
    seen = sketches.sketched(tk.tokens(stream), 5).collect()
    sketch, epoch, want = sketches.SpaceSaving(5), {}, set()
    for seq, _, _, text in rows:
        for w in sorted(set(text.split())):
            if w not in sketch.count:
                epoch[w] = epoch.get(w, 0) + 1
            sketch.add(w, float(text.split().count(w)))
            want.add((seq, w if epoch[w] == 1 else f"{w}\x01{epoch[w]}"))
    assert {(x["seq"], x["word"]) for x in seen} == want and any(n > 1 for n in epoch.values())
    assert learners.vanilla(stream, sketches.sketched(tk.tokens(stream), 5)).count() == 40


def test_merged_sketch_bounds(spark):
    r = random.Random(12)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(4000)]
    df = spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(words)], "seq long, word string, x double").repartition(5)
    true = Counter(words)
    got = {x["word"]: (x["n"], x["error"]) for x in sketches.merged_sketch(df, 60).collect()}
    assert len(got) == 60 and all(true[w] <= n + 1e-6 and n - e <= true[w] + 1e-6 for w, (n, e) in got.items())
    error = next(iter(got.values()))[1]
    assert error <= len(words) / 60 and {w for w, n in true.items() if n > error} <= set(got)


def test_months_before(spark):
    rows = [(1, 2020, 1), (2, 2020, 1), (3, 2020, 2), (4, 2020, 4), (5, 2020, 5), (6, 2020, 5)]
    counted = spark.createDataFrame([(s, datetime(y, m, 3), "w", s % 2, float(s)) for s, y, m in rows], "seq long, ts timestamp, word string, label int, x double")
    got = {x["seq"]: (x["v0"], x["v1"]) for x in lexical.loaded_before(counted, lexical.monthly_sentiment(counted)).collect()}
    assert got == {3: (2.0, 1.0), 4: (1.0, 2.0), 5: (2.0, 1.5), 6: (2.0, 1.5)}


def test_periods_begin_with_a_document(spark):
    day = 86_400
    rows = [(1, 10, 0, "a"), (2, day + 10, 1, "a"), (3, day + 11, 0, "a"), (4, 4 * day + 20, 1, "a"), (5, 4 * day + 30, 0, "a")]
    got = [(x["start"], x["n0"], x["n1"]) for x in windows.anchored_counts(stream(spark, rows), "day").orderBy("start").collect()]
    at = int(datetime(2024, 1, 1).timestamp())
    assert [(s - at, a, b) for s, a, b in got] == [(10, 1, 1), (day + 11, 1, 0), (2 * day + 11, 0, 0), (3 * day + 11, 0, 0), (4 * day + 11, 0, 0), (4 * day + 20, 1, 1)]
    assert windows._moved(int(datetime(2024, 3, 31, tzinfo=timezone.utc).timestamp()), "month", -1) == int(datetime(2024, 2, 29, tzinfo=timezone.utc).timestamp())
    assert windows.anchored_counts(stream(spark, rows).limit(0), "day").count() == 0


def test_words_are_counted_within_their_document(spark):
    """Rows of one document, time and label are one; no aggregate holds the words of many documents."""
    s = stream(spark, [(1, 0, 0, "b  a B "), (1, 0, 0, " b"), (1, 0, 1, "b"), (2, 1, 1, ""), (3, 1, 1, None), (4, 1, 0, "ä a ä")])
    got = tk.tokens(s)
    assert sorted((r["seq"], r["label"], r["word"], r["x"]) for r in got.collect()) == [(1, 0, "a", 1), (1, 0, "b", 3), (1, 1, "b", 1), (4, 0, "a", 1), (4, 0, "ä", 2)]
    keys = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert keys and not any("word" in line for line in keys)


def _unordered(n):
    """(seq, s): numbers that mostly follow the times, with ties and some that don't."""
    r = random.Random(7)
    at = sorted(r.randrange(900) for _ in range(n))
    for _ in range(n // 20):
        i = r.randrange(n - 1)
        at[i], at[i + 1] = at[i + 1], at[i]
    return list(enumerate(at))


def test_predictors_by_loops(spark):
    """Running sums over the span before, and a join where numbers don't follow the times, against loops."""
    docs = [(k, s, k % 3 % 2, " ".join(["a"] * (1 + k % 4))) for k, s in _unordered(200)]
    words = spark.createDataFrame([("a",)], "word string")
    counted = tk.tokens(stream(spark, docs)).cache()
    for name in lexical.PREDICTORS:
        got = {r["seq"]: (r["v0"], r["v1"]) for r in lexical.predicted(counted, words, 100, name).collect()}
        assert len(got) == len(docs)
        for k, s, _, _ in docs:
            past = [(t - s, label, 1 + j % 4) for j, t, label, _ in docs if j < k and s - 100 <= t <= s]
            for c in (0, 1):
                y = np.array([x * (label == c) for _, label, x in past], float)
                t = np.array([t for t, _, _ in past], float)
                if not past:
                    want = 0.0
                elif name == "regression":
                    want = max(0.0, np.polyfit(t, y, 1)[1] if len(set(t)) > 1 else y.mean())
                else:
                    want = y.mean() if name == "average" else y.sum()
                assert got[k][c] == pytest.approx(want, abs=1e-6), (name, k, c)


def test_span_before_by_loops(spark):
    """The least number and the rows within a span, times with ties and without order, by key and for a null time."""
    rows = [(k % 2, s, k) for k, s in _unordered(300)] + [(0, None, 7), (None, 5, 3), (None, 50, 2)]
    df = spark.createDataFrame(rows, "g int, t long, v long")
    got = prefix.earliest_within(df, "t", 60, "v", "m", ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        held = [v for g, t, v in rows if g == r["g"] and (t is None and r["t"] is None or t is not None and r["t"] is not None and r["t"] - 60 <= t <= r["t"])]
        assert (r["m"], r["m_rows"]) == (min(held), len(held))


def test_span_before_grows_with_the_rows(spark):
    """Frames of no window slide: a sliding one is summed up again for every row."""
    df = spark.range(10).select(F.col("id").alias("t"), F.col("id").alias("v"))
    plan = prefix.earliest_within(df, "t", 5, "v", "m")._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe" in plan and "-5" not in plan


def test_space_saving_part_by_part(spark, monkeypatch):
    """One fold over the stream, cut into parts that begin with what the sketch held, against the sketch itself; ties of counts included."""
    monkeypatch.setattr(sketches, "PART", 60)
    monkeypatch.setattr(sketches, "RUN", 7)
    r = random.Random(5)
    docs = [(k, k, k % 2, " ".join(r.choice("abcdefghijklmnop") for _ in range(9))) for k in range(120)]
    tokens = [(k, w, float(n)) for k, _, _, text in docs for w, n in sorted(Counter(text.split()).items())]
    sketch, since, want = sketches.SpaceSaving(6), {}, []
    for seq, word, x in tokens:
        known = word in sketch.count
        slot, gone = sketch.add(word, x)
        if gone is not None:
            want.append((0, slot, gone, since.pop(gone), seq, None))
        if not known:
            since[word] = seq
    want += [(0, sketch.slot[w], w, since[w], None, n) for w, n in sketch.count.items()]
    got = [tuple(x) for x in sketches.space_saving(tk.tokens(stream(spark, docs)), 6).collect()]
    assert len(tokens) > 10 * 60 and sorted(got, key=repr) == sorted(want, key=repr)


def test_zeros_at_once():
    """A run of zeros leaves the adaptive window as zeros one by one do, and takes few steps."""
    r = random.Random(11)
    for rate in (0.001, 0.02, 0.2, 0.7):
        one, many = sketches.Adwin(), sketches.Adwin()
        cuts = 0
        for _ in range(60):
            gap = min(3000, int(r.expovariate(rate if r.random() < 0.8 else rate / 10)))
            x = float(r.choice((1, 1, 1, 2, 5, 9)))
            for _ in range(gap):
                cuts += one.add(0.0)
            cuts += one.add(x)
            many.zeros(gap)
            many.add(x)
            assert many.n == one.n and many.sum == one.sum and many.m2 == pytest.approx(one.m2)
            assert [[s for s, _ in row] for row in many.rows] == [[s for s, _ in row] for row in one.rows]
        assert cuts or rate < 0.01
    window, calls = sketches.Adwin(), []
    window.add(1.0)
    window.add = lambda x, add=window.add: calls.append(x) or add(x)
    window.zeros(1_000_000)
    assert window.n == 1_000_001 and len(calls) < 1000


def test_arima_fits_equal_series_once_and_all_lengths_together(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(3)
    series = [r.poisson(1.0, n).astype(float) for n in list(range(0, 100)) * 2]
    series += [s.copy() for s in series]
    fit, calls = forecasts.arima_fit, []
    monkeypatch.setattr(forecasts, "arima_fit", lambda d, last: calls.append(len(d)) or fit(d, last))
    got = forecasts.arima_of.func(pd.Series(series))
    want = [fit(np.diff(s)[None, :], s[-1:])[0] if len(s) > 1 else 0.0 for s in series]
    assert np.array_equal(got.to_numpy(), np.array(want))
    assert len(calls) == 1 and sum(calls) <= len(series) / 2


def test_windows_of_an_ensemble_share_their_words(spark, noisy, monkeypatch):
    """Windows of several lengths give what each gives alone, over one table of tokens and one sort of the words."""
    s = stream(spark, noisy)
    alone = {f"w{k}": {r["seq"]: r["p0"] for r in learners.windowed(s, n).collect()} for k, n in enumerate((100, 4000))}
    made, real = [], tk.tokens
    monkeypatch.setattr(tk, "tokens", lambda *a: made.append(1) or real(*a))
    both = ensembles.sliding_votes(s, {"w0": 100, "w1": 4000}).collect()
    assert len(made) == 1 and len(both) == 2 * len(noisy)
    assert all(r["p0"] == pytest.approx(alone[r["learner"]][r["seq"]], abs=1e-12) for r in both)


def test_negations_are_looked_for_at_the_end_of_words(spark):
    """Only texts with a negation go through the words one by one; the cleaned text is that of the step on every text."""
    assert not any(__import__("re").search(tx._NEGATED, t) for t in ("notes on another knotty notary", "minor norm", "neithers"))
    texts = ["i do not like it", "it isn't good", "neither", "nor bad", "cannot go", "notes x  not", "not", "another knot is  noted", "", "don't the bad"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = tx.split_words(F.col("t"))
    got = df.select(tx._where(F.lower(F.rtrim("t")), tx._NEGATED, tx.negations).alias("a"), tx.rejoin(tx.negations(words)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
