import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wordtide.llm import exact_dedup, near_dedup, runtime

from .helpers import clashing, frame, near_groups, union_find, word_triples

VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus(seed, n=150):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and r.random() < 0.5:
            w = r.choice(docs)[1].split()
            for _ in range(int(len(w) * r.choice((0, 0.01, 0.03, 0.08, 0.3)))):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(r.choice(VOCABULARY) for _ in range(r.randint(5, 200)))))
    return docs


@pytest.mark.parametrize("how", [{}, {"local": 20, "leaf": 8}])
def test_near_recall(spark, how):
    docs = corpus(3) + [(1000 + i, corpus(3)[0][1]) for i in range(120)]
    got = {r["doc_id"]: r["dup_of"] for r in near_dedup.groups(spark, frame(spark, docs), **how).collect()}
    want = near_groups(docs)
    right = sum(got.get(d) == w for d, w in want.items())
    assert right >= 0.9 * len(want)
    assert not set(got) - set(want)


def test_near_dense_blocks(spark):
    """Near-copies by the hundred, in nodes that never shrink."""
    r = random.Random(1)
    base = [r.choice(VOCABULARY) for _ in range(60)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i in range(150) for k in (r.randrange(60),)]
    got = near_dedup.groups(spark, frame(spark, docs), local=30, leaf=8).collect()
    assert {(x["doc_id"], x["dup_of"]) for x in got} == {(i, 0) for i in range(1, 150)}


def test_near_crowd_below_the_threshold(spark):
    """A shared passage, Jaccard 0.48: some estimates are well above the threshold, no pair reaches it."""
    r = random.Random(2)
    shared = [r.choice(VOCABULARY) for _ in range(80)]
    docs = [(i, " ".join(shared + [f"y{i}z{k}" for k in range(42)])) for i in range(700)]
    assert near_groups(docs[:3]) == {}
    assert near_dedup.groups(spark, frame(spark, docs)).count() == 0


def crowd(n, share):
    """One node of n signatures that have each value of a common one with probability ``share``, and its batch."""
    rng = np.random.default_rng(n)
    sig = np.where(rng.random((n, 128)) < share, rng.integers(0, 1 << 16, 128), rng.integers(0, 1 << 16, (n, 128))).astype(np.uint16)
    return sig, pa.RecordBatch.from_pydict({"node": np.full(n, 5), "doc_id": np.arange(n), "sig": [x.tobytes() for x in sig]})


@pytest.mark.parametrize("share", [0.95, 0.83, 0.72])
def test_near_crowd_in_bounded_memory(share):
    """What a task holds, and sends at once, doesn't grow with the square of a crowd: 4.5 million pairs here."""
    _, b = crowd(3000, share)
    tracemalloc.start()
    largest = max(x.num_rows for x in near_dedup._edges(0.5, 128, 128, True)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert largest <= 1 << 19


@pytest.mark.parametrize("share", [0.95, 0.8, 0.72])
@pytest.mark.parametrize("most", [300, 1 << 18])
def test_near_settled_pairs_are_whole(share, most):
    """Settled early or late: every pair near the threshold is connected or goes out to be verified."""
    sig, b = crowd(200, share)
    out = [tuple(e.values()) for x in near_dedup._edges(0.5, 128, 32, True, most=most)(iter([b])) for e in x.to_pylist()]
    equal = {(i, j): int((sig[i] == sig[j]).sum()) for i in range(200) for j in range(i)}
    high, safe = (64 + k * (0.25 / 128) ** 0.5 * 128 for k in (near_dedup.MARGIN, near_dedup.SAFE))
    for bar, rank in ((safe, 2), (high, 1)):
        got, want = union_find([e[:2] for e in out if e[2] >= rank]), union_find([p for p, eq in equal.items() if eq >= bar])
        assert got == want
    whole = union_find([p for p, eq in equal.items() if eq >= high])
    sent = {(max(e[:2]), min(e[:2])) for e in out if e[2] < 1}
    low = 128 - high
    assert sent >= {(i, j) for (i, j), eq in equal.items() if eq >= low and whole.get(i, i) != whole.get(j, j)}
    best = [e[:2] for e in out if e[2] == 0]
    assert len(best) < 200 if most > 300 else best or not sent


def test_near_pairs_are_verified_where_they_are_joined(spark, tmp_path):
    """A long text comes with every pair of it: no batch of such pairs is made for Python."""
    r = random.Random(4)
    long = [r.choice(VOCABULARY) for _ in range(3000)]
    docs = [(0, " ".join(long))] + [(i, " ".join(long[: 150 * i])) for i in range(1, 20)]
    pairs = [(i, j) for i in range(20) for j in range(i)]
    got = near_dedup.verified(spark.createDataFrame(pairs, "a long, b long"), frame(spark, docs), 0.5, f"{tmp_path}/ids")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan[: plan.index("Join")]
    sets = {d: word_triples(t) for d, t in docs}
    want = {(i, j) for i, j in pairs if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert {tuple(x) for x in got.collect()} == want


def test_near_edges(spark):
    long = " ".join(VOCABULARY[i % 3000] + str(i) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (5, "One, two!"), (None, "one two"), (6, long), (7, long + " end"), (8, "other words here")]
    df = clashing(frame(spark, rows))
    assert {(x["doc_id"], x["dup_of"]) for x in near_dedup.groups(spark, df).collect()} == {(5, 4), (7, 6)}
    kept = near_dedup.deduplicate(spark, df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert near_dedup.groups(spark, frame(spark, [])).count() == 0
    assert near_dedup.deduplicate(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("how", [{}, {"fan_in": 2, "lane_rows": 10}])
def test_exact_matches_brute_force(spark, how):
    r = random.Random(5)
    docs = [(i, f"text {r.randrange(60)}") for i in range(300)]
    r.shuffle(docs)
    first = {}
    for d, t in sorted(docs):
        first.setdefault(t, d)
    got = exact_dedup.duplicates(spark, frame(spark, docs).repartition(9), **how).collect()
    assert {(x["doc_id"], x["dup_of"]) for x in got} == {(d, first[t]) for d, t in docs if first[t] != d}
    assert len(got) == len({x["doc_id"] for x in got})


def test_exact_many_lanes():
    """A run is cut into lanes in time that doesn't grow with their number."""
    rng = np.random.default_rng(0)
    n = 40_000
    key = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    sha = np.frombuffer(rng.bytes(32 * n), exact_dedup._ENTRY)
    began = time.process_time()
    out = list(exact_dedup._emit(0, 16, key, sha, np.ones(n, np.int64), np.arange(n)))
    assert time.process_time() - began < 4
    assert sum(len(x) // 8 for b in out for x in b.column("id").to_pylist()) == n
    lanes = [x for b in out for x in b.column("lane").to_pylist()]
    assert lanes == sorted(set(lanes))


def test_exact_edges(spark):
    long = "y" * 1_000_000
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "a"), (5, "a"), (None, "a"), (6, long), (7, long), (8, long + "z"), (9, "a"), (9, "b")]
    df = clashing(frame(spark, rows))
    assert {(x["doc_id"], x["dup_of"]) for x in exact_dedup.duplicates(spark, df).collect()} == {(4, 3), (7, 6), (9, 5)}
    kept = exact_dedup.deduplicate(spark, df)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] or 0, (x["text"] or "")[:1]) for x in kept.collect()) == [(0, "a"), (1, ""), (2, ""), (3, ""), (5, "a"), (6, "y"), (8, "y"), (9, "b")]
    none = frame(spark, [])
    assert exact_dedup.duplicates(spark, none).count() == 0 and exact_dedup.deduplicate(spark, none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, runtime.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_no_broadcast_beyond_the_bound(spark):
    df = spark.range(10)
    assert "broadcast" not in runtime.sized(df, 10**9)._jdf.queryExecution().logical().toString().lower()
