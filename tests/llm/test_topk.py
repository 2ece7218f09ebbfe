import numpy as np
import pytest

from wordtide.llm import runtime, topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k):
    u = topk.unit(x)
    s = np.round(u @ u.T, topk.DIGITS)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], r + 1, ids[j], float(s[i, j])) for r, j in enumerate(order)}
    return out


def holds(got, want):
    assert len(got) == len(want)
    near = {(a, r): s for a, r, _, s in want}
    assert all(abs(near[g["vec_id"], g["rank"]] - g["score"]) <= 2e-6 for g in got)
    assert len({(g["vec_id"], g["rank"], g["neighbor_id"]) for g in got} - {w[:3] for w in want}) <= len(want) // 100


@pytest.mark.parametrize("wide", [False, True])
def test_matches_brute_force(spark, monkeypatch, wide):
    """Several levels of cells; where ``wide``, their pivots go to their cells instead of everywhere."""
    if wide:
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 8)) * 0.05 + c for c in rng.normal(size=(8, 8))]).astype(np.float32)
    x[5] = x[6] = x[7]
    x[100:180] = x[100]
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    want = brute(ids, x, 10)
    holds(topk.search(spark, df, k=10, block_rows=40, leaf=8, fan=16).collect(), want)
    few = topk.search(spark, df, k=10, asked="vec_id % 50 = 0", block_rows=40, leaf=8, fan=16).collect()
    holds(few, {w for w in want if w[0] % 50 == 0})


def test_far_cells_are_pruned(spark, monkeypatch, tmp_path):
    """Clusters far apart: hardly any pair of blocks is left to compare."""
    rng = np.random.default_rng(1)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.01 for c in centres]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(runtime, "forget", lambda *_: None)
    holds(topk.search(spark, df, k=5, block_rows=50, leaf=16).collect(), brute(list(range(len(x))), x, 5))
    blocks, pairs = (spark.read.parquet(f"file://{tmp_path}/shared/{name}") for name in ("blocks", "whole"))
    n = blocks.filter("role = 0").count()
    assert n >= 16 and pairs.count() < n * n / 4


def test_edges(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0]), (12, [0.0, 1.0]), (13, [1.0, 0.1])]
    df = spark.createDataFrame(bad + good, SCHEMA).selectExpr("*", "1 AS rank", "1 AS pivot", "'x' AS block")
    got = sorted((g["vec_id"], g["rank"], g["neighbor_id"]) for g in topk.search(spark, df, k=2).collect())
    assert got == [(10, 1, 11), (10, 2, 13), (11, 1, 10), (11, 2, 13), (12, 1, 13), (12, 2, 10), (13, 1, 10), (13, 2, 11)]
    assert topk.search(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.search(spark, spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
