"""The pipeline against a brute-force version, and its edge cases."""

import random
import threading

import duckdb
import numpy as np
import psutil
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from wordtide.llm import exact_dedup, packing

from .helpers import clashing, frame, languages, near_groups, packed
from .test_pii import brute as sanitised
from .test_sharding_packing import pieces as pieces_of
from .test_sharding_packing import token_ids


def brute(spark, rows):
    """Packed pieces from rows (doc_id, text, lang, source)."""
    found = languages([r[1:] for r in rows])
    docs = [(r[0], r[1]) for i, r in enumerate(rows) if found[i] != "und"]
    first = {}
    for d, t in sorted(docs):
        first.setdefault(t, d)
    docs = sorted((d, t) for t, d in first.items())
    gone = near_groups(docs)
    docs = [(d, t) for d, t in docs if d not in gone]
    texts = sanitised(docs)
    ids = token_ids(spark, [(d, texts[d]) for d, _ in docs])
    pieces = []
    for d, _ in docs:
        n = len(ids.get(d, ()))
        pieces += [(d, k, k * packing.WINDOW, min(packing.WINDOW, n - k * packing.WINDOW)) for k in range(-(-n // packing.WINDOW))]
    return {(w, d, k, s, n, o) for (d, k, s, n), (w, o) in zip(pieces, packed([p[3] for p in pieces], packing.WINDOW))}, {d for d, _ in docs}


def test_small_corpus_matches_brute_force(spark, tmp_path):
    rows = duckdb.sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces_of(corpus_pipeline.run(spark, str(tmp_path)).collect())
    want, ids = brute(spark, rows)
    assert {x[1] for x in got} == ids
    assert got == want


def test_edges(spark, tmp_path):
    base = duckdb.sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    long = " ".join(r[1] for r in base if r[2] == "en") * 4
    rows = base + [(950, long, "en", "s"), base[0], (None, base[1][1], "en", "s"), (900, None, None, None), (901, "", "en", "s"), (902, base[2][1], None, None)]
    clashing(frame(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    inside = pieces_of(got)
    ids = {x[1] for x in inside}
    assert ids and ids <= {950, *(r[0] for r in base)} and sum(n for _, d, _, _, n, _ in inside if d == 950) > 10 * packing.WINDOW
    assert len({x[1:3] for x in inside}) == sum(len(x["pieces"]) for x in got)
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_the_columns(spark):
    docs = clashing(frame(spark, [(i, f"some words of document number {i} are here", "en", "s") for i in range(5)])).withColumn("extra", F.array(F.lit(1)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_crowd_of_near_copies_in_bounded_memory(spark):
    """3000 near copies in the stage near_dedup: no Python worker holds their pairs."""
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    docs = frame(spark, [(i, " ".join(w if r.random() > 0.04 else f"x{r.randrange(10**6)}" for w in base)) for i in range(3000)])
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()):
                        most[0] = max(most[0], p.memory_info().rss if "java" not in p.name() else 0)
                except psutil.Error:
                    pass

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        kept = [x["doc_id"] for x in corpus_pipeline.near(spark, docs, "").collect()]
    finally:
        over.set()
        thread.join()
    assert len(kept) < 60 and 0 in kept
    assert 0 < most[0] < 500 << 20, most[0] >> 20


def test_stages_hand_python_small_batches(spark):
    """Every stage holds Arrow batches to a few megabytes, also of what it returns; a lower limit of the session stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    docs = frame(spark, [(i, f"some words of document number {i} are here", "en", "s") for i in range(5)])
    wide = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    before = spark.conf.get(limit)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(limit, "64m")
            stage(spark, docs, "")
            seen = [x["n"] for x in wide.mapInArrow(sizes, "n long").collect()]
            assert sum(seen) >= 20_000_000 and max(seen) < 5 << 20, (name, max(seen))
            spark.conf.set(limit, "1m")
            stage(spark, docs, "")
            assert max(x["n"] for x in wide.mapInArrow(sizes, "n long").collect()) < 2 << 20, name
    finally:
        spark.conf.set(limit, before)


def test_lanes_leave_in_small_batches():
    """Runs of many entries, cut into lanes: no batch holds all lanes, and none of them is lost."""
    n = 200_000
    key = np.sort(np.random.default_rng(3).integers(0, 1 << 64, n, dtype=np.uint64))
    sha = np.zeros(n, "S32")
    got = list(exact_dedup._emit(0, 4, key, sha, np.zeros(n, np.int64), np.arange(n)))
    assert max(b.nbytes for b in got) < 4 << 20
    rows = [r for b in got for r in b.to_pylist()]
    assert sorted(r["lane"] for r in rows) == list(range(16))
    assert np.array_equal(np.concatenate([np.frombuffer(r["key"], np.uint64) for r in rows]), key)
