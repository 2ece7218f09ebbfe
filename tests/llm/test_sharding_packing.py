import heapq
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wordtide.llm import bpe, packing, sharding

from .helpers import clashing, frame, packed


def test_water_level_is_the_heap():
    r = random.Random(0)
    for _ in range(200):
        shards = r.randint(1, 7)
        loads = np.array([r.randint(0, 50) for _ in range(shards)])
        size, count = r.randint(1, 9), r.randint(1, 200)
        a = loads.copy()
        got = sharding.spread(a, size, count)
        heap = [(int(x), k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        want = [0] * shards
        for _ in range(count):
            x, k = heap[0]
            want[k] += 1
            heapq.heapreplace(heap, (x + size, k))
        assert got.tolist() == want and (a == loads + got * size).all()


def test_loads_are_those_of_the_greedy_schedule(spark):
    r = random.Random(2)
    docs = [(i, "x" * r.randint(0, 40) + str(r.randrange(90))) for i in range(400)]
    rows = sharding.shard(spark, frame(spark, docs), shards=5).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(400))
    text, home, load = dict(docs), {}, defaultdict(int)
    for x in rows:
        assert home.setdefault(text[x["doc_id"]], x["shard"]) == x["shard"]
        load[x["shard"]] += x["size"]
    sizes = defaultdict(int)
    for _, t in docs:
        sizes[t] += len(t)
    heap = [(0, k) for k in range(5)]
    for s in sorted(sizes.values(), reverse=True):
        x, k = heap[0]
        heapq.heapreplace(heap, (x + s, k))
    assert sorted(load.values()) == sorted(x for x, _ in heap)


def test_one_size_for_nearly_all(spark):
    """Ranks within a popular size come from parts of its keys: every shard gets as many groups as the heap gives it."""
    docs = [(i, f"{i:08d}") for i in range(900)] + [(1000 + i, "y" * (i + 20)) for i in range(60)]
    rows = sharding.shard(spark, frame(spark, docs), shards=7).collect()
    loads = np.zeros(7, np.int64)
    for size in sorted({len(t) for _, t in docs}, reverse=True):
        sharding.spread(loads, size, sum(len(t) == size for _, t in docs))
    got = defaultdict(int)
    for x in rows:
        got[x["shard"]] += x["size"]
    assert [got[k] for k in range(7)] == loads.tolist() and len(rows) == len(docs)


def test_sharding_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "a" * 200_000), (4, "a" * 200_000), (None, "b")]
    got = sharding.shard(spark, clashing(frame(spark, rows))).collect()
    assert sorted((x["doc_id"] or 0, x["size"]) for x in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 200_000), (4, 200_000)]
    assert sharding.shard(spark, frame(spark, [])).count() == 0


def pieces(rows):
    return {(x["window"], *p) for x in rows for p in zip(x["doc_ids"], x["pieces"], x["starts"], x["lengths"], x["offsets"])}


def token_ids(spark, docs):
    """{doc_id: ids} of the encoder, null texts left out."""
    return {x["doc_id"]: x["ids"] for x in bpe.encode(spark, frame(spark, docs)).collect() if x["ids"]}


def test_packing_matches_brute_force(spark):
    r = random.Random(4)
    docs = [(i, "the " * r.choice((1, 3, 5, 8, 13, 40, 90)) + r.choice("xyz")) for i in range(300)]
    rows = packing.pack(spark, frame(spark, docs), window=32, lane=100).collect()
    ids = token_ids(spark, docs)
    lanes = {x["doc_id"]: x["n"] for x in frame(spark, docs).select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)).alias("n")).collect()}
    want = set()
    for lane in range(3):
        parts = []
        for d, _ in docs:
            n = len(ids[d])
            if lanes[d] == lane:
                parts += [(d, k, k * 32, min(32, n - k * 32)) for k in range(-(-n // 32))]
        for (d, k, start, size), (w, offset) in zip(parts, packed([p[3] for p in parts], 32)):
            want.add(((lane << 32) + w, d, k, start, size, offset))
    assert pieces(rows) == want
    for x in rows:
        assert x["ids"] == [i for d, s, n in zip(x["doc_ids"], x["starts"], x["lengths"]) for i in ids[d][s : s + n]]
    assert len({x["window"] for x in rows}) == len(rows)


def test_every_token_is_in_one_window(spark):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    ids = token_ids(spark, docs)
    rows = packing.pack(spark, frame(spark, docs)).collect()
    back = defaultdict(dict)
    for x in rows:
        assert len(x["ids"]) == sum(x["lengths"]) <= packing.WINDOW
        for d, s, n, o in zip(x["doc_ids"], x["starts"], x["lengths"], x["offsets"]):
            back[d][s] = x["ids"][o : o + n]
    assert {d: [i for s in sorted(parts) for i in parts[s]] for d, parts in back.items()} == ids
    by_lanes = packing.pack(spark, frame(spark, docs), lanes=7).collect()
    assert {x["window"] >> 32 for x in by_lanes} == set(range(7)) and sum(len(x["ids"]) for x in by_lanes) == sum(map(len, ids.values()))


def test_packing_invariants_and_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (4, "a b"), (None, "a"), (5, " w" * 10_000), (6, " w" * 2048)]
    got = packing.pack(spark, clashing(frame(spark, rows))).collect()
    for x in got:
        assert x["offsets"][0] == 0 and all(o + n == p for o, n, p in zip(x["offsets"], x["lengths"], [*x["offsets"][1:], len(x["ids"])])) and len(x["ids"]) <= 2048
    total = defaultdict(int)
    for _, d, _, _, n, _ in pieces(got):
        total[d] += n
    assert dict(total) == {3: len(token_ids(spark, rows[2:3])[3]), 4: 4, 5: 10_000, 6: 2048}
    assert packing.pack(spark, frame(spark, [])).count() == 0
