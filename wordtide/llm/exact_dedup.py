"""Exact deduplication: a tree-merge of sorted digest runs.

Every input partition turns its documents into a run: their digests in
sorted order, one entry for each distinct text, the smallest identifier
kept. Runs are exchanged in binomial rounds: in round r the runs whose
numbers agree above the lowest r * log2(FAN_IN) bits meet, and are merged
into one sorted run. Equal 64-bit sort keys are verified by the 256-bit
digest and the length before an entry is given up, at every level. A run is
cut into lanes by the leading bits of its digests, into a few at first and
into FAN_IN times as many in every round, as runs grow, so that the last rounds
merge lanes side by side, none larger than LANE_ROWS entries on average.

Results are defined for every input: a null text is no duplicate of anything;
an empty text is a text like any other; rows repeated with one id and text are
one document (they never pair with themselves); rows with a null id are left
out; of tied copies the smallest id stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textkit import chunks, runs

#: Runs merged at once in a round; a power of two.
FAN_IN = 8
#: Entries of a lane after the last round, on average.
LANE_ROWS = 500_000
#: A first run is cut into no more than 2 to this power lanes.
FIRST_BITS = 6
#: Entries of the lanes that leave Python in one batch, or one lane: a batch is in memory as a whole on both sides.
BATCH_ROWS = 1 << 15

_RUN = "lane int, run int, lost boolean, key binary, sha binary, size binary, id binary"
_ENTRY = np.dtype("S32")


def _pack(lane: int, run: int, lost: bool, key, sha, size, ids) -> dict:
    return {"lane": lane, "run": run, "lost": lost, "key": key.tobytes(), "sha": sha.tobytes(), "size": size.tobytes(), "id": ids.tobytes()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("lane", pa.int32()), ("run", pa.int32()), ("lost", pa.bool_()), ("key", pa.binary()), ("sha", pa.binary()), ("size", pa.binary()), ("id", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _merge(key: np.ndarray, sha: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the kept entries, positions of the lost ones) of concatenated sorted runs.

    The stable sort gallops through the sorted runs, so it is a multiway merge.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    tied = np.r_[False, k[1:] == k[:-1]]
    if not tied.any():
        return order, order[:0]
    # within equal keys: by verified digest, length and identifier
    near = np.flatnonzero(tied | np.r_[tied[1:], False])
    part = order[near]
    order[near] = part[np.lexsort((ids[part], size[part], sha[part], key[part]))]
    a, b = order[:-1], order[1:]
    same = np.r_[False, (key[a] == key[b]) & (size[a] == size[b]) & (sha[a] == sha[b])]
    return order[~same], order[same]


def _first_runs(bits: int):
    """From digests to the runs of a partition, a run for each lane."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        key = t["key"].to_numpy().view(np.uint64)
        sha = np.frombuffer(t["sha"].combine_chunks().cast(pa.binary(32)).buffers()[1], _ENTRY)[: len(key)]
        yield from _emit(number, bits, key, sha, t["size"].to_numpy(), t["doc_id"].to_numpy())

    return run


def _emit(number: int, bits: int, key, sha, size, ids):
    """A merged run, cut into the lanes of the leading ``bits`` of its keys."""
    kept, lost = _merge(key, sha, size, ids)
    for at, gone in ((kept, False), (lost, True)):
        # both come in the order of the keys, so a lane is a range of them
        lanes = (key[at] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
        first, count = runs(lanes)
        for lo, hi in chunks(np.r_[first, len(at)], BATCH_ROWS):
            cut = zip(first[lo:hi], count[lo:hi])
            parts = [(int(lanes[f]), at[f : f + n]) for f, n in cut]
            yield _batch([_pack(lane, number, gone, key[p], sha[p], size[p], ids[p]) for lane, p in parts])


def _merge_runs(shift: int, bits: int):
    """Merge the runs of a lane that meet in this round, to lanes of ``bits``; rows come grouped by (lane, run)."""

    def flush(number, rows):
        key, size, ids = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("key", np.uint64), ("size", np.int64), ("id", np.int64)))
        sha = np.concatenate([np.frombuffer(r["sha"], _ENTRY) for r in rows])
        yield from _emit(number, bits, key, sha, size, ids)

    def run(batches):
        held, at = [], None
        for b in batches:
            for r in b.to_pylist():
                where = (r["lane"], r["run"] >> shift)
                if where != at and held:
                    yield from flush(at[1], held)
                    held = []
                at = where
                held.append(r)
        if held:
            yield from flush(at[1], held)

    return run


def _unpack(batches):
    for b in batches:
        for r in b.to_pylist():
            sha = pa.Array.from_buffers(pa.binary(32), len(r["key"]) // 8, [None, pa.py_buffer(r["sha"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["key"], np.int64)), sha, pa.array(np.frombuffer(r["size"], np.int64)), pa.array(np.frombuffer(r["id"], np.int64))], ["key", "sha", "size", "doc_id"])


def digests(docs: DataFrame) -> DataFrame:
    """(key, sha, size, doc_id): the 64-bit sort key, the digest, bytes and id of every document with a text."""
    d = runtime.cast_ids(docs).filter("text IS NOT NULL")
    return d.select(F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("size"), "doc_id")


def duplicates(spark: SparkSession, docs: DataFrame, fan_in: int = FAN_IN, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(doc_id, dup_of, key): every document whose text an earlier id has too, with the smallest such id.

    ``key`` is xxhash64 of the text, for joins back to the documents.
    """
    base = runtime.shared_dir(spark)
    d = digests(docs)
    n = d.select(F.count("*")).first()[0]
    last = max(0, math.ceil(math.log2(max(1, n) / lane_rows)))
    step = int(math.log2(fan_in))
    bits = min(last, FIRST_BITS)
    level = runtime.stored(d.mapInArrow(_first_runs(bits), _RUN), f"{base}/0")
    lost = level.filter("lost")
    top = level.agg(F.max("run")).first()[0] or 0
    k = 0
    while top > 0:
        k += 1
        bits = min(last, bits + step)
        meet = level.filter("NOT lost").withColumn("to", F.shiftright("run", step))
        meet = meet.repartition("lane", "to").sortWithinPartitions("lane", "to", "run").drop("to")
        level = runtime.stored(meet.mapInArrow(_merge_runs(step, bits), _RUN), f"{base}/{k}")
        lost = lost.union(level.filter("lost"))
        top >>= step
    entry = "key long, sha binary, size long, doc_id long"
    winners = level.filter("NOT lost").mapInArrow(_unpack, entry)
    losers = lost.mapInArrow(_unpack, entry)
    same = ["key", "sha", "size"]
    found = losers.join(winners.withColumnRenamed("doc_id", "dup_of"), same).filter("doc_id <> dup_of")
    return runtime.handed_over(found.select("doc_id", "dup_of", "key").distinct(), base)


def unrepeated(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that repeat another row's id and text."""
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = again.count()
    if not n:
        return docs
    again = runtime.sized(again, n)
    return docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document for each text (the smallest id); all columns stay."""
    gone, key = runtime.fresh(docs, "_gone"), runtime.fresh(docs, "_key")
    pairs = duplicates(spark, docs).select(F.col("doc_id").alias(gone), F.col("key").alias(key))
    lost = runtime.sized(pairs, pairs.count())
    kept = docs.join(lost, (docs["doc_id"].cast("long") == F.col(gone)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key)), "left_anti")
    return unrepeated(kept)
