"""Packing documents into windows by the online sum-of-squares rule.

Documents come one after the other; each goes to the fill level at which the
sum over all levels of the squared number of windows filled that far grows
least (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares
algorithm for bin packing", 2006). A level array holds those numbers, a queue
for each level the windows themselves; of the windows at a level the oldest is
taken, of tied levels the fullest.

The corpus is cut into lanes by a hash of the id and the text, of about LANE documents
each unless their number is given; lanes are packed side by side, each in the order of its ids. A
document longer than a window fills whole windows of its own; what is left of it is placed
like any other document.

Documents are measured and packed in tokens: every window comes with its token ids, which are those of
the byte-pair encoder of ``bpe``, made here by the compiled encoder of the tokenizer library, and with what lies where in it. The ids are made before the lanes are
formed and travel once; a lane's task holds only the windows that are still open.

Defined for every input: a null or empty text takes no place; rows with a null id have none
either; repeated rows are packed as often as they occur; documents of one id come by length, then by
ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, runtime, textkit

WINDOW = 2048
LANE = 20_000

SCHEMA = "window long, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, offsets array<int>, ids array<int>"
_CODED = "doc_id long, tokens long, coded binary, lane long"
#: Token ids that leave a lane's task at once.
_FLUSH = 1 << 18


class Packer:
    """The state of one lane: windows are numbered in the order in which they are opened."""

    def __init__(self, window: int = WINDOW):
        self.window, self.opened = window, 0
        self.levels = np.zeros(window + 1, np.int64)
        self.queues: list[deque] = [deque() for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece of ``size`` tokens."""
        if size == self.window:
            self.opened += 1
            return self.opened - 1, 0
        n = self.levels
        best, level = 2 * n[size] + 1, 0
        if self.opened:
            low = n[1 : self.window - size + 1]
            cost = 2 * (n[size + 1 :] - low) + 2
            cost[-1] -= 1  # a full window is no level
            cost[low == 0] = 1 << 40
            at = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[at] <= best:
                best, level = cost[at], at + 1
        if level:
            n[level] -= 1
            window = self.queues[level].popleft()
        else:
            window = self.opened
            self.opened += 1
        full = level + size
        if full < self.window:
            n[full] += 1
            self.queues[full].append(window)
        return window, level


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], kind))


def _windows(rows: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
    """Finished windows: their numbers, and (doc_id, piece, start, ids) of what is in them, in order."""
    parts = [[(d, p, s, len(x), x) for d, p, s, x in inside] for _, inside in rows]
    offsets = [(np.cumsum([0, *(x[3] for x in inside)])[:-1]).tolist() for inside in parts]
    ids = np.concatenate([x[4] for inside in parts for x in inside]).astype(np.int32)
    ends = np.r_[0, np.cumsum([sum(x[3] for x in inside) for inside in parts])].astype(np.int32)
    columns = [pa.array([w for w, _ in rows], pa.int64())]
    columns += [_lists([[x[k] for x in inside] for inside in parts], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))]
    columns += [_lists(offsets, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
    return pa.RecordBatch.from_arrays(columns, ["window", "doc_ids", "pieces", "starts", "lengths", "offsets", "ids"])


def _width(tokens: int) -> np.dtype:
    """What an id travels as."""
    return np.dtype(np.uint16 if tokens <= 1 << 16 else np.int32)


def _pack(window: int, width: np.dtype):
    """Rows sorted by lane to windows; a window leaves as soon as it is full, the others at the end of their lane."""

    def run(batches):
        textkit.release()
        at, packer, open_ = None, None, {}
        done: list[tuple] = []
        held = 0
        for b in batches:
            for lane, doc, coded in zip(b.column("lane").to_pylist(), b.column("doc_id").to_pylist(), b.column("coded")):
                if lane != at:
                    done += sorted(open_.items())
                    at, packer, open_ = lane, Packer(window), {}
                coded = np.frombuffer(coded.as_buffer(), width)
                size = len(coded)
                for piece, start in enumerate(range(0, size, window)):
                    length = min(window, size - start)
                    number, offset = packer.place(length)
                    number += lane << 32
                    inside = open_.setdefault(number, [])
                    inside.append((doc, piece, start, coded[start : start + length].copy()))
                    if offset + length == window:
                        done.append((number, open_.pop(number)))
                        held += window
                if held >= _FLUSH:
                    yield _windows(done)
                    done, held = [], 0
        done += sorted(open_.items())
        for k in range(0, len(done), 256):
            yield _windows(done[k : k + 256])
        done, open_ = [], {}
        textkit.release()

    return run


_made: dict[int, tiktoken.Encoding] = {}


def _coder(tokens: list[bytes], pattern: str) -> tiktoken.Encoding:
    """One compiled encoder for each vocabulary in a Python worker."""
    key = hash((tuple(tokens), pattern))
    if key not in _made:
        _made.clear()
        _made[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    return _made[key]


def _code(shared, pattern: str, lanes: int, width: np.dtype):
    """(doc_id, tokens, coded, lane): the ids of every text that has any, as numbers in a row."""

    def run(batches):
        encoder = _coder(shared.value, pattern)
        for b in textkit.sliced(batches):
            coded = [encoder.encode_to_numpy(t, disallowed_special=()).astype(width).tobytes() for t in b.column("text").to_pylist()]
            lane = [mark % lanes for mark in b.column("mark").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(c) // width.itemsize for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(lane, pa.int64())], ["doc_id", "tokens", "coded", "lane"])

    return run


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, lane: int = LANE, lanes: int | None = None, tokenizer: str = bpe.TOKENIZER, pattern: str = bpe.PATTERN) -> DataFrame:
    """Every window: its number, what lies in it, and its token ids.

    doc_ids, pieces, starts, lengths and offsets run side by side: which piece of which document, from which of
    the document's tokens on, how many, and where in ``ids`` they begin.
    """
    texts = runtime.cast_ids(docs).filter("text IS NOT NULL AND text <> ''")
    if lanes is None:
        lanes = max(1, -(-texts.count() // lane))
    tokens = bpe.load(tokenizer)
    width = _width(len(tokens))
    shared = spark.sparkContext.broadcast(tokens)
    coded = texts.withColumn("mark", F.xxhash64("doc_id", "text")).mapInArrow(_code(shared, pattern, lanes, width), _CODED)
    # a partition for each lane, not by a hash of its number, which would put several in one
    return coded.repartitionById(lanes, F.col("lane").cast("int")).sortWithinPartitions("lane", "doc_id", "tokens", "coded").mapInArrow(_pack(window, width), SCHEMA)
