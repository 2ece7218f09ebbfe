"""Frequent-word sketches: exact and bounded counts, decayed counts, adaptive windows, chi-square scores.

Tokens are (seq, ts, label, word, x); within a document words come in the order of the alphabet.
"""

from __future__ import annotations

import heapq
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ordinal, prior
from .settle import settled, shared_dir

CAPACITY = 5000
LAMBDA = 0.01
#: The chi-square value beyond which a word and a class are hardly independent (one degree of freedom, 1 %).
CHI2 = 6.63
ADWIN_DELTA = 1.0


def top_words(counted: DataFrame, k: int) -> DataFrame:
    """(word, n): the k words with the most occurrences; of ties the first in the alphabet. A sketch that need not evict has these counts."""
    return counted.groupBy("word").agg(F.sum("x").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def relative_frequency(counted: DataFrame) -> DataFrame:
    """(seq, word, share): a word's occurrences so far among all so far, its document included."""
    mine = prior(counted.select("seq", "word", "x"), ["word"], "seq", {"_w": F.col("x")})
    sizes = counted.groupBy("seq").agg(F.sum("x").alias("n"))
    total = prior(sizes, [], "seq", {"_t": F.col("n")}).select("seq", (F.col("_t") + F.col("n")).alias("total"))
    return mine.join(total, "seq").select("seq", "word", ((F.col("_w") + F.col("x")) / F.col("total")).alias("share"))


def decayed_counts(counted: DataFrame, stream: DataFrame, rate: float = LAMBDA) -> DataFrame:
    """(word, n): counts in which an occurrence fades with the documents after it, read after the last one."""
    docs = ordinal(stream.select("seq"), "seq", "pos")
    now = F.broadcast(docs.agg(F.max("pos").alias("now")))
    at = counted.select("seq", "word", "x").join(docs, "seq").crossJoin(now)
    return at.groupBy("word").agg(F.sum(F.col("x") * F.exp(rate * (F.col("pos") - F.col("now")))).alias("n"))


def chi_square(counted: DataFrame, stream: DataFrame) -> DataFrame:
    """(word, n0, n1, chi2): documents of each class with a word, and the statistic of its table against the classes."""
    total = stream.agg(*(F.sum((F.col("label") == c).cast("double")).alias(f"t{c}") for c in (0, 1)))
    words = counted.groupBy("word").agg(*(F.sum((F.col("label") == c).cast("double")).alias(f"n{c}") for c in (0, 1)))
    return _chi2(words.crossJoin(F.broadcast(total))).select("word", "n0", "n1", "chi2")


def _chi2(df: DataFrame) -> DataFrame:
    a, b = F.col("n1"), F.col("n0")
    c, d = F.col("t1") - a, F.col("t0") - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return df.withColumn("chi2", F.coalesce(F.try_divide((a + b + c + d) * F.pow(a * d - b * c, 2.0), below), F.lit(0.0)))


def chi_square_batches(counted: DataFrame, stream: DataFrame, size: int) -> DataFrame:
    """(batch, word, n0, n1, chi2): the statistic of every word that a batch of documents has, over all documents up to the batch."""
    docs = ordinal(stream.select("seq", "label"), "seq", "pos").withColumn("batch", F.floor((F.col("pos") - 1) / size))
    one = lambda c: F.sum((F.col("label") == c).cast("double"))
    totals = docs.groupBy("batch").agg(one(0).alias("m0"), one(1).alias("m1"))
    totals = prior(totals, [], "batch", {"b0": F.col("m0"), "b1": F.col("m1")}).select("batch", (F.col("b0") + F.col("m0")).alias("t0"), (F.col("b1") + F.col("m1")).alias("t1"))
    words = counted.select("seq", "word", "label").join(docs.select("seq", "batch"), "seq").groupBy("batch", "word").agg(one(0).alias("m0"), one(1).alias("m1"))
    words = prior(words, ["word"], "batch", {"b0": F.col("m0"), "b1": F.col("m1")})
    words = words.select("batch", "word", (F.col("b0") + F.col("m0")).alias("n0"), (F.col("b1") + F.col("m1")).alias("n1"))
    return _chi2(words.join(totals, "batch")).select("batch", "word", "n0", "n1", "chi2")


class SpaceSaving:
    """At most ``capacity`` words with counts; a new word takes over the slot and count of the smallest.

    Of words with the smallest count the one goes that reached it last: the words of a count are a stack. A word that
    moves on stays in the stack that it leaves until it comes to the top or the stacks are cleared; as counts only grow it
    never comes back to one. Occurrences are greater than 0.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: dict[str, float] = {}
        self.slot: dict[str, int] = {}
        self.levels: dict[float, list[str]] = {}
        self.heap: list[float] = []
        self.moves = 0

    @classmethod
    def resumed(cls, capacity: int, rows) -> SpaceSaving:
        """From (word, slot, count) as ``order`` gives them."""
        self = cls(capacity)
        for word, slot, count in rows:
            self.count[word], self.slot[word] = count, slot
            self._level(count).append(word)
        return self

    def order(self) -> list[str]:
        """The words, those of one count from the one that goes last to the one that goes first."""
        self._clear()
        return [w for level in self.levels.values() for w in level]

    def _level(self, count: float) -> list[str]:
        level = self.levels.get(count)
        if level is None:
            level = self.levels[count] = []
            heapq.heappush(self.heap, count)
        return level

    def _clear(self) -> None:
        count = self.count
        kept = {c: [w for w in level if count.get(w) == c] for c, level in self.levels.items()}
        self.levels = {c: level for c, level in kept.items() if level}
        self.heap = sorted(self.levels)
        self.moves = 0

    def _least(self) -> tuple[str, float]:
        """The word that has to go, off its stack, and its count."""
        levels, heap, count = self.levels, self.heap, self.count
        while True:
            least = heap[0]
            level = levels[least]
            while level:
                word = level.pop()
                if count.get(word) == least:
                    return word, least
            heapq.heappop(heap)
            del levels[least]

    def add(self, word: str, x: float) -> tuple[int, str | None]:
        """(slot, the word that had to go) after ``x`` occurrences more."""
        count = self.count
        now, gone = count.get(word), None
        if now is not None:
            now += x
        elif len(count) < self.capacity:
            self.slot[word] = len(count)
            count[word] = x
            self._level(x).insert(0, word)
            return self.slot[word], None
        else:
            gone, least = self._least()
            del count[gone]
            now = least + x
            self.slot[word] = self.slot.pop(gone)
        count[word] = now
        level = self.levels.get(now)
        if level is None:
            level = self._level(now)
        level.append(word)
        self.moves += 1
        if self.moves > 16 * self.capacity + 1024:
            self._clear()
        return self.slot[word], gone


_STAYS = "lane int, slot int, word string, from_seq long, to_seq long, count double, place int"
_STAY_COLUMNS = ["lane", "slot", "word", "from_seq", "to_seq", "count"]
_STAY_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
#: Tokens of a part of the stream that is one task's, and of a row that holds some of them in order.
PART, RUN = 1 << 22, 1 << 14


def _list(column: pa.Array) -> list:
    """The values as Python's: several times faster than ``to_pylist``, which makes an object in between."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Stays:
    """A bounded sketch that takes tokens in order and says which stays end. ``since`` has where those that go on began."""

    def __init__(self, lane: int, capacity: int, state=()):
        self.lane, self.sketch = lane, SpaceSaving.resumed(capacity, [(w, slot, n) for w, slot, _, n in state])
        self.since = {w: seq for w, _, seq, _ in state}

    def ended(self, seqs, words, xs):
        """Take tokens; a batch of the stays that end, or none. What SpaceSaving.add does stands here without its calls."""
        sketch, since = self.sketch, self.since
        count, slots, levels, capacity = sketch.count, sketch.slot, sketch.levels, sketch.capacity
        get, level_of, most = count.get, levels.get, 16 * capacity + 1024
        slot, gone, began, at = [], [], [], []
        least, stack = -1.0, []
        for seq, word, x in zip(seqs, words, xs):
            now = get(word)
            if now is not None:
                now += x
            elif len(count) < capacity:
                sketch.add(word, x)
                since[word] = seq
                continue
            else:
                while True:
                    if not stack:
                        old, least = sketch._least()
                        stack = level_of(least)
                        break
                    old = stack.pop()
                    if get(old) == least:
                        break
                del count[old]
                slots[word] = k = slots.pop(old)
                slot.append(k)
                gone.append(old)
                began.append(since.pop(old))
                at.append(seq)
                since[word] = seq
                now = least + x
            count[word] = now
            level = level_of(now)
            if level is None:
                level = sketch._level(now)
            level.append(word)
        sketch.moves += len(xs)
        if sketch.moves > most:
            sketch._clear()
        n = len(slot)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([self.lane] * n, slot, gone, began, at, [None] * n, [None] * n), _STAY_KINDS)], [*_STAY_COLUMNS, "place"]) if n else None

    def held(self):
        """A batch of the stays that go on, numbered so that another sketch can begin with them."""
        words, sketch = self.sketch.order(), self.sketch
        n = len(words)
        columns = ([self.lane] * n, [sketch.slot[w] for w in words], words, [self.since[w] for w in words], [None] * n, [sketch.count[w] for w in words], list(range(n)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _STAY_KINDS)], [*_STAY_COLUMNS, "place"])


def _history(capacity: int):
    """The stays of every lane, those that go on at its end; rows come sorted by lane, seq and word."""

    def run(batches):
        stays = None
        for b in batches:
            if not b.num_rows:
                continue
            lane = b.column("lane").to_numpy()
            columns = [_list(b.column(c)) for c in ("seq", "word", "x")]
            edge = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1], True]).tolist()
            for lo, hi in zip(edge[:-1], edge[1:]):
                if stays is None or lane[lo] != stays.lane:
                    if stays:
                        yield stays.held()
                    stays = _Stays(int(lane[lo]), capacity)
                if rows := stays.ended(*(c[lo:hi] for c in columns)):
                    yield rows
        if stays:
            yield stays.held()

    return run


def _packed(batches):
    """Rows of some tokens each, numbered in the order that they have."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        for lo in range(0, b.num_rows, RUN):
            few = b.slice(lo, RUN)
            lists = [pa.ListArray.from_arrays([0, few.num_rows], few.column(c)) for c in ("seq", "word", "x")]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), *lists], ["part", "run", "seq", "word", "x"])
            k += 1


def _resumed(capacity: int, state):
    """The stays that end in a part of the stream, and those that go on after it, of a sketch that begins with ``state``."""

    def run(batches):
        stays = _Stays(0, capacity, state)
        for b in batches:
            for tokens in zip(*(b.column(c) for c in ("seq", "word", "x"))):
                if rows := stays.ended(*(_list(c.values) for c in tokens)):
                    yield rows
        if stays.since:
            yield stays.held()

    return run


def _one_lane(counted: DataFrame, capacity: int) -> DataFrame:
    """The fold over the whole stream, part by part: all parts are sorted side by side, each begins with what the sketch holds after the one before."""
    spark = counted.sparkSession
    counted = settled(counted).select("seq", "word", "x")
    parts = max(1, -(-counted.count() // PART))
    ordered = counted.repartitionByRange(parts, "seq").sortWithinPartitions("seq", "word")
    packed, base = shared_dir(spark), shared_dir(spark)
    schema = "part int, run int, seq array<long>, word array<string>, x array<double>"
    ordered.mapInArrow(_packed, schema).write.partitionBy("part").parquet(packed)
    runs = spark.read.schema(schema).parquet(packed)
    state: list[tuple] = []
    for part in range(parts):
        rows = runs.filter(F.col("part") == part).repartition(1).sortWithinPartitions("run")
        rows.mapInArrow(_resumed(capacity, state), _STAYS).write.parquet(f"{base}/part={part}")
        held = spark.read.schema(_STAYS).parquet(f"{base}/part={part}").filter("place IS NOT NULL")
        state = [tuple(r) for r in held.orderBy("place").select("word", "slot", "from_seq", "count").collect()]
    stays = spark.read.schema(f"{_STAYS}, part int").parquet(base)
    return stays.filter((F.col("part") == parts - 1) | F.col("place").isNull()).select(*_STAY_COLUMNS)


def space_saving(counted: DataFrame, capacity: int = CAPACITY, lanes: int = 1) -> DataFrame:
    """(lane, slot, word, from_seq, to_seq, count): the stays of words in the slots of a bounded sketch.

    Stays that go on have no to_seq, and the count; their words are the sketch's result. Words are
    cut into ``lanes`` by their hash, each with its share of the capacity: each is one ordered fold.
    With one lane it is the fold over the whole stream, a task after the other; with more the bound on
    the error is that of a lane.
    """
    if lanes == 1:
        return _one_lane(counted, capacity)
    keyed = counted.select(F.pmod(F.xxhash64("word"), F.lit(lanes)).cast("int").alias("lane"), "seq", "word", "x")
    ordered = keyed.repartition(lanes, "lane").sortWithinPartitions("lane", "seq", "word")
    return ordered.mapInArrow(_history(-(-capacity // lanes)), _STAYS).select(*_STAY_COLUMNS)


def survivors(stays: DataFrame) -> DataFrame:
    """(word, n): what a bounded sketch holds in the end."""
    return stays.filter("to_seq IS NULL").select("word", F.col("count").alias("n"))


def with_epochs(counted: DataFrame, stays: DataFrame) -> DataFrame:
    """Tokens with the number of their word's stay (epoch), counted from 1: a model keyed by word and epoch forgets what was evicted."""
    from pyspark.sql import Window

    starts = stays.select("word", F.col("from_seq").alias("seq")).distinct()
    starts = starts.withColumn("_e", F.row_number().over(Window.partitionBy("word").orderBy("seq")))
    marked = counted.join(starts, ["word", "seq"], "left")
    before = prior(marked, ["word"], "seq", {}, {"_b": F.col("_e")})
    return before.withColumn("epoch", F.greatest(F.coalesce("_e", F.lit(1)), F.coalesce("_b", F.lit(1)))).drop("_e", "_b")


def sketched(counted: DataFrame, capacity: int = CAPACITY, lanes: int = 1) -> DataFrame:
    """The tokens that a learner behind a bounded sketch sees: a word that comes back after its eviction is another word, of which nothing is known."""
    seen = with_epochs(counted, space_saving(counted, capacity, lanes))
    name = F.when(F.col("epoch") > 1, F.concat_ws("\x01", "word", "epoch")).otherwise(F.col("word"))
    return seen.withColumn("word", name).drop("epoch")


def _summary(capacity: int):
    """The bounded sketch of a task's tokens: (word, n, least), least being the count that any other word may have."""

    def run(batches):
        sketch = SpaceSaving(capacity)
        for b in batches:
            for word, x in zip(_list(b.column("word")), _list(b.column("x"))):
                sketch.add(word, x)
        if sketch.count:
            full = len(sketch.count) == capacity
            least = min(sketch.count.values()) if full else 0.0
            n = len(sketch.count)
            yield pa.RecordBatch.from_arrays([pa.array(list(sketch.count), pa.string()), pa.array(list(sketch.count.values()), pa.float64()), pa.array([least] * n), pa.array([1.0 / n] * n)], ["word", "n", "least", "share"])

    return run


def merged_sketch(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(word, n, error): the ``capacity`` words of the merged bounded sketches of all tasks (Agarwal et al., "Mergeable summaries", 2012).

    A word's count is at most n and at least n - error; the errors of all tasks add up to no more than
    all occurrences over the capacity. No task holds more than ``capacity`` words. Which words below the error
    are among the result hangs on how the rows are cut into tasks.
    """
    parts = counted.select("word", "x").mapInArrow(_summary(capacity), "word string, n double, least double, share double")
    whole = settled(parts)
    total = F.broadcast(whole.agg(F.coalesce(F.sum(F.col("least") * F.col("share")), F.lit(0.0)).alias("rest")))
    # a task in which a word is missing may have seen it as often as its least count
    words = whole.groupBy("word").agg(F.sum("n").alias("n"), F.sum("least").alias("own")).crossJoin(total)
    absent = F.greatest(F.lit(0.0), F.round(F.col("rest") - F.col("own"), 6))
    words = words.select("word", (F.col("n") + absent).alias("n"), F.col("rest").alias("error"))
    return words.orderBy(F.desc("n"), "word").limit(capacity)


class Adwin:
    """An adaptive window over a series (Bifet and Gavaldà, 2007): an exponential histogram that drops its oldest part when two parts differ."""

    BUCKETS = 5

    def __init__(self, delta: float = ADWIN_DELTA):
        self.delta, self.rows, self.n, self.sum, self.m2 = delta, [[]], 0, 0.0, 0.0

    def add(self, x: float) -> bool:
        """Take the next value; whether the window was cut."""
        if self.n:
            mean = self.sum / self.n
            self.m2 += self.n * (x - mean) ** 2 / (self.n + 1)
        self.n += 1
        self.sum += x
        self.rows[0].append((x, 0.0))
        k = 0
        while len(self.rows[k]) > self.BUCKETS:
            (s, v), (t, w) = self.rows[k].pop(0), self.rows[k].pop(0)
            size = 1 << k
            if k + 1 == len(self.rows):
                self.rows.append([])
            self.rows[k + 1].append((s + t, v + w + (s - t) ** 2 / (2 * size)))
            k += 1
        return self._cut()

    def _cut(self) -> bool:
        cut = again = False
        while True:
            again = False
            n0, s0 = 0, 0.0
            n1, s1 = self.n, self.sum
            d = log(2 * max(1.0, log(max(self.n, 2))) / self.delta)
            v = self.m2 / max(self.n, 1)
            # parts can't differ by more than all values vary: where that is too little for any cut none is tried
            if v * max(0.0, sqrt(self.n) - sqrt(2 * max(d, 0))) ** 2 * self.n * (1 + 1e-6) + 1e-9 < (4 / 3 * d) ** 2:
                return cut
            d = max(d, 0)
            near = 2 * v * d * (1 - 1e-9)
            for k in range(len(self.rows) - 1, -1, -1):
                size = 1 << k
                for s, _ in self.rows[k]:
                    n0, s0, n1, s1 = n0 + size, s0 + s, n1 - size, s1 - s
                    if n1 < 1:
                        break
                    m = 1 / n0 + 1 / n1
                    far = s0 / n0 - s1 / n1
                    if far * far > near * m and abs(far) > sqrt(2 * m * v * d) + 2 / 3 * m * d and n0 >= 5 and n1 >= 5:
                        again = True
                        break
                if again or n1 < 1:
                    break
            if not again:
                return cut
            cut = True
            self._drop()

    def zeros(self, k: int) -> None:
        """Take ``k`` zeros: as many at once as certainly cut nothing, the others one by one."""
        while k > 0:
            step = k
            while step >= 3 and not self._quiet(step):
                step //= 4
            if step >= 3:
                self._extend(step)
            else:
                step = min(8, k)
                for _ in range(step):
                    self.add(0.0)
            k -= step

    def _quiet(self, k: int) -> bool:
        """Whether none of the next ``k`` zeros can cut the window, wherever a bucket may end.

        The variance has its least value at the first or the last of them, the logarithm at the first. With these, what the means of the two
        parts differ by less its bound is convex in 1 / the length of the second part, so it is greatest at the shortest or the longest. Of
        the cuts behind today's values that just behind them is the nearest.
        """
        n, whole = self.n, self.sum
        if n < 5 or whole < 0:
            return False
        d = max(log(2 * max(1.0, log(n)) / self.delta), 0)
        spread, square = self.m2 + whole * whole / n, whole * whole
        v = max(0.0, min((spread - square / (n + i)) / (n + i) for i in (1, k))) * (1 - 1e-9)
        if whole * (1 + 1e-9) > sqrt(2 * v * d * (n + n * n / k)) + 2 / 3 * d * (1 + n / k):
            return False
        near, c, n0, s0, n1, s1 = 2 * v * d, 2 / 3 * d, 0, 0.0, n, whole
        for level in range(len(self.rows) - 1, -1, -1):
            size = 1 << level
            for s, _ in self.rows[level]:
                n0, s0, n1, s1 = n0 + size, s0 + s, n1 - size, s1 - s
                if n0 < 5 or n1 + k < 5:
                    continue
                a, u = s0 / n0, 1 / n0
                t = 1 / (n1 + 1 if n1 > 3 else 5)
                far = abs(a - s1 * t) * (1 + 1e-9) + 1e-12 - c * (u + t)
                if far > 0 and far * far > near * (u + t):
                    return False
                t = 1 / (n1 + k)
                far = abs(a - s1 * t) * (1 + 1e-9) + 1e-12 - c * (u + t)
                if far > 0 and far * far > near * (u + t):
                    return False
        return True

    def _extend(self, k: int) -> None:
        """``k`` zeros that cut nothing: level by level, the oldest two buckets of a full one become one of the next."""
        if self.n:
            self.m2 += self.sum * self.sum * (1 / self.n - 1 / (self.n + k))
        self.n += k
        level, came = 0, []
        while came or k:
            if level == len(self.rows):
                self.rows.append([])
            here = self.rows[level] + came
            pairs = max(0, -(-(len(here) + k - self.BUCKETS) // 2))
            size, came = 1 << level, []
            while pairs and here:
                s, v = here.pop(0)
                if here:
                    t, w = here.pop(0)
                else:
                    t, w, k = 0.0, 0.0, k - 1
                came.append((s + t, v + w + (s - t) ** 2 / (2 * size)))
                pairs -= 1
            self.rows[level] = here + [(0.0, 0.0)] * (k - 2 * pairs)
            k = pairs
            level += 1

    def _drop(self) -> None:
        k = len(self.rows) - 1
        s, w = self.rows[k].pop(0)
        size = 1 << k
        mean, rest = s / size, self.n - size
        self.n, self.sum = rest, self.sum - s
        if rest:
            self.m2 = max(0.0, self.m2 - w - size * rest * (mean - self.sum / rest) ** 2 / (size + rest))
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()

    @property
    def mean(self) -> float:
        return self.sum / self.n if self.n else 0.0


def _adwin(delta: float):
    def run(batches):
        word, window, at, last = None, None, 0, 0

        def done():
            window.zeros(last - at)
            return word, window.mean, window.n

        for b in batches:
            rows = []
            for w, pos, x, end in zip(*(_list(b.column(c)) for c in ("word", "pos", "x", "last"))):
                if w != word:
                    if word is not None:
                        rows.append(done())
                    word, window, at, last = w, Adwin(delta), pos - 1, end
                window.zeros(pos - 1 - at)
                window.add(x)
                at = pos
            if rows:
                yield _adwin_batch(rows)
        if word is not None:
            yield _adwin_batch([done()])

    return run


def _adwin_batch(rows):
    kinds = (pa.string(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "mean", "width"])


def adwin_counts(counted: DataFrame, stream: DataFrame, capacity: int, delta: float = ADWIN_DELTA) -> DataFrame:
    """(word, mean, width): the adaptive mean count, after the last document, of the ``capacity`` most frequent words.

    Every document after a word's first one counts, with 0 where the word is missing.
    """
    counted = settled(counted)
    docs = settled(ordinal(stream.select("seq"), "seq", "pos"))
    end = F.broadcast(docs.agg(F.max("pos").alias("last")))
    held = counted.join(top_words(counted, capacity).select("word"), "word", "left_semi")
    rows = held.join(docs, "seq").crossJoin(end).select("word", "pos", "x", "last")
    # by number, else the partitions, which are small but take long, are put together
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "word").sortWithinPartitions("word", "pos").mapInArrow(_adwin(delta), "word string, mean double, width long")
