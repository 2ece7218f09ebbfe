"""Substring deduplication with a log-structured fingerprint index.

Texts are sequences of words (lower case, punctuation ignored). Windows of
GRAM words are hashed, and of every NEIGHBOURS windows in a row the least hash
is a fingerprint (winnowing; Schleimer, Wilkerson and Aiken 2003), so any
passage of GRAM + NEIGHBOURS - 1 = 50 words that occurs twice has a fingerprint in
common, wherever it stands.

The index of past fingerprints is log-structured: every batch of documents
leaves an immutable run, a table bucketed and sorted by hash. A new batch, bucketed the
same way, is merge-joined with every run, which moves none of the history.
FAN_IN runs of one level are compacted into one of the next, again by a merge join; the
earliest and the latest place of a hash stay.

A fingerprint is linked with the place of its hash just before it, so that no place is the source of
very many; where the match along that link may be shorter than WORDS words, also with the
first place of the hash and the first and last of each run. Matches on one diagonal of a
pair of documents whose windows touch are one candidate. Candidates are verified: the
words of both places are fetched and compared, inside the outermost windows by a 128-bit digest and word for
word up to the next fingerprint beyond them, and the match counts from WORDS words on. Matches of a
diagonal that overlap are joined. What is reported are the later copies, each with an earlier place of the same words.

Links alone can miss a passage, where a shorter phrase in it stands in many other documents. So
fingerprints with two earlier places or more, of whose windows of WORDS words one lies in no match so far, are
settled exactly: at all places of their hashes those windows are hashed whole, with 128 bits, and each is linked
with its first place. Only equal windows meet, so that a hot phrase costs one row for each of its windows.
Every window of WORDS words that was there before thus lies in a match.

The index can stay in a folder and be opened again: ``extend`` then takes the next batch, of
whatever size, without reading the history's texts but where a passage may be shared.

A hash of very many rows (a phrase in every document) is linked in ranges of ids side by
side; a text that very many others are compared with is sent out in several copies.

Earlier means in a former batch, or in the same one with a smaller id, or in the
same document at a smaller position.

Defined for every input: null and empty texts and those with fewer than WORDS words
have no rows; rows with a null id are left out; of rows repeated with one
id the first in the order of their texts counts; ties go to the smallest id and position; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, textkit

WORDS = 50
GRAM = 25
BATCHES = 4
FAN_IN = 2
#: Fingerprints of a bucket, on average.
BUCKET_ROWS = 1_000_000
#: A hash with more rows than that in a batch is linked in HOT_PARTS ranges of ids.
HOT_ROWS = 1 << 20
HOT_PARTS = 64
#: Ranges of one text that are asked for together.
ASKED = 4096


_PRINTS = "h long, doc_id long, pos int, back int, many int"
_COLUMNS = ["h", "doc_id", "pos", "back", "many"]
FOUND = "doc_id long, start long, words long, src_id long, src_start long, char_start long, char_end long"


def _window_hashes(w: textkit.Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index in the chunk) of all windows of ``gram`` words within a row."""
    n = len(w.hash) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, q = textkit.powers(len(w.hash) + 1)
    prefix = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * p[: len(w.hash)], out=prefix[1:])
    h = textkit.mix((prefix[gram:] - prefix[:-gram]) * q[:n])
    at = np.flatnonzero(w.row[:n] == w.row[gram - 1 :])
    return h[at], at


def _winnow(h: np.ndarray, row: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least of every ``neighbours`` hashes in a row of the text (of ties the last).

    With each how far before it the first neighbourhood begins whose least it is, and how many in a row there are.
    """
    n = len(h) - neighbours + 1
    out = np.zeros(len(h), bool)
    back, many = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
    if n > 0:
        # sliding minima by doubling; the hash's complement order makes the last of ties win
        best, at, span = h.copy(), np.arange(len(h)), 1
        while span < neighbours:
            step = min(span, neighbours - span)
            a, b = best[:-step], best[step:]
            later = b <= a
            best, at = np.where(later, b, a), np.where(later, at[step:], at[:-step])
            span += step
        begin = np.flatnonzero(row[:n] == row[neighbours - 1 :])
        chosen = at[begin]
        out[chosen] = True
        # the choice never moves back, so the neighbourhoods of one follow one another
        first, count = textkit.runs(chosen)
        back[chosen[first]], many[chosen[first]] = chosen[first] - begin[first], count
    # rows with fewer windows than that keep their least one
    first, count = textkit.runs(row)
    for f, c in zip(first[count < neighbours], count[count < neighbours]):
        part = h[f : f + c]
        out[f + c - 1 - int(part[::-1].argmin())] = True
    keep = np.flatnonzero(out)
    return keep, back[keep], many[keep]


def _fingerprints(words: int, gram: int):
    neighbours = words - gram + 1

    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            ids = b.column("doc_id").to_numpy()
            for lo, hi in textkit.chunks(off):
                w = textkit.words(data, off, lo, hi)
                h, at = _window_hashes(w, gram)
                if not len(h):
                    continue
                keep, back, many = _winnow(h, w.row[at], neighbours)
                at = at[keep]
                first, count = textkit.runs(w.row)
                begin = np.repeat(first, count)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(ids[w.row[at]]), pa.array((at - begin[at]).astype(np.int32)), pa.array(back), pa.array(many)], ["h", "doc_id", "pos", "back", "many"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(h, doc_id, pos, back, many): the winnowed window hashes and the word index at which each begins.

    Of the windows of ``words`` words it stands for the first begins ``back`` words before it; there are ``many``.
    """
    return docs.mapInArrow(_fingerprints(words, gram), _PRINTS)


def _frequent(least: int):
    """(h, n): the hashes that a batch of rows holds at least so often."""

    def run(batches):
        for b in batches:
            h, n = np.unique(b.column("h").to_numpy(), return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(n[often])], ["h", "n"])

    return run


_PLACE = "STRUCT<batch: INT, doc_id: BIGINT, pos: INT>"
_RUN = {False: "h BIGINT, doc_id BIGINT, pos INT, back INT, many INT, batch INT", True: f"h BIGINT, f {_PLACE}, l {_PLACE}"}


class Index:
    """A log-structured index of fingerprints: runs (level, table, merged), newest last, and the fingerprints of every batch.

    All of it lies below ``path``: the runs as bucketed tables, the fingerprints by batch, and a manifest
    that names the runs, written anew after each batch. ``Index(spark, path)`` opens what is there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fan_in: int = FAN_IN, hot: int = HOT_ROWS):
        self.spark, self.path, self.buckets, self.fan_in, self.hot = spark, path.rstrip("/"), buckets, fan_in, hot
        self.runs: list[tuple[int, str, bool]] = []
        self.batches = 0
        if found := self._manifests():
            state = json.loads(spark.read.text(found[-1]).first()[0])
            self.buckets, self.fan_in, self.batches = state["buckets"], state["fan_in"], state["batches"]
            self.runs = [tuple(r) for r in state["runs"]]
            for _, name, merged in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN[merged]}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _manifests(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # one without its mark of success was cut off
        names = sorted(str(f.getPath().toString()) for f in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]

    def _save(self, gone: list[str]) -> None:
        old = self._manifests()
        state = json.dumps({"buckets": self.buckets, "fan_in": self.fan_in, "batches": self.batches, "runs": self.runs})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.batches:08d}")
        for m in old:
            if not m.endswith(f"/{self.batches:08d}"):
                runtime.forget(self.spark, m)
        for name in gone:  # only now does no manifest name them
            self._drop(name)

    def _write(self, df: DataFrame) -> str:
        name = f"wordtide_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        runtime.forget(self.spark, f"{self.path}/{name}")

    def _places(self, run: tuple[int, str, bool], first: str, last: str) -> DataFrame:
        """(h, first, last): the earliest and the latest place of every hash of a run."""
        place = F.struct("batch", "doc_id", "pos")
        low, high = (F.col("f"), F.col("l")) if run[2] else (place, place)
        return self.spark.table(run[1]).groupBy("h").agg(F.min(low).alias(first), F.max(high).alias(last))

    def _compact(self) -> list[str]:
        """Merge the newest runs while FAN_IN of them have one level; the tables that are no longer needed."""
        gone = []
        while len(self.runs) >= self.fan_in and len({r[0] for r in self.runs[-self.fan_in :]}) == 1:
            old = self.runs[-self.fan_in :]
            merged = self._places(old[0], "f", "l")
            for run in old[1:]:
                more = self._places(run, "f2", "l2")
                merged = merged.join(more.hint("merge"), "h", "full").select("h", F.least("f", "f2").alias("f"), F.greatest("l", "l2").alias("l"))
            self.runs = [*self.runs[: -self.fan_in], (old[0][0] + 1, self._write(merged), True)]
            gone += [name for _, name, _ in old]
        return gone

    def prints(self) -> DataFrame:
        """(h, doc_id, pos, back, many, part): the fingerprints of all batches."""
        return self.spark.read.schema(f"{_PRINTS}, part int").parquet(f"{self.path}/prints")

    def _linked(self, rows: DataFrame, runs: list[DataFrame]) -> DataFrame:
        """``rows(…, f, before)`` with the places that ``runs`` have of their hashes."""
        more = [F.col("f")]
        for k, places in enumerate(runs):
            rows = rows.join(places, "h", "left")
            more += [F.col(f"f{k}"), F.col(f"l{k}")]
        last = [F.col(f"l{k}") for k in range(len(runs))]
        older = F.greatest(*last) if len(last) > 1 else last[0] if last else F.lit(None)
        rows = rows.withColumn("before", F.coalesce("before", older)).filter("before IS NOT NULL")
        own = (F.col("doc_id"), F.col("pos"))
        others = F.filter(F.array_distinct(F.array_compact(F.array(*more))), lambda m: (m != F.col("before")) & ~((m["doc_id"] == own[0]) & (m["pos"] == own[1])))
        bare = lambda m: F.struct(m["doc_id"].alias("doc_id"), m["pos"].alias("pos"))
        return rows.select("h", "doc_id", "pos", "back", "many", bare(F.col("before")).alias("src"), F.transform(others, bare).alias("more"))

    def ingest(self, prints: DataFrame, to: str) -> DataFrame:
        """(h, doc_id, pos, back, many, src, more) of a batch's fingerprints that occurred before, written to ``to``; then they are indexed.

        src is the place just before; more holds the first place, and the first and last of each run.
        """
        batch, gone = self.batches, self._compact()
        prints = runtime.stored(prints, f"{self.path}/prints/part={batch}").withColumn("batch", F.lit(batch))
        place = F.struct("batch", "doc_id", "pos")
        hot = prints.select("h").mapInArrow(_frequent(8), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > self.hot).select("h")
        hot = runtime.stored(hot, f"{to}-hot")
        some = hot.count()
        few = runtime.sized(hot, some)
        rest = prints.join(few, "h", "left_anti") if some else prints
        if some:  # of a hash that very many rows have the run needs only both ends
            often = prints.join(few, "h", "left_semi")
            ends = often.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).select("h", F.explode(F.array("f", "l")).alias("p"))
            none = F.lit(None).cast("int")
            rest = rest.select(*_COLUMNS, "batch").union(ends.select("h", "p.doc_id", "p.pos", none, none, "p.batch"))
        mine = self._write(rest.select(*_COLUMNS, "batch").repartition(self.buckets, "h"))
        w = Window.partitionBy("h").orderBy("doc_id", "pos")
        rows = self.spark.table(mine).filter("many IS NOT NULL").select(*_COLUMNS, F.first(place).over(w).alias("f"), F.lag(place).over(w).alias("before"))
        hits = self._linked(rows, [self._places(r, f"f{k}", f"l{k}").hint("merge") for k, r in enumerate(self.runs)])
        if some:
            hits = hits.union(self._hot(often, few, place))
        hits = runtime.stored(hits, to)
        self.runs.append((0, mine, False))
        self.batches += 1
        self._save(gone)
        return hits

    def _hot(self, often: DataFrame, few: DataFrame, place) -> DataFrame:
        """The same for hashes that very many rows have: in ranges of ids side by side, of which each needs the last place before it."""
        edges = often.agg(F.percentile_approx("doc_id", [k / HOT_PARTS for k in range(1, HOT_PARTS)], 1000)).first()[0]
        parted = often.withColumn("part", sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0)))
        ends = parted.groupBy("h", "part").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        by = Window.partitionBy("h").orderBy("part")
        ends = ends.select("h", "part", F.first("low").over(by).alias("f"), F.lag("high").over(by).alias("above"))
        w = Window.partitionBy("h", "part").orderBy("doc_id", "pos")
        rows = parted.withColumn("before", F.lag(place).over(w)).join(ends, ["h", "part"]).withColumn("before", F.coalesce("before", "above"))
        return self._linked(rows.select(*_COLUMNS, "f", "before"), [self._places(r, f"f{k}", f"l{k}").join(few, "h", "left_semi") for k, r in enumerate(self.runs)])

    def close(self) -> None:
        """Forget the tables' names; what is below ``path`` stays."""
        for _, name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def remove(self) -> None:
        self.close()
        runtime.forget(self.spark, self.path)


def _marked(links: DataFrame, gram: int) -> DataFrame:
    """``links(doc_id, pos, src, …)`` with their diagonal and its part: windows that touch, from the one at lo to the one at hi.

    In the source both positions are less by shift.
    """
    diagonal = ["doc_id", "src_id", "shift"]
    w = Window.partitionBy(*diagonal).orderBy("pos")
    part = Window.partitionBy(*diagonal, "part")
    rest = [c for c in links.columns if c not in ("doc_id", "pos", "src")]
    h = links.select("doc_id", "pos", F.col("src.doc_id").alias("src_id"), (F.col("pos") - F.col("src.pos")).alias("shift"), *rest)
    h = h.withColumn("new", (F.col("pos") - F.lag("pos").over(w) > gram).cast("int"))
    h = h.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return h.select(*diagonal, "pos", F.min("pos").over(part).alias("lo"), F.max("pos").over(part).alias("hi"), *rest)


_PAIR = ["doc_id", "src_id", "shift", "lo", "hi"]


def candidates(hits: DataFrame, base: str, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, src_id, shift, lo, hi): candidates along the links to the place before, and along the others where those may be too short."""
    marked = runtime.stored(_marked(hits.select("doc_id", "pos", "src", "more"), gram), f"{base}/marked")
    first = marked.filter("pos = lo").select(*_PAIR)
    weak = marked.filter(F.col("hi") - F.col("lo") + gram < words).select("doc_id", "pos", F.explode("more").alias("src"))
    return first.union(_marked(weak, gram).filter("pos = lo").select(*_PAIR)).distinct()


def _digests(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two prefix sums, of which the digest of any range of words follows."""
    p = textkit.powers(len(h) + 1)[0][: len(h)]
    out = []
    for salt in (0x9FB21C651E98DF25, 0xD6D0D3E3A5C1B7F1):
        out.append(np.r_[np.zeros(1, np.uint64), np.cumsum(textkit.mix(h ^ np.uint64(salt)) * p)])
    return out[0], out[1]


_SLICE = "doc_id long, src_id long, shift int, lo int, hi int, source boolean, digest binary, left binary, right binary, begins binary, ends binary"
_SLICE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
_SLICE_NAMES = [c.split()[0] for c in _SLICE.split(", ")]


def _slices(gram: int, margin: int):
    """Of each wanted range of a text: a digest of its words, the words on either side (32 bits of their hashes), and the characters around."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SLICE_TYPES)], _SLICE_NAMES)

    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            plain, plain_off = textkit.column(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for k, wanted in enumerate(b.column("wanted")):
                w = textkit.words(data, off, k, k + 1)
                o = textkit.words(plain, plain_off, k, k + 1)
                # characters before each byte of the text as it is
                chars = np.r_[0, np.cumsum((o.data & 0xC0) != 0x80)].astype(np.int32)
                begins, ends = chars[o.start], chars[o.end]
                one, two = _digests(w.hash)
                _, back = textkit.powers(len(w.hash) + 1)
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                mine, asked = ids[k], wanted.as_py()
                source = np.array([e["source"] for e in asked])
                lo, hi, shift = (np.array([e[c] for e in asked], np.int64) for c in ("lo", "hi", "shift"))
                first, end = lo - shift * source, hi - shift * source + gram
                fine = (first >= 0) & (end <= len(short))
                a, z = np.where(fine, first, 0), np.where(fine, end, 0)
                digests = np.stack([(d[z] - d[a]) * back[a] for d in (one, two)], 1)
                for i in np.flatnonzero(fine).tolist():
                    e, a, z = asked[i], int(first[i]), int(end[i])
                    pair = (e["other"], mine) if e["source"] else (mine, e["other"])
                    places = (b"", b"") if e["source"] else (begins[max(0, a - margin) : a + 1].tobytes(), ends[z - 1 : z + margin].tobytes())
                    rows.append((*pair, e["shift"], e["lo"], e["hi"], e["source"], digests[i].tobytes(), short[max(0, a - margin) : a].tobytes(), short[z : z + margin].tobytes(), *places))
                    if len(rows) >= 8192:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return run


def _agree(x: bytes, y: bytes, backwards: bool) -> int:
    """How many words in a row are the same, from the end that touches the range."""
    n = min(len(x), len(y))
    if not n:
        return 0
    a, b = (np.frombuffer(t, np.uint32) for t in ((x[-n:], y[-n:]) if backwards else (x[:n], y[:n])))
    same = (a == b)[::-1] if backwards else a == b
    return len(same) if same.all() else int(same.argmin())


def _compare(words: int, gram: int):
    """Verified matches of candidates; the two slices of a candidate follow one another, the source's last."""

    def run(batches):
        held: dict = {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not r["source"]:
                    held = r
                    continue
                if any(held.get(c) != r[c] for c in (*_PAIR, "digest")):
                    continue
                left, right = _agree(held["left"], r["left"], True), _agree(held["right"], r["right"], False)
                n = r["hi"] - r["lo"] + gram + left + right
                if n < words:
                    continue
                begins, ends = np.frombuffer(held["begins"], np.int32), np.frombuffer(held["ends"], np.int32)
                start = r["lo"] - left
                rows.append((r["doc_id"], start, n, r["src_id"], start - r["shift"], int(begins[-1 - left]), int(ends[right])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], ["doc_id", "start", "words", "src_id", "src_start", "char_start", "char_end"])

    return run


def joined(matches: DataFrame) -> DataFrame:
    """Matches of one diagonal that overlap or touch as one."""
    diagonal = ["doc_id", "src_id", "shift"]
    w = Window.partitionBy(*diagonal).orderBy("start", "words")
    m = matches.withColumns({"shift": F.col("start") - F.col("src_start"), "end": F.col("start") + F.col("words")})
    m = m.withColumn("new", (F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    m = m.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(w))
    m = m.groupBy(*diagonal, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    return m.select("doc_id", "start", (F.col("end") - F.col("start")).alias("words"), "src_id", (F.col("start") - F.col("shift")).alias("src_start"), "char_start", "char_end")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with what is wanted of them."""
    # what is wanted grows with the data and is never broadcast; hashing it spares the texts a sort
    n = wanted.count()
    few = n * 64 <= runtime.BROADCAST_BYTES // 4
    # but where few texts are wanted their ids spare the others the shuffle
    mine = docs.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi") if few else docs
    return mine.join(wanted.hint("shuffle_hash"), "doc_id")


def verify(spark: SparkSession, found: DataFrame, docs: DataFrame, words: int = WORDS, gram: int = GRAM, asked: int = ASKED, base: str | None = None) -> DataFrame:
    """The matches that the texts of ``docs(doc_id, text)`` bear out, as FOUND."""
    entry = lambda other, source: F.struct(F.col(other).alias("other"), "shift", "lo", "hi", F.lit(source).alias("source")).alias("e")
    sides = found.select("doc_id", entry("src_id", False)).union(found.select(F.col("src_id").alias("doc_id"), entry("doc_id", True)))
    base = base or runtime.shared_dir(spark)
    sides = runtime.stored(sides, f"{base}/sides")
    # of a text that very many others are compared with the questions come in parts, each with the text
    crowded = runtime.stored(sides.groupBy("doc_id").count().filter(F.col("count") > asked), f"{base}/crowded")
    parts = F.coalesce(F.ceil(F.col("count") / asked), F.lit(1))
    sides = sides.join(runtime.sized(crowded, crowded.count()), "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("e"), parts))
    wanted = runtime.stored(sides.groupBy("doc_id", "part").agg(F.collect_list("e").alias("wanted")).drop("part"), f"{base}/wanted")
    texts = _texts_of(docs, wanted)
    slices = texts.select("doc_id", "text", "wanted").mapInArrow(_slices(gram, words - gram + 1), _SLICE)
    paired = slices.repartition("doc_id", "src_id", "shift").sortWithinPartitions(*_PAIR, "source")
    return joined(paired.mapInArrow(_compare(words, gram), FOUND))


def _uncovered(ranges: DataFrame, matches: DataFrame) -> DataFrame:
    """Those of ``ranges(doc_id, a, z, …)``, from word a to before z, that lie in no single match."""
    known = matches.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("words")).alias("z"), F.lit(0).alias("_kind"))
    both = known.unionByName(ranges.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("a", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_reach", F.max(F.when(F.col("_kind") == 0, F.col("z"))).over(w))
    return both.filter((F.col("_kind") == 1) & (F.coalesce("_reach", F.lit(-1)) < F.col("z"))).select(ranges.columns)


def _whole_windows(words: int):
    """(one, two, batch, doc_id, pos): 128 bits of every asked window of ``words`` words of a text."""

    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            ids, batch = b.column("doc_id").to_numpy(), b.column("batch").to_numpy()
            for k, asked in enumerate(b.column("asked").to_pylist()):
                w = textkit.words(data, off, k, k + 1)
                one, two = _digests(w.hash)
                _, inverse = textkit.powers(len(w.hash) + 1)
                a = np.concatenate([np.arange(e["a"], e["a"] + e["many"]) for e in asked])
                x, y = (((d[a + words] - d[a]) * inverse[a]).view(np.int64) for d in (one, two))
                for lo in range(0, len(a), 65_536):
                    cut = slice(lo, lo + 65_536)
                    part = a[cut].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut]), pa.array(y[cut]), pa.array(np.full(len(part), batch[k], np.int32)), pa.array(np.full(len(part), ids[k])), pa.array(part)], ["one", "two", "batch", "doc_id", "pos"])

    return run


def unsettled(spark: SparkSession, hits: DataFrame, prints: DataFrame, matches: DataFrame, docs: DataFrame, words: int = WORDS, gram: int = GRAM, since: int = 0, base: str | None = None) -> DataFrame | None:
    """Candidates for the repeated windows of batches from ``since`` on that ``matches`` leave out, each with its first place; None if no fingerprint is in question."""
    base = base or runtime.shared_dir(spark)
    a = F.col("pos") - F.col("back")
    asked = hits.filter((F.size("more") > 0) & (F.col("many") > 0)).select("h", "doc_id", a.alias("a"), (a + F.col("many") - 1 + words).alias("z"))
    hot = runtime.stored(_uncovered(asked, matches).select("h").distinct(), f"{base}/hot")
    n = hot.count()
    if not n:
        return None
    places = prints.filter("many > 0").join(runtime.sized(hot, n, 32), "h", "left_semi")
    places = runtime.stored(places.groupBy("doc_id", F.col("part").alias("batch")).agg(F.collect_list(F.struct(a.alias("a"), "many")).alias("asked")), f"{base}/places")
    texts = _texts_of(docs, places)
    windows = runtime.stored(texts.select("doc_id", "batch", "text", "asked").mapInArrow(_whole_windows(words), "one long, two long, batch int, doc_id long, pos int"), f"{base}/windows")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("batch", "doc_id", "pos")).alias("src"), F.count("*").alias("n")).filter("n > 1").drop("n")
    links = windows.filter(F.col("batch") >= since).join(first, ["one", "two"]).filter((F.col("doc_id") != F.col("src.doc_id")) | (F.col("pos") != F.col("src.pos")))
    links = links.select("doc_id", "pos", "src", F.col("pos").alias("a"), (F.col("pos") + words).alias("z"))
    near = _marked(_uncovered(links, matches).select("doc_id", "pos", "src"), words).filter("pos = lo")
    return runtime.stored(near.select(*_PAIR[:-1], (F.col("hi") + words - gram).alias("hi")).distinct(), f"{base}/near")


def _resolved(spark: SparkSession, index: Index, hits: DataFrame, docs: DataFrame, words: int, gram: int, since: int) -> DataFrame:
    """What the texts of ``docs`` bear out of the hits of batches from ``since`` on."""
    base = runtime.shared_dir(spark)
    near = runtime.stored(candidates(hits, base, words, gram), f"{base}/candidates")
    matches = runtime.stored(verify(spark, near, docs, words, gram, base=f"{base}/verified"), f"{base}/matches")
    runtime.forget(spark, f"{base}/verified")
    rest = unsettled(spark, hits, index.prints(), matches, docs, words, gram, since, f"{base}/unsettled")
    return runtime.handed_over(matches if rest is None else joined(matches.union(verify(spark, rest, docs, words, gram, base=f"{base}/verified"))), base)


def _unrepeated(texts: DataFrame) -> DataFrame:
    texts = texts.filter("text IS NOT NULL")
    if texts.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts


def extend(spark: SparkSession, index: Index, new: DataFrame, known: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Every repeated passage of ``new(doc_id, text)``, the next batch of an index that may have been opened again; then it is indexed.

    ``known`` are the documents of all batches before; their ids must be others than those of ``new``. Of the history only
    the runs, which are merge-joined, and the texts of documents that may share a passage are read.
    """
    texts = _unrepeated(runtime.cast_ids(new))
    since = index.batches
    hits = index.ingest(fingerprints(texts, words, gram), f"{runtime.shared_dir(spark)}/hits")
    return _resolved(spark, index, hits, texts.union(_unrepeated(runtime.cast_ids(known))), words, gram, since)


def repeats(spark: SparkSession, docs: DataFrame, words: int = WORDS, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN, path: str | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """Every passage of at least ``words`` words that an earlier document, or an earlier part of the same one, has.

    doc_id, start and words say where and how long it is, in words; src_id and src_start where it
    was before; char_start and char_end are its characters in the text.
    ``docs`` is ingested in ``batches`` batches in the order of its ids. Where a ``path`` is given the
    index stays there, for ``extend``.
    """
    base = runtime.shared_dir(spark)
    texts = _unrepeated(runtime.cast_ids(docs))
    span = texts.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
    if span["a"] is None:
        return spark.createDataFrame([], FOUND)
    edges = texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    prints = fingerprints(texts, words, gram).withColumn("part", batch.cast("int"))
    prints.write.partitionBy("part").parquet(f"{base}/prints")
    prints = spark.read.schema(f"{_PRINTS}, part int").parquet(f"{base}/prints")
    index = Index(spark, path or f"{base}/index", max(1, -(-prints.count() // BUCKET_ROWS)), fan_in, hot)
    found = None
    for k in range(batches):
        hits = index.ingest(prints.filter(F.col("part") == k).drop("part"), f"{base}/hits{k}")
        found = hits if found is None else found.union(hits)
    runtime.forget(spark, f"{base}/prints")
    done = _resolved(spark, index, found, texts, words, gram, 0)
    for k in range(batches):
        runtime.forget(spark, f"{base}/hits{k}")
    index.close() if path else index.remove()
    return done
