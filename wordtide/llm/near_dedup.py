"""MinHash near-deduplication: a chosen-path set similarity join.

A document is the set of its word triples (lower case, punctuation ignored),
embedded as HASHES minwise values. A tree branches recursively: a node
selects 1/threshold of the minwise coordinates by its own hash (each node has
its own selection) and sends each of its documents, for every selected
coordinate, to the child named by the document's minwise token there. A pair
of Jaccard similarity J shares J/threshold children on average, so pairs
above the threshold survive while others die out (Christiani, Pagh and
Sivertsen, "Scalable and robust set similarity join", 2018). Nodes of at most
LEAF documents are compared exhaustively, and so are nodes that don't shrink.
TREES independent trees lift the recall: a pair at the threshold that
survives two levels of one tree with probability 0.6 is found with 0.99.

The first ROOT levels are branched while the signatures are made, from 32-bit
minwise tokens; documents alone in their node go no further. Signatures then
keep 16 bits of each token. Nodes above LOCAL documents are branched by Spark,
level after level; below that a node fits a task and the rest of its subtree is
branched there.

Documents with equal signatures are collapsed first, so that thousands of
copies are one entry. A compared pair is an edge unseen only where its estimate is so high
that not one pair below the threshold is expected there in any crowd (SAFE). Of pairs well above the
threshold a spanning forest of each task is verified on the whole shingle sets, of pairs near it
all whose ends that forest leaves apart, a forest of the best of them first; pairs below are dropped. A crowd's
pairs are the square of its size: a task holds HELD of them and settles which are needed. Where a pair of a forest
fails, the pairs that it stood for are compared again and verified one by one. Verified edges
become groups by connected components.

Defined for every input: texts without a word (null, empty, punctuation) are no
duplicates; texts of one or two words are one shingle; rows with a null id are
left out; repeated rows are one document; of a group the smallest id stays; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, textkit

THRESHOLD = 0.5
SHINGLE = 3
HASHES = 128
TREES = 5
#: Levels branched before documents are first grouped.
ROOT = 2
LEAF = 128
LOCAL = 20_000
#: Standard deviations of the estimate on either side of the threshold that are verified.
MARGIN = 3.0
#: The same, beyond which an estimate is believed: 113 of 128 values, where a pair at the threshold comes with a probability of 4.5e-20: less than one in a crowd of six billion.
SAFE = 8.6
#: A child with more than this share of its parent shows a dense node: compare it, don't branch it.
DENSE = 0.7
#: Compared pairs that a task holds before it settles which of them are needed.
HELD = 1 << 18
#: Levels branched by Spark before what is left is compared in blocks.
LEVELS = 8

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, 512, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, 512, dtype=np.uint32)


def _signatures(size: int, hashes: int, trees: int, threshold: float):
    roots = textkit.mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            ids = b.column("doc_id")
            for lo, hi in textkit.chunks(off, textkit.FINE_BYTES):
                h, row = textkit.shingles(textkit.words(data, off, lo, hi), size)
                if not len(h):
                    continue
                first, _ = textkit.runs(row)
                x = (h >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(first), hashes), np.uint32)
                v = np.empty_like(x)
                for j in range(hashes):
                    np.multiply(x, _A[j], out=v)
                    np.add(v, _B[j], out=v)
                    sig[:, j] = np.minimum.reduceat(v, first)
                n = len(first)
                at, node = np.tile(np.arange(n), trees), np.repeat(roots, n)
                for _ in range(ROOT):
                    rows, node = _children(node, sig[at], threshold)
                    at = at[rows]
                order = np.argsort(at, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(at, minlength=n))].astype(np.int32)
                short = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
                flat = pa.Array.from_buffers(pa.binary(hashes * 2), n, [None, pa.py_buffer(short.tobytes())])
                nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), flat.cast(pa.binary()), nodes], ["doc_id", "sig", "nodes"])

    return run


def signatures(docs: DataFrame, size: int = SHINGLE, hashes: int = HASHES, trees: int = TREES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sig, nodes): the minwise values of every document that has a word, and its nodes at level ROOT of all trees."""
    return runtime.cast_ids(docs).filter("text IS NOT NULL").mapInArrow(_signatures(size, hashes, trees, threshold), "doc_id long, sig binary, nodes array<long>")


def _children(node: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of every document and selected coordinate; the selection hangs on the node alone."""
    hashes = sig.shape[1]
    share = 1 / threshold
    most = int(np.ceil(share))
    draw = textkit.mix(node ^ np.uint64(0xC0FFEE)).astype(np.float64) / 2.0**64
    rows, keys = [], []
    start = textkit.mix(node + np.uint64(0x5EED))
    for k in range(most):
        use = np.arange(len(node)) if k < int(share) else np.flatnonzero(draw < share - int(share))
        coordinate = ((start[use] + np.uint64(k) * (np.uint64(1) + np.uint64(2) * (start[use] >> np.uint64(40)))) % np.uint64(hashes)).astype(np.int64)
        keys.append(textkit.mix(node[use] * np.uint64(0x9E3779B97F4A7C15) + coordinate.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + sig[use, coordinate].astype(np.uint64) + np.uint64(1)))
        rows.append(use)
    return np.concatenate(rows), np.concatenate(keys)


def _sigs(column, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hashes)


def _branch(threshold: float, hashes: int):
    """Rows (node, doc_id, sig, size) to their children."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, child = _children(b.column("node").to_numpy().view(np.uint64), _sigs(b.column("sig"), hashes), threshold)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(b.column(c).take(at) for c in ("doc_id", "sig", "size"))], ["node", "doc_id", "sig", "parent"])

    return run


def _pairs_of(first: np.ndarray, count: np.ndarray):
    """Positions (i, j), i < j, of all pairs within runs, by run length, in blocks."""
    for n in np.unique(count):
        if n < 2:
            continue
        at = first[count == n]
        i, j = np.triu_indices(int(n), 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(at), step):
            block = at[k : k + step, None]
            yield (block + i).ravel(), (block + j).ravel()


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each one's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges make up a spanning forest of the greatest weight (Borůvka)."""
    order = np.argsort(-weight.astype(np.int64), kind="stable")
    x, y = a[order], b[order]
    live, label, kept = np.arange(len(x)), np.arange(n), []
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order[:0]
        best = np.full(n, len(x))
        np.minimum.at(best, label[x[live]], live)
        np.minimum.at(best, label[y[live]], live)
        kept.append(np.unique(best[best < len(x)]))
        label = _labels(n, label[x[kept[-1]]], label[y[kept[-1]]])[label]


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values of each row are equal; eight comparisons are added at a time."""
    same = x == y
    if same.shape[1] % 8 or same.shape[1] > 248:
        return same.sum(1)
    eighths = same.view(np.uint64).sum(1)
    return ((eighths * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _edges(threshold: float, hashes: int, leaf: int, exhaustive: bool = False, every: bool = False, most: int = HELD):
    """Rows sorted by node to edges (a, b, rank): the subtree below each node, then comparison.

    rank: 2 is safe, 1 well above the threshold, 0 and -1 near it: 0 a spanning forest of what the others leave apart, to be verified first. exhaustive: compare every node as it is.
    every: all pairs that safe ones don't connect, between rows whose ``part`` is known and not the same.

    A crowd has as many pairs as the square of its size, so ``most`` are held at once: then the forest takes up
    those it needs, and pairs that it connects are dropped. Pairs that it leaves apart go out by as many.
    """
    sd = (threshold * (1 - threshold) / hashes) ** 0.5
    low, high, safe = (threshold - MARGIN * sd) * hashes, min(1.0, threshold + MARGIN * sd) * hashes, min(1.0, threshold + SAFE * sd) * hashes
    bar = safe if every else high
    steps = np.unique(np.ceil(np.linspace(bar, safe, 9)))

    def solve(node: np.ndarray, ids: np.ndarray, sig: np.ndarray, part: np.ndarray, chosen: np.ndarray):
        unique, at_first, who = np.unique(ids, return_index=True, return_inverse=True)
        n = len(unique)
        base = np.arange(n)
        if every:
            _, of = np.unique(part[at_first], return_inverse=True)
            heads = np.full(n, n)
            np.minimum.at(heads, of, base)
            base = np.where(chosen[at_first], heads[of], base)
        # what edges of at least so many equal values connect, by steps: a pair is of no use to the forest if better edges connect its ends
        joined = np.tile(base, (len(steps), 1))

        def compare(i, j):
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                go = chosen[a] & chosen[b] & (joined[-1][who[a]] != joined[-1][who[b]])
                a, b = a[go], b[go]
                yield who[a], who[b], _equal(sig[a], sig[b])

        def dense(rows):
            """All pairs of a node that doesn't shrink, a row against the later ones."""
            rows = rows[chosen[rows]]
            mine, own = sig[rows], who[rows]
            for k in range(len(rows) - 1):
                later = k + 1 + np.flatnonzero(joined[-1][own[k + 1 :]] != joined[-1][own[k]])
                if len(later):
                    yield np.full(len(later), own[k]), own[later], _equal(mine[later], mine[k])

        def compared(node):
            at = np.arange(len(ids))
            parent = np.full(len(ids), 0 if exhaustive else 1 << 62)
            while len(at):
                order = np.argsort(node, kind="stable")
                node, at, parent = node[order], at[order], parent[order]
                first, count = textkit.runs(node)
                small = (count > 1) & (count <= leaf)
                for i, j in _pairs_of(first[small], count[small]):
                    yield from compare(at[i], at[j])
                stuck = (count > leaf) & (count > DENSE * parent[first])
                for f, c in zip(first[stuck], count[stuck]):
                    yield from dense(at[f : f + c])
                go = np.repeat((count > leaf) & ~stuck, count)
                sizes = np.repeat(count, count)[go]
                rows, child = _children(node[go], sig[at[go]], threshold)
                at, node, parent = at[go][rows], child, sizes[rows]

        none = np.zeros(0, np.int64)
        tree, left, held, count = (none, none, none), (none, none, none), [], 0

        def settle() -> None:
            nonlocal tree, left, held, count
            a, b, eq = (np.concatenate(x) for x in zip(tree, *held))
            strong = np.flatnonzero(eq >= bar)
            kept = strong[_forest(n, a[strong], b[strong], eq[strong])]
            tree = a[kept], b[kept], eq[kept]
            for s, step in enumerate(steps):
                better = tree[2] >= step
                joined[s] = _labels(n, base[tree[0][better]], base[tree[1][better]])[base]
            weak = eq < bar
            a, b, eq = np.r_[left[0], a[weak]], np.r_[left[1], b[weak]], np.r_[left[2], eq[weak]]
            _, once = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
            once = once[joined[0][a[once]] != joined[0][b[once]]]
            left, held, count = (a[once], b[once], eq[once]), [], 0

        def batch(a, b, rank):
            return pa.RecordBatch.from_arrays([pa.array(unique[a]), pa.array(unique[b]), pa.array(rank.astype(np.int8))], ["a", "b", "rank"])

        def near(a, b, eq):
            rank = np.full(len(a), -1)
            rank[_forest(n, joined[0][a], joined[0][b], eq)] = 0
            return batch(np.maximum(a, b), np.minimum(a, b), rank)

        for a, b, eq in compared(node):
            step = np.minimum(np.searchsorted(steps, eq), len(steps) - 1)
            keep = (eq >= low) & (joined[step, a] != joined[step, b])
            if not keep.any():
                continue
            a, b, eq = a[keep], b[keep], eq[keep]
            held.append((a, b, eq))
            count += len(a)
            if (sure := eq >= safe).any():
                joined[-1] = _labels(n, joined[-1][a[sure]], joined[-1][b[sure]])[joined[-1]]
            if count + len(left[0]) >= most:
                settle()
                if len(left[0]) >= most // 2:
                    yield near(*left)
                    left = none, none, none
        settle()
        a, b, eq = tree
        if len(a):
            yield batch(a, b, (eq >= high).astype(np.int8) + (eq >= safe))
        if len(left[0]):
            yield near(*left)

    def run(batches):
        held: list[tuple] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("doc_id").to_numpy()
            part = (b.column("part").fill_null(0).to_numpy(), b.column("part").is_valid().to_numpy(zero_copy_only=False)) if every else (ids, np.ones(b.num_rows, bool))
            held.append((b.column("node").to_numpy(), ids, _sigs(b.column("sig"), hashes), *part))
            rows += b.num_rows
            if rows < 30_000:
                continue
            node, *rest = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on
            if cut:
                yield from solve(node[:cut].view(np.uint64), *(x[:cut] for x in rest))
            held, rows = [tuple(x[cut:].copy() for x in (node, *rest))], len(node) - cut
            del node, rest
        if held:
            node, *rest = (np.concatenate(x) for x in zip(*held))
            held = []
            yield from solve(node.view(np.uint64), *rest)
            del node, rest
        textkit.release()

    return run


def _sets(size: int):
    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            for lo, hi in textkit.chunks(off, textkit.FINE_BYTES):
                h, row = textkit.shingles(textkit.words(data, off, lo, hi), size)
                if not len(h):
                    continue
                first, count = textkit.runs(row)
                sets = [np.unique(h[f : f + c]).view(np.int64) for f, c in zip(first, count)]
                ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[first])), tokens], ["doc_id", "tokens"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, path: str, size: int = SHINGLE) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole shingle sets reach the threshold; their ids are written to ``path``.

    A long text's set comes with every pair of it, so pairs are verified one by one where they are joined:
    a batch of them for Python has no bound.
    """
    ids = runtime.stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), path)
    texts = runtime.cast_ids(docs).join(runtime.sized(ids, ids.count()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(size), "doc_id long, tokens array<long>").dropDuplicates(["doc_id"])
    x = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ends are in different components."""
    small = runtime.sized(parts, parts.count())
    of = lambda c: small.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` of nodes with more than one, and how many: counted before they meet, and joined, which AQE can split for a node of very many."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node")


def _blocks(rows: DataFrame, block: int, top: int) -> DataFrame:
    """Oversized dense nodes as pairs of blocks, each a node of its own: nothing is skipped."""
    parts = -(-top // block)
    mine = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    spread = mine.select("node", "doc_id", "sig", "part", other.alias("with"))
    return spread.select(F.xxhash64("node", F.least("part", "with"), F.greatest("part", "with")).alias("node"), "doc_id", "sig")


def groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, hashes: int = HASHES, trees: int = TREES, leaf: int = LEAF, local: int = LOCAL) -> DataFrame:
    """(doc_id, dup_of) of every near-duplicate but the smallest id of its group."""
    base = runtime.shared_dir(spark)
    named = runtime.stored(signatures(docs, size, hashes, trees, threshold), f"{base}/signatures")
    # minima and counts are made before rows meet, and the joins that give them back can split a hot key: no group of copies is ever in one task
    mark = [F.xxhash64("sig").alias("m1"), F.xxhash64(F.lit(1), "sig").alias("m2")]
    least = named.select(*mark, "doc_id").groupBy("m1", "m2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    least = runtime.stored(least.filter("n > 1").select("m1", "m2", "rep"), f"{base}/least")
    few = runtime.sized(least, least.count())
    copies = named.select(*mark, "doc_id", "sig", "nodes").join(few, ["m1", "m2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    copies = runtime.stored(copies.select("doc_id", "rep", *(F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("sig", "nodes"))), f"{base}/collapsed")
    for name in ("signatures", "least"):
        runtime.forget(spark, f"{base}/{name}")
    equal = copies.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = copies.filter("sig IS NOT NULL")

    keyed = _counted(reps.select(F.explode("nodes").alias("node"), "doc_id"))
    level = runtime.stored(keyed.join(reps.select("doc_id", "sig").dropDuplicates(["doc_id"]), "doc_id").select("node", "doc_id", "sig", "size"), f"{base}/level1")
    found, depth = [], 1
    edge = "a long, b long, rank byte"

    def compared(rows: DataFrame, exhaustive: bool = False, every: bool = False) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_edges(threshold, hashes, leaf, exhaustive, every), edge)

    while True:
        found.append((level.filter(F.col("size") <= local), False))
        big = level.filter(F.col("size") > local)
        top = big.agg(F.max("size")).first()[0]
        if top is None:
            break
        down = runtime.stored(big.mapInArrow(_branch(threshold, hashes), "node long, doc_id long, sig binary, parent long"), f"{base}/down{depth}")
        depth += 1
        level = runtime.stored(_counted(down), f"{base}/level{depth}")
        runtime.forget(spark, f"{base}/down{depth - 1}")
        stuck = (F.col("size") > local) & ((F.col("size") > DENSE * F.col("parent")) | F.lit(depth >= LEVELS))
        dense = level.filter(stuck)
        if (most := dense.agg(F.max("size")).first()[0]) is not None:
            found.append((_blocks(dense, local // 2, most), True))
        level = level.filter(~stuck)
    edges = runtime.stored(reduce(DataFrame.union, [compared(*f) for f in found]).distinct(), f"{base}/edges")
    of = lambda rank: edges.filter(F.col("rank") == rank).select("a", "b")
    links = lambda parts: parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
    parts = runtime.components(spark, of(2).union(equal), f"{base}/parts")

    def joined(parts: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(components with those of the pairs that hold, the pairs that don't)"""
        near = runtime.stored(_apart(pairs, parts), f"{base}/{name}")
        if not near.limit(1).count():
            return parts, near
        good = runtime.stored(verified(near, docs, threshold, f"{base}/{name}-ids", size), f"{base}/{name}-good")
        return runtime.components(spark, links(parts).union(good), f"{base}/{name}-parts"), near.join(good, ["a", "b"], "left_anti")

    safe = parts
    parts, bad = joined(parts, of(1).distinct(), "strong")
    bad = runtime.stored(bad, f"{base}/bad")
    best, rest = of(0), of(-1)
    if bad.limit(1).count():
        # whoever a forest with a false edge connected: their pairs were left out on the strength of it
        forest = runtime.components(spark, links(safe).union(of(1)), f"{base}/forest")
        whole = forest.select("node", "root").union(forest.select(F.col("root").alias("node"), "root")).distinct()
        roots = bad.select(F.col("a").alias("node")).join(whole, "node").select("root").distinct()
        ends = whole.join(roots, "root", "left_semi").select("node").distinct()
        # what holds is connected already: only pairs between its parts are compared
        ends = ends.join(parts.select("node", F.col("root").alias("part")), "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("part", "node").alias("part"))
        doubted = runtime.stored(ends, f"{base}/doubted")
        few = runtime.sized(doubted, doubted.count())
        again = []
        for rows, exhaustive in found:
            rows = rows.join(few, "doc_id", "left")
            wanted = rows.filter("part IS NOT NULL").groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("top")).filter("low < top").select("node")
            again.append(compared(rows.join(wanted, "node", "left_semi"), exhaustive, True))
        again = runtime.stored(reduce(DataFrame.union, again).distinct(), f"{base}/again")
        best, rest = best.union(again.filter("rank >= 0").select("a", "b")), rest.union(again.filter("rank < 0").select("a", "b"))
    # first the best pairs near the threshold: what they connect need not be verified
    parts, _ = joined(parts, best.distinct(), "best")
    parts, _ = joined(parts, rest.distinct(), "near")
    return runtime.handed_over(parts.select(F.col("node").alias("doc_id"), F.col("root").alias("dup_of")), base)


def deduplicate(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document (the smallest id) of each near-duplicate group; all columns stay."""
    found = groups(spark, docs, **how).select("doc_id")
    return runtime.without_ids(docs, runtime.sized(found, found.count()))
