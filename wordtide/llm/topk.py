"""Exact top-k search by a dual-tree traversal of cover trees.

The queries are the vectors that a condition on the id names, or all; each is searched against all
vectors. Queries and data are indexed together. The top of the tree is grown level by
level over the whole table: a cell of more than BLOCK_ROWS vectors picks up to FAN pivots among its own, and its
vectors go to the nearest. The data of a cell that needs no further level are a block (a cell that
doesn't divide is cut into several), its queries a query block; both build their cover
trees: a node is covered by a centre and a radius, its children by centres that
are picked farthest first until half its radius covers them, or FANOUT of them are picked; every
node keeps the radius that its own points need. A pair of nodes is pruned if the distance of
their centres, less both covering radii, exceeds the worst k-th distance within the query
node; else the node with the larger radius is opened, the nearest children first,
and pairs of leaves are compared in full.

Every query block is searched first against the data of its own cell. The bound that this gives then prunes
pairs of cells, by the same test, level by level from the top, as joins of the table of pairs with
the tables of cells. For the pairs of blocks that are left queries travel to the data; a block that
very many want is sent out in several copies.

Of vectors that are equal to the bit the k + 1 least ids are data, and one is the query for all of them, so
that a group of copies costs no more than its result.

The score is the cosine, rounded to DIGITS digits; ties go to the smaller id. A
vector is no neighbour of itself.

Defined for every input: null vectors and vectors with a null, NaN or infinite element, without
any length, or of another dimension than most, are left out, and so are rows
with a null id; of rows repeated with one id the least vector counts; with
fewer than k other vectors all of them are returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .textkit import runs

K = 10
DIGITS = 6
LEAF = 256
FANOUT = 32
#: Vectors of a block; blocks travel whole.
BLOCK_ROWS = 4096
#: Children of a cell, at most: a byte of its number.
FAN = 256
#: Query blocks that meet one copy of a block.
MEET = 64
_DEPTH = 7

SCHEMA = "vec_id long, rank int, neighbor_id long, score double"
#: Above what rounding does to distances and scores.
_SLACK = 2e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


class CoverTree:
    """Nodes over ranges of a permutation of the points: centre, covering radius, children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.centre, self.radius, self.children = [], [], [], [], []
        stack = [(0, len(x), None)]
        while stack:
            lo, hi, parent = stack.pop()
            at = self.order[lo:hi]
            mine = x[at]
            mean = mine.mean(0, keepdims=True)
            c = int(_distances(mine, mean)[:, 0].argmin())
            d = _distances(mine, mine[c : c + 1])[:, 0]
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.centre.append(at[c])
            self.radius.append(float(d.max()))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if hi - lo <= leaf or self.radius[node] <= _SLACK:
                continue
            nearest, owner, k = d, np.zeros(hi - lo, np.int64), 1
            while nearest.max() > self.radius[node] / 2 and k < FANOUT:
                far = int(nearest.argmax())
                e = _distances(mine, mine[far : far + 1])[:, 0]
                closer = e < nearest
                nearest, owner = np.where(closer, e, nearest), np.where(closer, k, owner)
                k += 1
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = at[by]
            counts = np.bincount(owner, minlength=k)
            ends = lo + np.cumsum(counts)
            stack += [(int(e - c), int(e), node) for c, e in zip(counts, ends) if c]
        self.centre = np.array(self.centre)


class Best:
    """The k best neighbours of every query so far, by score and id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -2.0)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Neighbours ``ids`` with ``sims[query, neighbour]`` for the queries ``rows``."""
        k = self.score.shape[1]
        good = sims >= self.score[rows, -1][:, None] - _SLACK
        n = int(np.count_nonzero(good))
        if not n:
            return
        if n > 4 * k * len(rows) and sims.shape[1] > k:
            # early on most of them pass: only what may be among a query's k best of these does
            good &= sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - _SLACK
        r, c = np.nonzero(good)
        some, at = np.unique(r, return_inverse=True)
        mine = rows[some]
        query = np.r_[np.repeat(np.arange(len(some)), k), at]
        s = np.r_[self.score[mine].ravel(), np.round(sims[r, c], DIGITS)]
        i = np.r_[self.id[mine].ravel(), ids[c]]
        order = np.lexsort((i, -s, query))
        first, _ = runs(query[order])
        top = order[first[:, None] + np.arange(k)]
        self.score[mine], self.id[mine] = s[top], i[top]

    def reach(self, rows: np.ndarray) -> float:
        """The worst k-th distance of the queries ``rows``."""
        return float(np.sqrt(np.maximum(0.0, 2 - 2 * (self.score[rows, -1] - _SLACK)).max()))


def dual(q: dict, r: dict, best: Best) -> None:
    """Offer to the queries of block q their neighbours in block r."""
    x, y, s, t = unit(q["x"]), unit(r["x"]), q["tree"], r["tree"]
    cx, cy = x[s.centre], y[t.centre]
    stack = [(0, 0, float(_distances(cx[:1], cy[:1])[0, 0]))]
    while stack:
        a, b, d = stack.pop()
        rows = s.order[s.lo[a] : s.hi[a]]
        if d - s.radius[a] - t.radius[b] > best.reach(rows) + _SLACK:
            continue
        ka, kb = s.children[a], t.children[b]
        if not ka and not kb:
            others = t.order[t.lo[b] : t.hi[b]]
            best.offer(rows, x[rows] @ y[others].T, r["ids"][others])
        elif not kb or ka and s.radius[a] >= t.radius[b]:
            near = _distances(cx[ka], cy[b : b + 1])[:, 0]
            stack += [(ka[k], b, float(near[k])) for k in np.argsort(-near)]
        else:
            near = _distances(cx[a : a + 1], cy[kb])[0]
            stack += [(a, kb[k], float(near[k])) for k in np.argsort(-near)]


def _vectors(dimension: int):
    def run(batches):
        for b in batches:
            e = b.column("embedding")
            x = np.asarray(e.flatten(), np.float32).reshape(-1, dimension)
            good = np.isfinite(x).all(1) & ((x.astype(np.float64) ** 2).sum(1) > 0)
            at = pa.array(np.flatnonzero(good))
            flat = [v.tobytes() for v in x[good]]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), pa.array(flat, pa.binary())], ["vec_id", "x"])

    return run


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


_POINT = "role int, id long, x binary, cell long, depth int, d double"
_NAMES = ["role", "id", "x", "cell", "depth", "d"]


def _to_pivots(b: pa.RecordBatch, pivots: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows of cells that have pivots go to the nearest one's."""
    cell, depth, d = (b.column(c).to_numpy().copy() for c in ("cell", "depth", "d"))
    x = unit(_rows(b.column("x")))
    order = np.argsort(cell, kind="stable")
    first, count = runs(cell[order])
    for f, n in zip(first, count):
        at = order[f : f + n]
        if (mine := pivots.get(int(cell[at[0]]))) is not None:
            for k in range(0, n, 4096):
                part = at[k : k + 4096]
                far = _distances(x[part], mine)
                near = far.argmin(1)
                cell[part], d[part] = (cell[part] << 8) + near, far[np.arange(len(part)), near]
                depth[part] += 1
    return pa.RecordBatch.from_arrays([b.column("role"), b.column("id"), b.column("x"), pa.array(cell), pa.array(depth), pa.array(d)], _NAMES)


def _route(shared):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _to_pivots(b, shared.value)

    return run


def _route_sorted(batches):
    """Rows sorted by cell, a cell's pivots (role -1) before its points."""
    at, mine = None, []
    for b in batches:
        cells, roles = b.column("cell").to_numpy(), b.column("role").to_numpy()
        first, count = runs(cells)
        for f, n in zip(first, count):
            if cells[f] != at:
                at, mine = int(cells[f]), []
            own = int((roles[f : f + n] < 0).sum())
            if own:
                mine.append(unit(_rows(b.slice(f, own).column("x"))))
            if own < n:
                yield _to_pivots(b.slice(f + own, n - own), {at: np.concatenate(mine)} if mine else {})


def _build(leaf: int):
    """A block of data or queries with its cover tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1)
        made = {"ids": pdf["id"].to_numpy(), "x": x, "tree": CoverTree(unit(x), leaf)}
        return pd.DataFrame({"role": pdf["role"].iloc[:1], "cell": pdf["cell"].iloc[:1], "part": pdf["part"].iloc[:1], "made": [pickle.dumps(made)]})

    return run


_BETTER = "query long, neighbor_id long, score double"
_BLOCK = "role int, cell long, part int, made binary"


def _meet(k: int, first: bool):
    """Query blocks against the block before them; rows come as (block's row, its query blocks), again and again.

    first: from nothing, to (cell, part, best, reach). Else what is better than the known best, as (query, neighbor_id, score).
    """

    def run(batches):
        r = None
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row]  # noqa: B023, E731
                if get("role").as_py() == 0:
                    r = pickle.loads(get("made").as_buffer())
                    continue
                q = pickle.loads(get("made").as_buffer())
                best = Best(len(q["ids"]), k)
                if not first:
                    score, ids = pickle.loads(get("best").as_buffer())
                    best.score, best.id = score.copy(), ids.copy()
                dual(q, r, best)
                if first:
                    columns = [pa.array([get("cell").as_py()]), pa.array([get("part").as_py()], pa.int32()), pa.array([pickle.dumps((best.score, best.id))]), pa.array([best.reach(np.arange(len(q["ids"])))])]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "part", "best", "reach"])
                    continue
                new = np.isin(best.id, r["ids"]) & (best.score > -2)
                at, _ = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(q["ids"][at]), pa.array(best.id[new]), pa.array(best.score[new])], ["query", "neighbor_id", "score"])

    return run


def _own(batches):
    for b in batches:
        for made, best in zip(b.column("made"), b.column("best")):
            q, (score, ids) = pickle.loads(made.as_buffer()), pickle.loads(best.as_buffer())
            at, column = np.nonzero(score > -2)
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][at]), pa.array(ids[at, column]), pa.array(score[at, column])], ["query", "neighbor_id", "score"])


def _near_cells(batches):
    """Those pairs of cells that may hold neighbours of each other."""
    for b in batches:
        if b.num_rows:
            x, y = unit(_rows(b.column("qx"))), unit(_rows(b.column("rx")))
            d = np.sqrt(np.maximum(0, ((x - y) ** 2).sum(1)))
            radii = b.column("q_radius").to_numpy() + b.column("r_radius").to_numpy()
            yield b.select(["q", "r"]).filter(pa.array(d - radii <= b.column("reach").to_numpy() + _SLACK))


def _pivots(level: DataFrame, depth: int, block_rows: int, fan: int) -> DataFrame:
    """(cell, k, x): up to ``fan`` different vectors of every cell that is too large, drawn by a hash; cells with one don't divide."""
    data = level.filter("role = 0")
    big = data.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    big = big.withColumn("want", F.least(F.lit(fan), F.ceil(2 * F.col("n") / block_rows)).cast("int"))
    draw = F.xxhash64("x", F.lit(depth))
    # many more are drawn than wanted, so that hardly any cell has too few; no more than a task can sort
    some = data.join(big, "cell").withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 30)) < F.lit(float(1 << 30)) * (4 * F.col("want") + 16) / F.col("n"))
    some = some.groupBy("cell", "want", "draw").agg(F.min("x").alias("x"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("draw"))).filter("k <= want")
    return some.withColumn("of", F.count("*").over(Window.partitionBy("cell"))).filter("of > 1").select("cell", (F.col("k") - 1).alias("k"), "x")


def _divided(spark: SparkSession, points: DataFrame, base: str, block_rows: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their last cells, the tables of cells level by level: cell, parent, x, and the radii of data and queries)."""
    level, cells = points, []
    for depth in range(1, _DEPTH + 1):
        pivots = runtime.stored(_pivots(level, depth, block_rows, fan), f"{base}/pivots{depth}")
        size = pivots.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
        if not size["n"]:
            break
        if 2 * size["n"] * size["bytes"] <= runtime.BROADCAST_BYTES:
            by: dict[int, list] = {}
            for r in pivots.orderBy("cell", "k").toLocalIterator():
                by.setdefault(r["cell"], []).append(np.frombuffer(r["x"], np.float32))
            shared = spark.sparkContext.broadcast({c: unit(np.array(x)) for c, x in by.items()})
            routed = level.mapInArrow(_route(shared), _POINT)
        else:
            # too many to go everywhere: a cell's pivots meet its points in one place
            lead = pivots.select(F.lit(-1).alias("role"), F.col("k").cast("long").alias("id"), "x", "cell", F.lit(0).alias("depth"), F.lit(0.0).alias("d"))
            routed = level.union(lead).repartition("cell").sortWithinPartitions("cell", "role", "id").mapInArrow(_route_sorted, _POINT)
        level = runtime.stored(routed, f"{base}/level{depth}")
        radius = lambda role: F.max(F.when(F.col("role") == role, F.col("d")))
        new = level.filter(F.col("depth") == depth).groupBy("cell").agg(radius(0).alias("data_radius"), radius(1).alias("query_radius"))
        new = new.withColumn("parent", F.shiftright("cell", 8)).join(pivots.select(F.col("cell").alias("parent"), "k", "x"), "parent").filter(F.col("k") == F.col("cell") % 256)
        table = new.select("cell", "parent", "x", "data_radius", "query_radius")
        if cells:  # cells that are done stay, as their own children
            table = table.union(cells[-1].join(pivots.select("cell").distinct(), "cell", "left_anti").select("cell", F.col("cell").alias("parent"), "x", "data_radius", "query_radius"))
        cells.append(runtime.stored(table, f"{base}/cells{depth}"))
        if depth > 1:
            runtime.forget(spark, f"{base}/level{depth - 1}")
    return level, cells


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("at", "part_of", "copy").sortWithinPartitions("at", "part_of", "copy", "role", "cell", "part")


def _elsewhere(spark: SparkSession, base: str, mine: DataFrame, theirs: DataFrame, known: DataFrame, cells: list[DataFrame], k: int) -> DataFrame:
    """What query blocks find in other blocks than the first that they met."""
    pairs = spark.createDataFrame([(1, 1)], "q long, r long")
    reach = known.groupBy("cell").agg(F.max("reach").alias("reach"))
    depth_of = F.floor((F.length(F.hex("cell")) - 1) / 2).cast("int")
    for depth, table in enumerate(cells, 1):
        top = reach.select(F.when(depth_of > depth, F.expr(f"shiftright(cell, 8 * (cast(floor((length(hex(cell)) - 1) / 2) AS int) - {depth}))")).otherwise(F.col("cell")).alias("q"), "reach").groupBy("q").agg(F.max("reach").alias("reach"))
        q = table.filter("query_radius IS NOT NULL").select(F.col("parent").alias("q_parent"), F.col("cell").alias("q"), F.col("x").alias("qx"), F.col("query_radius").alias("q_radius")).join(top, "q")
        r = table.filter("data_radius IS NOT NULL").select(F.col("parent").alias("r_parent"), F.col("cell").alias("r"), F.col("x").alias("rx"), F.col("data_radius").alias("r_radius"))
        down = pairs.select(F.col("q").alias("q_parent"), F.col("r").alias("r_parent")).join(q, "q_parent").join(r, "r_parent").select("q", "r", "qx", "rx", "q_radius", "r_radius", "reach")
        pairs = runtime.stored(down.mapInArrow(_near_cells, "q long, r long"), f"{base}/pairs{depth}")
    whole = pairs.join(mine.select(F.col("cell").alias("q"), F.col("part").alias("q_part")), "q").join(theirs.select(F.col("cell").alias("r"), F.col("part").alias("r_part")), "r").filter("q <> r OR r_part > 0")
    whole = runtime.stored(whole.withColumn("copy", F.pmod(F.xxhash64("q", "q_part"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("r", "r_part")) / MEET))).cast("int")), f"{base}/whole")
    at = (F.col("r").alias("at"), F.col("r_part").alias("part_of"), "copy")
    asking = whole.join(mine.join(known, ["cell", "part"]).withColumnsRenamed({"cell": "q", "part": "q_part"}), ["q", "q_part"]).select(*at, "role", F.col("q").alias("cell"), F.col("q_part").alias("part"), "made", "best")
    asked = whole.select("r", "r_part", "copy").distinct().join(theirs.withColumnsRenamed({"cell": "r", "part": "r_part"}), ["r", "r_part"]).select(*at, "role", F.col("r").alias("cell"), F.col("r_part").alias("part"), "made", F.lit(None).cast("binary").alias("best"))
    return _together(asking.union(asked)).mapInArrow(_meet(k + 1, False), _BETTER)


def search(spark: SparkSession, vectors: DataFrame, k: int = K, asked: str | None = None, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k nearest others of every vector of ``vectors(vec_id, embedding)`` that ``asked``, a condition on vec_id, names."""
    base = runtime.shared_dir(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    shape = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], SCHEMA)
    v = v.filter(F.size("embedding") == shape["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    v = runtime.stored(v.mapInArrow(_vectors(shape["d"]), "vec_id long, x binary"), f"{base}/vectors")
    queries = v.filter(asked) if asked else v
    # one query for all that are equal, and as many of them as any result can hold
    reps = runtime.stored(queries.groupBy("x").agg(F.min("vec_id").alias("query")), f"{base}/queries")
    members = queries.join(reps, "x").select("vec_id", "query")
    data = v.withColumn("copy", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("copy") <= k + 1)
    point = lambda role, i: (F.lit(role).alias("role"), F.col(i).alias("id"), "x", F.lit(1).cast("long").alias("cell"), F.lit(0).alias("depth"), F.lit(0.0).cast("double").alias("d"))
    points = runtime.stored(data.select(*point(0, "vec_id")).union(reps.select(*point(1, "query"))), f"{base}/points")
    points, cells = _divided(spark, points, base, block_rows, fan)

    size = points.groupBy("role", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    cut = points.join(runtime.sized(size, size.count()), ["role", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    blocks = runtime.stored(cut.groupBy("role", "cell", "part").applyInPandas(_build(leaf), _BLOCK), f"{base}/blocks")
    mine, theirs = blocks.filter("role = 1"), blocks.filter("role = 0")

    here = mine.select(F.col("cell").alias("at"), F.lit(0).alias("part_of"), F.floor(F.col("part") / MEET).cast("int").alias("copy"), "role", "cell", "part", "made")
    start = theirs.filter("part = 0").join(here.select(F.col("at").alias("cell"), "copy").distinct(), "cell")
    start = start.select(F.col("cell").alias("at"), F.lit(0).alias("part_of"), "copy", "role", "cell", "part", "made")
    known = runtime.stored(_together(here.union(start)).mapInArrow(_meet(k + 1, True), "cell long, part int, best binary, reach double"), f"{base}/known")

    found = mine.join(known, ["cell", "part"]).select("made", "best").mapInArrow(_own, _BETTER)
    if theirs.count() > 1:
        found = found.union(_elsewhere(spark, base, mine, theirs, known, cells, k))
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "neighbor_id"))
    found = found.withColumn("n", best("query")).filter(F.col("n") <= k + 1).join(members, "query").filter("vec_id <> neighbor_id")
    return runtime.handed_over(found.withColumn("rank", best("vec_id")).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score"), base)
