"""Nearest neighbours among points, densities and geodesic distances.

Exact neighbours need every pair of rows that may be near.  Rows are packed in
blocks of bounded size, every pair of blocks is a cell of its own that returns
``k`` rows per point, and these are merged; no task ever holds more than two
blocks, a cell is measured tile by tile, and no pair is written out.  Tiles are
screened in single precision with a bound on its error; what may be near enough
is measured in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most; smaller tables are cut in SPREAD blocks of LEAST rows at least, so that all cores have cells.
BLOCK, LEAST, SPREAD = 32_768, 1024, 12
#: Partitions that cells are dealt to; rows and columns of a tile; columns that give a first bound; pairs measured exactly at once.
CELLS, TILE, FIRST, AT_ONCE = 192, (512, 2048), 1024, 1 << 15
#: Decimals to which distances are compared, so that ties go to the smaller id on every engine.
TIES = 9


def _pack(t: pa.Table) -> pa.Table:
    """The rows of a block as one, by ascending id; places in single precision where that loses nothing."""
    ids, c = t.column("point_id").to_numpy(), t.column("x").combine_chunks()
    x = c.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    order = np.argsort(ids, kind="stable")
    x = np.ascontiguousarray(x[order])
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    raw = short if np.array_equal(short, x) else x
    key = {n: t.column(n).slice(0, 1) for n in ("g", "b", "nl", "nr")}
    return pa.table(key | {"d": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "x": pa.array([raw.tobytes()], pa.binary())})


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, raw, d = np.frombuffer(t.column("ids")[0].as_py(), np.int64), t.column("x")[0].as_py(), t.column("d")[0].as_py()
    kind = np.float64 if len(raw) == 8 * d * len(ids) else np.float32
    return ids, np.frombuffer(raw, kind).reshape(len(ids), d).astype(float)


def _blocks(n: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n / LEAST))).cast("int")


def _packed(points: DataFrame, grid: DataFrame, n: str) -> DataFrame:
    """``(g, b, nl, nr, d, ids, x)``: a row per block of ``points (point_id, x, g)``."""
    dealt = points.join(grid, "g").withColumn("b", F.pmod(F.xxhash64("point_id", "x"), F.col(n)).cast("int"))
    return dealt.groupBy("g", "b", "nl", "nr").applyInArrow(_pack, "g int, b int, nl int, nr int, d int, ids binary, x binary")


def _cells(left: DataFrame, right: DataFrame) -> tuple:
    """Both sides in blocks per group, copied to the pairs of blocks, ready to be grouped."""
    sizes = lambda df, name: df.groupBy("g").agg(_blocks(F.count("*")).alias(name))
    right = right.select([F.col(c).alias(c) for c in right.columns])  # both sides may be the same table
    grid = F.broadcast(sizes(left, "nl").join(sizes(right, "nr"), "g"))  # a row per group
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = _packed(left, grid, "nl").withColumnRenamed("b", "lb").withColumn("rb", copies("nr"))
    b = _packed(right, grid, "nr").withColumnRenamed("b", "rb").withColumn("lb", copies("nl"))
    return _dealt(a), _dealt(b)


def _dealt(blocks: DataFrame):
    return blocks.select("g", "lb", "rb", "d", "ids", "x").repartition(CELLS, "g", "lb", "rb").groupBy("g", "lb", "rb")


def _few_copies(y: np.ndarray, most: int) -> np.ndarray:
    """Which rows have fewer than ``most`` equal rows before them."""
    rows = np.ascontiguousarray(y).view(np.uint64)
    mixed = (rows * np.random.default_rng(0).integers(1, 1 << 62, rows.shape[1], dtype=np.uint64)).sum(1)
    if len(np.unique(mixed)) == len(y):
        return np.ones(len(y), bool)
    _, kind = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    start = np.r_[0, np.nonzero(np.diff(kind[order]))[0] + 1]
    before = np.arange(len(y)) - np.repeat(start, np.diff(np.r_[start, len(y)]))
    out = np.empty(len(y), bool)
    out[order] = before < most
    return out


def nearest_rows(own: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int, metric: str, with_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, neighbours' ids and distances: the ``k`` nearest rows of ``y``, by ascending ids ``other``, of each row of ``x``.

    A score in single precision falls with the distance; a row can be near enough only if its score reaches the
    bound of the best distances known, less what rounding may take.  Those that do are measured in double precision.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no such metric: {metric}")
    same = 0 if with_self else int((np.searchsorted(other, own, "right") - np.searchsorted(other, own)).max(initial=0))
    keep = _few_copies(y, k + same)  # of equal rows none after the first few can be among the nearest
    other, y = other[keep], y[keep]
    dim, slack = x.shape[1], 10.0**-TIES
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    if metric == "cosine":
        unit = lambda v, n: np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0).astype(np.float32)
        xs, ys, minus = unit(x, nx), unit(y, ny), np.zeros(len(y), np.float32)
        margin = np.full(len(x), (dim + 8) * 2.0**-23 + 2 * slack)
        bound = lambda r, d: 1 - d - margin[r]
    else:
        middle = y.mean(0)
        xc, yc = x - middle, y - middle
        scale = max(np.abs(xc).max(initial=0), np.abs(yc).max(initial=0)) * np.sqrt(dim) or 1.0
        xs, ys = (xc / scale).astype(np.float32), (yc / scale).astype(np.float32)
        x2, y2 = ((xc / scale) ** 2).sum(1), ((yc / scale) ** 2).sum(1)
        minus, far, slack = (y2 / 2).astype(np.float32), np.sqrt(y2.max()), slack / scale
        margin = (dim + 8) * 2.0**-23 * (np.sqrt(x2) * far + far * far) + 2 * slack * (np.sqrt(x2) + far + slack) + 1e-30
        bound = lambda r, d: (x2[r] - (d / scale) ** 2) / 2 - margin[r]

    def exact(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), AT_ONCE):
            at = slice(i, i + AT_ONCE)
            p, q = x[rows[at]], y[cols[at]]
            if metric == "cosine":
                n = nx[rows[at]] * ny[cols[at]]
                out[at] = 1 - np.divide(np.einsum("ij,ij->i", p, q), n, out=np.zeros(len(p)), where=n > 0)
            else:
                out[at] = np.sqrt(((p - q) ** 2).sum(1))
        return np.round(out, TIES) + 0.0

    found, room = [], np.empty(TILE[0] * TILE[1], np.float32)  # one room for all tiles: fresh pages cost more than products
    for i in range(0, len(x), TILE[0]):
        part = slice(i, min(i + TILE[0], len(x)))
        a, r = xs[part], np.arange(part.start, part.stop)
        first = a @ ys[:FIRST].T - minus[:FIRST]
        least = np.full(len(a), -np.inf)
        if first.shape[1] > k + same:
            at = first.shape[1] - k - same
            least = np.partition(first, at, axis=1)[:, at].astype(float) - 2 * margin[r]
        rows, cols, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for j in range(0, len(y), TILE[1]):
            b = ys[j : j + TILE[1]]
            score = np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            if metric == "euclidean":
                score -= minus[j : j + TILE[1]]
            near = np.flatnonzero(score >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            if not len(near):
                continue
            p, q = np.divmod(near, score.shape[1])
            p, q = p + i, q + j
            if not with_self:
                p, q = p[own[p] != other[q]], q[own[p] != other[q]]
            d = exact(p, q)
            fine = np.isfinite(d)
            rows, cols, dist = np.concatenate([rows, p[fine]]), np.concatenate([cols, q[fine]]), np.concatenate([dist, d[fine]])
            order = np.lexsort((cols, dist, rows))  # columns ascend by id
            rows, cols, dist = rows[order], cols[order], dist[order]
            begin = np.searchsorted(rows, r)
            place = np.arange(len(rows)) - begin[rows - i]
            last = place == k - 1
            least[rows[last] - i] = np.maximum(least[rows[last] - i], bound(rows[last], dist[last]))
            rows, cols, dist = rows[place < k], cols[place < k], dist[place < k]
        found.append((own[rows], other[cols], dist))
    return tuple(np.concatenate(v) for v in zip(*found))


def knn_join(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine", group: str = "g", with_self: bool = False) -> DataFrame:
    """``(point_id, g, neighbor_id, dist, rank)``: per row of ``left`` and group the ``k`` nearest rows of ``right`` in the group.

    Both have ``(point_id long, x, g int)``.  A row is no neighbour of itself unless ``with_self``.
    """

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, near, dist, groups = [], [], [], []
        if a.num_rows and b.num_rows:
            ids, near, dist = nearest_rows(*_unpack(a), *_unpack(b), k, metric, with_self)
            groups = np.full(len(ids), a.column("g")[0].as_py(), np.int32)
        return pa.table({"point_id": pa.array(ids, pa.int64()), "g": pa.array(groups, pa.int32()), "neighbor_id": pa.array(near, pa.int64()), "dist": pa.array(dist, pa.float64())})

    ready = lambda df: df.select("point_id", F.col("x").cast("array<double>").alias("x"), F.col(group).cast("int").alias("g"))
    a, b = _cells(ready(left), ready(right))
    found = a.cogroup(b).applyInArrow(cell, "point_id long, g int, neighbor_id long, dist double")
    order = Window.partitionBy("point_id", "g").orderBy("dist", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _one_group(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").cast("long").alias("point_id"), "x", F.lit(0).alias("g"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("point_id").orderBy("dist", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("point_id", "rank", "neighbor_id", "dist")


def knn(points: DataFrame, k: int = 15, metric: str = "cosine") -> DataFrame:
    """``(point_id, rank, neighbor_id, dist)``: the ``k`` nearest other points."""
    p = _one_group(points)
    return knn_join(p, p, k, metric).select("point_id", "rank", "neighbor_id", "dist")


def stage_order(points: DataFrame, stages: list | None = None) -> DataFrame:
    """``(point_id, x, ord)`` from ``points (point_id, x, stage)``: stages in the given order, or ascending."""
    stages = stages if stages is not None else [r[0] for r in points.select("stage").distinct().orderBy("stage").collect()]
    table = points.sparkSession.createDataFrame([(s, i) for i, s in enumerate(stages)], f"stage {points.schema['stage'].dataType.simpleString()}, ord int")
    return points.join(F.broadcast(table), "stage").select(F.col("point_id").cast("long").alias("point_id"), "x", "ord")


def knn_guide(points: DataFrame, k: int = 15, metric: str = "cosine", stages: list | None = None) -> DataFrame:
    """Neighbours among the points of the same and the two adjacent stages, the point itself included."""
    p = stage_order(points, stages)
    ask = p.withColumn("g", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1))).drop("ord")
    return _ranked(knn_join(ask, p.withColumnRenamed("ord", "g"), k, metric, with_self=True), k)


def knn_force(points: DataFrame, k: int = 15, metric: str = "cosine", stages: list | None = None, radius: float | None = None) -> DataFrame:
    """``k`` neighbours from the stage before, ``k`` others from the own stage and ``k`` from the next; at either end twice as many from the own."""
    p = stage_order(points, stages)
    last = p.agg(F.max("ord")).first()[0] or 0
    ask = p.withColumn("g", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)))
    found = knn_join(ask.drop("ord"), p.withColumnRenamed("ord", "g"), 2 * k, metric)
    most = F.when((F.col("g") == F.col("ord")) & ((F.col("ord") == 0) | (F.col("ord") == last)), 2 * k).otherwise(k)
    found = found.join(p.select("point_id", "ord"), "point_id").where(F.col("rank") <= most)
    if radius is not None:
        found = found.where(F.col("dist") <= radius)
    return _ranked(found, 3 * k)


def supervised_knn(points: DataFrame, n_neighbors: int = 15, n_natural: int = 0, metric: str = "cosine", method: str = "force", stages: list | None = None) -> DataFrame:
    """The first ``n_natural`` neighbours whatever their stage, then neighbours by stage that are not among them."""
    if n_neighbors % 3:
        raise ValueError("n_neighbors must be divisible by 3")
    by_stage = knn_force(points, n_neighbors // 3, metric, stages) if method == "force" else knn_guide(points, n_neighbors, metric, stages)
    if not n_natural:
        return by_stage
    tag = lambda df, t: df.select("point_id", "neighbor_id", "dist", F.lit(t).alias("late"))
    both = tag(knn(points, n_natural, metric), False).unionByName(tag(by_stage, True))  # found once each
    both = both.withColumn("only", F.min("late").over(Window.partitionBy("point_id", "neighbor_id"))).where(F.col("late") == F.col("only"))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("point_id", "late").orderBy("dist", "neighbor_id")))
    both = both.where(~F.col("late") | (F.col("rank") <= n_neighbors - n_natural))
    return both.select("point_id", F.when(F.col("late"), F.col("rank") + n_natural).otherwise(F.col("rank")).alias("rank"), "neighbor_id", "dist")


def coo(found: DataFrame) -> DataFrame:
    """Neighbours as the entries of a sparse matrix: ``(row, col, value)``."""
    return found.select(F.col("point_id").alias("row"), F.col("neighbor_id").alias("col"), F.col("dist").alias("value"))


def _pair_sums(points: DataFrame, fn) -> DataFrame:
    """``(point_id, s)``: the sum of ``fn(squared distance)`` over all points, the point itself included."""
    p = _one_group(points).withColumn("x", F.col("x").cast("array<double>"))
    grid = F.broadcast(p.groupBy("g").agg(_blocks(F.count("*")).alias("nl")).withColumn("nr", F.col("nl")))
    blocks, twin = (_packed(p.select([F.col(c).alias(c) for c in p.columns]), grid, "nl") for _ in range(2))
    # A pair of blocks is measured once, for both.
    a = _dealt(blocks.withColumnRenamed("b", "lb").withColumn("rb", F.explode(F.sequence(F.col("lb"), F.col("nr") - 1))))
    b = _dealt(twin.withColumnRenamed("b", "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb")))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):  # a block that no row fell in
            return pa.table({"point_id": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        (own, x), (other, y), twice = _unpack(a), _unpack(b), a.column("lb")[0].as_py() != a.column("rb")[0].as_py()
        x2, y2, rows, cols = (x**2).sum(1), (y**2).sum(1), np.zeros(len(x)), np.zeros(len(y))
        room = np.empty(TILE[0] * TILE[1])
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                p, q = x[i : i + TILE[0]], y[j : j + TILE[1]]
                d2 = np.matmul(p, q.T, out=room[: len(p) * len(q)].reshape(len(p), len(q)))
                d2 *= -2
                d2 += x2[i : i + TILE[0], None]
                d2 += y2[j : j + TILE[1]]
                v = fn(np.maximum(d2, 0, out=d2)).astype(float, copy=False)
                rows[i : i + TILE[0]] += v @ np.ones(v.shape[1])
                if twice:
                    cols[j : j + TILE[1]] += np.ones(v.shape[0]) @ v
        ids, sums = (np.concatenate([own, other]), np.concatenate([rows, cols])) if twice else (own, rows)
        return pa.table({"point_id": pa.array(ids, pa.int64()), "s": pa.array(sums, pa.float64())})

    return a.cogroup(b).applyInArrow(cell, "point_id long, s double").groupBy("point_id").agg(F.sum("s").alias("s"))


def density(points: DataFrame, radius: float) -> DataFrame:
    """``(point_id, n_neighbors)``: points closer than ``radius``, the point itself included."""
    return _pair_sums(points, lambda d2: d2 < radius * radius).select("point_id", F.col("s").cast("long").alias("n_neighbors"))


def kde_weights(points: DataFrame, bandwidth: float = 1.0, exponent: float = 1.0) -> DataFrame:
    """``(point_id, weight)``: the inverse Gaussian kernel density to the power ``exponent``, adding up to 1."""
    found = _pair_sums(points, lambda d2: np.exp(-d2 / (2 * bandwidth * bandwidth))).withColumn("v", F.pow("s", F.lit(-exponent)))
    return found.crossJoin(F.broadcast(found.agg(F.sum("v").alias("t")))).select("point_id", (F.col("v") / F.col("t")).alias("weight"))


def geodesic(points: DataFrame, k: int, root: int, metric: str = "euclidean", rounds: int | None = None) -> DataFrame:
    """``(point_id, pt)``: distance from ``root`` along the undirected graph of ``k`` nearest neighbours.

    Relaxation in DataFrames until nothing changes: each round joins the points
    that came nearer in the last one with their links and takes a minimum per
    point, with a checkpoint in between; rounds follow the number of links on
    the longest shortest path.  An unconnected graph is an error, and so is
    a bound of ``rounds``, if given, that is met before the distances settle.
    """
    spark = points.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
    near = knn(points, k, metric)
    ways = F.array(F.struct("point_id", "neighbor_id"), F.struct(F.col("neighbor_id").alias("point_id"), F.col("point_id").alias("neighbor_id")))
    links = near.select(F.explode(ways).alias("way"), "dist").select("way.*", "dist").distinct().checkpoint()  # the neighbours are found once
    reach = points.select(F.col("point_id").cast("long").alias("point_id")).where(F.col("point_id") == root).withColumn("pt", F.lit(0.0)).checkpoint()
    moved, done = reach, 0
    while not moved.isEmpty():
        if rounds is not None and done == rounds:
            raise RuntimeError(f"distances did not settle in {rounds} rounds")
        done += 1
        step = moved.join(links, "point_id").groupBy(F.col("neighbor_id").alias("point_id")).agg(F.min(F.col("pt") + F.col("dist")).alias("near"))
        both = reach.join(step, "point_id", "full").select("point_id", "pt", "near").checkpoint()
        nearer = F.col("near").isNotNull() & (F.col("pt").isNull() | (F.col("near") < F.col("pt")))
        moved = both.where(nearer).select("point_id", F.col("near").alias("pt"))
        reach = both.select("point_id", F.least("pt", "near").alias("pt"))
    if reach.count() < points.count():
        raise ValueError("the neighbour graph is not connected; use more neighbours")
    return reach
