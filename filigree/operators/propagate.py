"""Labels carried along pseudotime, window by window."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import even_bins
from .neighbours import TILE, _cells, _unpack, knn_join


#: Tasks of a round of transport by blocks.
TASKS = 48


def sinkhorn(cost: np.ndarray, reg: float, reg_mass: float | None = None, equal: bool = False, rounds: int = 500) -> np.ndarray:
    """Entropic transport between equal weights; with ``reg_mass`` marginals bind softly. ``equal`` keeps the target's marginal exact."""
    a, b = np.full(cost.shape[0], 1 / cost.shape[0]), np.full(cost.shape[1], 1 / cost.shape[1])
    scale = cost.max() or 1.0
    kernel = np.exp(-cost / scale / reg)
    kernel = np.maximum(kernel, 1e-300)
    u, v = np.ones_like(a), np.ones_like(b)
    power = 1.0 if reg_mass is None else reg_mass / (reg_mass + reg)
    for _ in range(rounds):
        new = (a / (kernel @ v)) ** power
        v = (b / (kernel.T @ new)) ** (1.0 if equal else power)
        if np.max(np.abs(new - u)) < 1e-12 * np.max(np.abs(new)):
            u = new
            break
        u = new
    return u[:, None] * kernel * v


def propagate(source: DataFrame, target: DataFrame, flavor: str = "knn", n_neighbors: int = 20, reg: float = 0.01, reg_mass: float = 0.001, metric: str = "euclidean", most: int = 4096) -> DataFrame:
    """``(point_id, label)`` of ``target (point_id, x)`` from ``source (point_id, x, label)``: the label with most weight, of equals the smallest.

    ``knn``: one vote per neighbour, distributed.  The transport flavours couple two windows: up to ``most`` points
    one task holds the matrix, beyond it is made anew by pairs of blocks in each round, and never held; each round
    takes time by the product of the windows' points, the driver holds a number per point.
    """
    if flavor == "knn":
        ask, have = target.select("point_id", "x", F.lit(0).alias("g")), source.select("point_id", "x", F.lit(0).alias("g"))
        near = knn_join(ask, have, n_neighbors, metric, with_self=True)
        votes = near.join(source.select(F.col("point_id").alias("neighbor_id"), "label"), "neighbor_id").groupBy("point_id", "label").agg(F.count("*").alias("n"))
        return votes.groupBy("point_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    if flavor not in ("ot", "ot_unbalanced", "ot_equal"):
        raise ValueError(f"no such flavor: {flavor}")
    if max(source.count(), target.count()) > most:
        return _coupled_by_blocks(source, target, flavor, reg, reg_mass)

    def couple(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        s, t = s.sort_values("point_id"), t.sort_values("point_id")
        x, y = np.stack(s["x"].to_numpy()), np.stack(t["x"].to_numpy())
        cost = ((x[:, None] - y) ** 2).sum(2)
        plan = sinkhorn(cost, reg, None if flavor != "ot_unbalanced" else reg_mass, flavor == "ot_equal")
        names = np.unique(s["label"])
        weight = np.stack([plan[(s["label"] == n).to_numpy()].sum(0) for n in names])
        return pd.DataFrame({"point_id": t["point_id"].to_numpy(), "label": names[weight.argmax(0)]})

    one = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns], F.lit(0).alias("_g")).groupBy("_g")
    kind = source.schema["label"].dataType.simpleString()
    return one(source).cogroup(one(target)).applyInPandas(couple, f"point_id long, label {kind}")


def _coupled_by_blocks(source: DataFrame, target: DataFrame, flavor: str, reg: float, reg_mass: float, rounds: int = 500) -> DataFrame:
    """What ``propagate`` gives for windows of any size: the rounds of ``sinkhorn`` as sums over pairs of blocks."""
    spark = source.sparkSession
    kind = source.schema["label"].dataType.simpleString()
    names = sorted(r[0] for r in source.select("label").where("label is not null").distinct().collect())  # labels, not rows
    code = spark.createDataFrame(list(enumerate(names)), f"code int, label {kind}")
    x = F.col("x").cast("array<double>")
    # A source's label travels as a last coordinate.
    have = source.join(F.broadcast(code), "label", "left").select("point_id", F.concat(x, F.array(F.coalesce("code", F.lit(-1)).cast("double"))).alias("x"), F.lit(0).alias("g"))
    a, b = _cells(have, target.select("point_id", x.alias("x"), F.lit(0).alias("g")))

    def paired(p: pa.Table, q: pa.Table) -> pa.Table:
        both = p.num_rows and q.num_rows  # else a block that no row fell in
        p, q = (p, q) if both else (p.slice(0, 0), q.slice(0, 0))
        keys = {n: (p if both else q).column(n) for n in ("lb", "rb")}
        return pa.table(keys | {f"{n}{side}": t.column(n) for side, t in (("l", p), ("r", q)) for n in ("d", "ids", "x")})

    cells = a.cogroup(b).applyInArrow(paired, "lb int, rb int, dl int, idsl binary, xl binary, dr int, idsr binary, xr binary").coalesce(TASKS).persist(StorageLevel.DISK_ONLY)

    def each(make, schema: str) -> DataFrame:
        """``make`` of every cell: numbers of its blocks, coded sources, ids and places of targets."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    t = pa.Table.from_batches([batch.slice(i, 1)])
                    side = lambda s: _unpack(pa.table({n: t.column(f"{n}{s}") for n in ("d", "ids", "x")}))
                    (_, x), (ids, y) = side("l"), side("r")
                    yield pa.RecordBatch.from_pydict(make(t["lb"][0].as_py(), t["rb"][0].as_py(), x[:, :-1], x[:, -1].astype(int), ids, y))

        return cells.mapInArrow(run, schema)

    ints, raw = lambda *v: pa.array(v, pa.int32()), lambda v: pa.array([np.ascontiguousarray(v, float).tobytes()], pa.binary())

    def costs(x, y):
        """Tiles of the cost matrix with their places."""
        x2, y2 = (x**2).sum(1), (y**2).sum(1)
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                p, q = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                d = x[p] @ y[q].T
                d *= -2
                d += x2[p, None]
                d += y2[q]
                yield p, q, np.maximum(d, 0, out=d)

    def widest(lb, rb, x, c, ids, y):
        return {"l": ints(lb), "r": ints(rb), "nl": ints(len(x)), "nr": ints(len(y)), "top": pa.array([max(d.max() for _, _, d in costs(x, y))], pa.float64())}

    found = each(widest, "l int, r int, nl int, nr int, top double").collect()  # a row per cell
    scale = max((r["top"] for r in found), default=0.0) or 1.0
    nl, nr = {r["l"]: r["nl"] for r in found}, {r["r"]: r["nr"] for r in found}
    n, m = sum(nl.values()), sum(nr.values())
    u, v = {i: np.ones(k) for i, k in nl.items()}, {i: np.ones(k) for i, k in nr.items()}
    power = 1.0 if flavor != "ot_unbalanced" else reg_mass / (reg_mass + reg)

    def kernel(d):
        d /= -scale * reg
        return np.maximum(np.exp(d, out=d), 1e-300, out=d)

    def product(held: dict, turned: bool) -> dict:
        """The kernel, or the turned kernel, times a vector in blocks."""
        sent = spark.sparkContext.broadcast(held)

        def part(lb, rb, x, c, ids, y):
            w, out = sent.value[lb if turned else rb], np.zeros(len(y) if turned else len(x))
            for p, q, d in costs(x, y):
                if turned:
                    out[q] += w[p] @ kernel(d)
                else:
                    out[p] += kernel(d) @ w[q]
            return {"b": ints(rb if turned else lb), "raw": raw(out)}

        sums = {i: np.zeros(k) for i, k in (nr if turned else nl).items()}
        for r in each(part, "b int, raw binary").collect():  # a number per point and block of the other side
            sums[r["b"]] += np.frombuffer(r["raw"])
        sent.unpersist()
        return sums

    for _ in range(rounds):
        new = {i: (1 / n / s) ** power for i, s in product(v, False).items()}
        v = {i: (1 / m / s) ** (1.0 if flavor == "ot_equal" else power) for i, s in product(new, True).items()}
        moved, top = max(np.abs(new[i] - u[i]).max() for i in new), max(np.abs(s).max() for s in new.values())
        u = new
        if moved < 1e-12 * top:
            break
    sent = spark.sparkContext.broadcast((u, v))

    def weights(lb, rb, x, c, ids, y):
        us, vs = sent.value[0][lb], sent.value[1][rb]
        out, own = np.zeros((len(names), len(y))), np.zeros((len(names), len(x)))
        own[c[c >= 0], np.flatnonzero(c >= 0)] = us[c >= 0]
        for p, q, d in costs(x, y):
            out[:, q] += own[:, p] @ kernel(d)
        return {"r": ints(rb), "ids": pa.array([ids.tobytes()], pa.binary()), "raw": raw(out * vs)}

    def pick(t: pa.Table) -> pa.Table:
        ids = np.frombuffer(t.column("ids")[0].as_py(), np.int64)
        total = sum(np.frombuffer(w.as_py()).reshape(len(names), len(ids)) for w in t.column("raw"))
        return pa.table({"point_id": pa.array(ids, pa.int64()), "code": pa.array(total.argmax(0), pa.int32())})

    won = each(weights, "r int, ids binary, raw binary").groupBy("r").applyInArrow(pick, "point_id long, code int")
    return won.join(F.broadcast(code), "code").select("point_id", "label")


def early_groups(points: DataFrame, n_windows: int = 20, flavor: str = "knn", n_neighbors: int = 20, **kwargs) -> DataFrame:
    """``(point_id, window, group)`` of ``points (point_id, x, pt, label)``: labels of the last windows carried back to the first.

    Points without pseudotime take no part.  A window holds equal numbers of points; the labels that points have
    themselves count in the last window only, before it each window takes them from the next.
    """
    binned = even_bins(points.where("pt is not null"), "pt", "point_id", n_windows).select(F.col("point_id").cast("long").alias("point_id"), "x", "label", F.col("bin").alias("window")).persist()
    last = binned.where(F.col("window") == n_windows - 1).select("point_id", "x", "label")
    parts = [last.select("point_id", F.lit(n_windows - 1).alias("window"), F.col("label").alias("group"))]
    for w in range(n_windows - 2, -1, -1):  # a job's plan grows by one join per window
        own = binned.where(F.col("window") == w).select("point_id", "x")
        found = propagate(last, own, flavor, n_neighbors, **kwargs).checkpoint()
        last = own.join(found, "point_id")
        parts.append(found.select("point_id", F.lit(w).alias("window"), F.col("label").alias("group")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
