"""Statistics of features along a graph: explained variance, correlation and regression with pseudotime, label shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import ensure_checkpoint_dir
from .assign import coordinates, nearest_node


def feature_r2(assigned: DataFrame) -> DataFrame:
    """``(dim, r2)`` of ``assigned (point_id, node_id, x)``: variance of the node means over the variance of the feature."""
    long = coordinates(assigned.where("node_id >= 0"), "node_id")
    per = long.groupBy("node_id", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    fitted = per.groupBy("dim").agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2)).alias("fit"))
    whole = long.groupBy("dim").agg(F.var_pop("v").alias("var"))
    return fitted.join(whole, "dim").select("dim", (F.col("fit") / F.nullif("var", F.lit(0.0))).alias("r2"))


def explained_features(reduced: DataFrame, full: DataFrame, y: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """``(dim, r2)`` of the features of ``full`` above ``threshold``; points are assigned by ``reduced``. Both have (point_id, x)."""
    own = nearest_node(reduced, y).select("point_id", "node_id")
    return feature_r2(full.select("point_id", "x").join(own, "point_id")).where(F.col("r2") > threshold)


def node_embedding(assigned: DataFrame, embedding: DataFrame, k: int) -> DataFrame:
    """``(node_id, dim, value)``: mean place of each node's points in ``embedding (point_id, x)``; null for nodes without points."""
    spark = assigned.sparkSession
    means = coordinates(embedding.join(assigned.select("point_id", "node_id"), "point_id"), "node_id").groupBy("node_id", "dim").agg(F.avg("v").alias("value"))
    grid = spark.range(k).select(F.col("id").cast("int").alias("node_id")).crossJoin(means.select("dim").distinct())
    return grid.join(means, ["node_id", "dim"], "left")


def average_rank(df: DataFrame, value: str, *group: str) -> DataFrame:
    """``df`` with ``<value>_rank``: ranks within the group, ties at their mean."""
    w = Window.partitionBy(*group).orderBy(value)
    same = Window.partitionBy(*group, value)
    return df.withColumn(f"{value}_rank", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def spearman(table: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``(traj_id, var, value)`` of ``table (traj_id, pst, var, v)``: rank correlation of each variable with pseudotime, above ``threshold`` in size."""
    ranked = average_rank(average_rank(table, "pst", "traj_id", "var"), "v", "traj_id", "var")
    return ranked.groupBy("traj_id", "var").agg(F.corr("pst_rank", "v_rank").alias("value")).where(F.abs("value") > threshold)


def linear_regression(table: DataFrame) -> DataFrame:
    """``(traj_id, var, slope, intercept, r2)`` of ``table (traj_id, pst, var, v)``."""
    return table.groupBy("traj_id", "var").agg(
        F.regr_slope("v", "pst").alias("slope"), F.regr_intercept("v", "pst").alias("intercept"), F.regr_r2("v", "pst").alias("r2")
    )


def logistic_weights(table: DataFrame, steps: int = 50) -> list[tuple]:
    """``(traj_id, var, mean, sd, class, w0, w1)`` of ``table (traj_id, var, pst, v)``.

    One-against-rest logistic curves over scaled ``pst`` by Newton's steps with a
    unit ridge.  Each step's sums cover all rows; only sums per curve reach the driver.
    """
    group = ["traj_id", "var"]
    scale = {(r[0], r[1]): (r["m"], r["s"] or 1.0) for r in table.groupBy(*group).agg(F.avg("pst").alias("m"), F.stddev_pop("pst").alias("s")).collect()}
    curves = {tuple(r): np.zeros(2) for r in table.select(*group, "v").distinct().collect()}
    rows = lambda: [(*k[:2], *map(float, scale[k[:2]]), float(k[2]), *map(float, w)) for k, w in sorted(curves.items(), key=lambda x: x[0][2])]
    kind = f"traj_id {table.schema['traj_id'].dataType.simpleString()}, var {table.schema['var'].dataType.simpleString()}, m double, s double, c double, w0 double, w1 double"
    z, p = F.col("z"), F.col("p")
    off, heavy = p - (F.col("v") == F.col("c")).cast("double"), p * (1 - p)
    for _ in range(steps):
        at = table.join(F.broadcast(table.sparkSession.createDataFrame(rows(), kind)), group)
        at = at.withColumn("z", (F.col("pst") - F.col("m")) / F.col("s")).withColumn("p", 1 / (1 + F.exp(-(F.col("w0") + F.col("w1") * F.col("z")))))
        sums = at.groupBy(*group, "c").agg(F.sum(off), F.sum(off * z), F.sum(heavy), F.sum(heavy * z), F.sum(heavy * z * z)).collect()
        moved = 0.0
        for traj, var, c, g0, g1, h0, h1, h2 in sums:
            w = curves[traj, var, c]
            step = np.linalg.solve(np.array([[h0 + 1e-6, h1], [h1, h2 + 1.0]]), np.array([g0, g1 + w[1]]))
            curves[traj, var, c] = w - step
            moved = max(moved, float(np.abs(step / np.maximum(1.0, np.abs(w))).max()))
        if moved < 1e-9:
            break
    return rows()


def logistic_r2(table: DataFrame) -> DataFrame:
    """``(traj_id, var, r2)``: of each row's likeliest class under ``logistic_weights``, over all rows; 0 where there is one class only."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    table = table.select("traj_id", "var", "pst", F.col("v").cast("double").alias("v")).where("pst is not null and v is not null").checkpoint()
    kind = table.schema["var"].dataType.simpleString()
    held: dict[tuple, list] = {}
    for traj, var, m, s, c, w0, w1 in logistic_weights(table):
        held.setdefault((traj, var, m, s), []).append((c, w0, w1))
    curves = spark.createDataFrame([(*k, v) for k, v in held.items()], f"traj_id {table.schema['traj_id'].dataType.simpleString()}, var {kind}, m double, s double, ws array<struct<c: double, w0: double, w1: double>>")
    z = (F.col("pst") - F.col("m")) / F.col("s")
    best = F.array_max(F.transform("ws", lambda w: F.struct((w["w0"] + w["w1"] * z).alias("score"), (-w["c"]).alias("less"))))  # the first of equals
    at = table.join(F.broadcast(curves), ["traj_id", "var"]).withColumn("miss", F.col("v") + best["less"])
    whole = F.var_pop("v") * F.count("v")
    r2 = F.when(F.min("v") == F.max("v"), F.lit(0.0)).otherwise(1 - F.sum(F.col("miss") * F.col("miss")) / whole)
    return at.groupBy("traj_id", "var").agg(r2.alias("r2"))


def gaussian_process(t: np.ndarray, v: np.ndarray, at: np.ndarray, noise: float = 0.1) -> np.ndarray:
    """Mean of a Gaussian process with a squared-exponential kernel; the width of the marginal likelihood's best of ten."""
    scale, mean, sd = (np.ptp(t) or 1.0), v.mean(), v.std() or 1.0
    z, best = (v - mean) / sd, None
    for width in scale * np.logspace(-1.5, 0.5, 10):
        k = np.exp(-((t[:, None] - t) ** 2) / (2 * width**2)) + noise * np.eye(len(t))
        chol = np.linalg.cholesky(k)
        a = np.linalg.solve(chol.T, np.linalg.solve(chol, z))
        score = -0.5 * z @ a - np.log(np.diag(chol)).sum()
        if best is None or score > best[0]:
            best = (score, width, a)
    return mean + sd * np.exp(-((at[:, None] - t) ** 2) / (2 * best[1] ** 2)) @ best[2]


def r2_score(y: np.ndarray, predicted: np.ndarray) -> float:
    whole = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - predicted) ** 2).sum() / whole) if whole else 0.0


def regression(table: DataFrame, kind: str = "CONTINUOUS", method: str = "linear", threshold: float = 0.5, most: int = 1000) -> DataFrame:
    """``(traj_id, var, r2)`` above ``threshold``.

    Linear regressions and those of classes (BINARY, CATEGORICAL) cover all rows.
    ``gpr`` is fitted per trajectory and variable on a hash-ordered sample of
    ``most`` rows, which bounds what a task holds.
    """
    if kind in ("CONTINUOUS", "ORDINAL") and method == "linear":
        return linear_regression(table).select("traj_id", "var", "r2").where(F.col("r2") > threshold)
    if kind in ("BINARY", "CATEGORICAL"):
        return logistic_r2(table).where(F.col("r2") > threshold)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        t, v = rows["pst"].to_numpy(float), rows["v"].to_numpy(float)
        if method == "gpr":
            predicted = gaussian_process(t, v, t)
        else:
            raise ValueError(f"no such regression: {method}")
        return pd.DataFrame({"traj_id": [rows["traj_id"].iloc[0]], "var": [rows["var"].iloc[0]], "r2": [r2_score(v, predicted)]})

    order = Window.partitionBy("traj_id", "var").orderBy(F.xxhash64("pst", "v"), "pst", "v")
    sample = table.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")
    kinds = f"traj_id int, var {table.schema['var'].dataType.simpleString()}, r2 double"
    return sample.groupBy("traj_id", "var").applyInPandas(one, kinds).where(F.col("r2") > threshold)


def pseudotime_curve(table: DataFrame, points: int = 100) -> DataFrame:
    """``(traj_id, var, pst, value)``: the linear regression on a grid over each trajectory's pseudotime."""
    ends = table.groupBy("traj_id", "var").agg(F.min("pst").alias("lo"), F.max("pst").alias("hi"))
    grid = linear_regression(table).join(ends, ["traj_id", "var"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    return grid.select("traj_id", "var", t.alias("pst"), (F.col("intercept") + F.col("slope") * t).alias("value"))


def label_shares(assigned: DataFrame, label: str) -> DataFrame:
    """``(node_id, label, ratio)``: the share of each label among a node's points."""
    per = assigned.where("node_id >= 0").groupBy("node_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return per.select("node_id", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("node_id"))).alias("ratio"))


def label_entropy(labelled: DataFrame) -> DataFrame:
    """``(branch_id, h)`` of ``labelled (branch_id, label)``: entropy of the labels over the logarithm of their number, times the points."""
    per = labelled.groupBy("branch_id", "label").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("branch_id")))
    p = F.col("n") / F.col("all")
    return per.groupBy("branch_id").agg(F.when(F.max("all") > 1, F.sum(-p * F.log(p)) / F.log(F.max("all")) * F.max("all")).otherwise(1.0).alias("h"))


def label_loss(entropy: DataFrame, points: int, pull: float = 0.01) -> float:
    """The penalty of labels that mix on branches: the entropies' sum over the number of points, times ``pull``."""
    return float((entropy.agg(F.sum("h")).first()[0] or 0.0) * pull / max(points, 1))


def edge_means(projected: DataFrame, feature: DataFrame, g: Graph) -> DataFrame:
    """``(edge_id, value)``: mean of ``feature (point_id, v)``, scaled to 0..1, over the points of each edge; an empty edge takes its neighbours' mean."""
    ends = feature.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = feature.crossJoin(F.broadcast(ends)).select("point_id", ((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("v"))
    got = {r["edge_id"]: r["m"] for r in projected.join(scaled, "point_id").where("edge_id is not null").groupBy("edge_id").agg(F.avg("v").alias("m")).collect()}
    rows = []
    for e, (a, b) in enumerate(g.edges.tolist()):
        near = [got[i] for i, (c, d) in enumerate(g.edges.tolist()) if i != e and {a, b} & {c, d} and i in got]
        rows.append((e, got.get(e, float(np.mean(near)) if near else None)))
    return projected.sparkSession.createDataFrame(rows, "edge_id int, value double")


def leaf_points(projected: DataFrame, g: Graph, leaves: list[int] | None = None) -> DataFrame:
    """``projected`` rows that lie beyond a leaf, with ``leaf`` and the squared distance from it: their node is the leaf and they fall outside its edge."""
    degree = g.degrees()
    rows = []
    for e, (a, b) in enumerate(g.edges.tolist()):
        for leaf, at_start in ((a, True), (b, False)):
            if degree[leaf] == 1 and (leaves is None or leaf in leaves):
                rows.append((leaf, e, at_start))
    table = projected.sparkSession.createDataFrame(rows, "node_id int, edge_id int, at_start boolean")
    out = projected.join(F.broadcast(table), ["node_id", "edge_id"])
    return out.where(F.when(F.col("at_start"), F.col("edge_loc") < 0).otherwise(F.col("edge_loc") > 1)).withColumn("leaf", F.col("node_id"))
