"""Points without a place, clouds far from the origin, and streams that start again."""

import numpy as np
from pyspark.sql import functions as F

from filigree.cloud import PointCloud, SparkEngine
from filigree.graph import Graph
from filigree.operators import assign as A
from filigree.operators import project as J
from filigree.streaming.score import Drift, score

LINE = Graph(np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]), np.array([[0, 1], [1, 2]]), 0.01, 0.1)
ODD = [(1, [0.4, 0.1]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [1.9, 0.2]), (8, [])]


def odd(spark):
    return spark.createDataFrame(ODD, "point_id long, x array<double>")


def test_points_without_a_place_have_nulls(spark):
    points = odd(spark)
    for found, column in ((A.nearest_node(points, LINE.y), "node_id"), (score(points, LINE), "node_id"), (A.barycentric(points, LINE.y), "node_id"), (A.distance_arrays(points, LINE.y), "d2s")):
        rows = {r["point_id"]: r[column] for r in found.collect()}
        assert len(rows) == len(ODD) and [i for i, v in rows.items() if v is not None] == [1, 7]
    made = {r["point_id"]: r for r in J.project(points, LINE).collect()}
    assert made[1]["edge_id"] == 0 and np.isclose(made[1]["edge_loc"], 0.4) and np.allclose(made[7]["x_proj"], [1.9, 0])
    assert all(made[3][c] is None for c in ("node_id", "d2", "edge_id", "edge_loc", "d2_proj", "x_proj"))
    assert A.radial_count(points, LINE.y, [0.5]).first()["n_pairs"] == 2
    own = A.nearest_node(points, LINE.y, keep=["x"]).withColumn("w", F.lit(1.0))
    assert {(r["node_id"], r["rel_size"]) for r in A.node_means(own).collect()} == {(0, 0.5), (2, 0.5)}


def test_reports_far_from_the_origin(spark):
    x = np.random.default_rng(0).normal(0, 1, (400, 2))
    far = 1e9
    points = spark.createDataFrame([(i, [float(a + far), float(b + far)], 1.0) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "point_id long, x array<double>, w double").repartition(5)
    row, _ = J.fit_report(points, LINE.with_positions(LINE.y + far))
    near, _ = J.fit_report(points.where("x is not null").withColumn("x", F.transform("x", lambda v: v - far)), LINE)
    assert np.isclose(row["fve"], near["fve"], atol=1e-5) and np.isclose(row["fvep"], near["fvep"], atol=1e-5)
    mean, cov = SparkEngine(PointCloud(points).points, 2, 400).moments()
    assert np.allclose(mean - far, x.mean(0), atol=1e-5) and np.allclose(cov, np.cov(x, rowvar=False), atol=1e-5)


def test_drift_goes_on_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/drift"
    one = Drift(LINE, path=path)
    for batch in (0, 1):
        one.update(odd(spark), batch)
    one.step()
    again = Drift(LINE, path=path)
    again.update(odd(spark), 1)  # delivered again
    assert again.last == 1 and again.stats.total == 4 and np.allclose(again.stats.sums, one.stats.sums)
    again.update(odd(spark), 2)
    assert again.stats.total == 6 and Drift(LINE, path=path).stats.total == 6
