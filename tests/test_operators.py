"""Operators without SQL, and odd inputs of those that have it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.cloud import PointCloud
from filigree.functions import plane
from filigree.functions import vectors as V
from filigree.graph import Graph, uniform
from filigree.operators import assign as A
from filigree.operators import bins as B
from filigree.operators import editing as E
from filigree.operators import neighbours as N
from filigree.operators import paths as P
from filigree.operators import project as J
from filigree.operators import propagate as L
from filigree.operators import trajectories as T
from filigree.plans import plotdata, topologies
from filigree.sources import readers, store, synthetic
from filigree.streaming.score import Drift

TREE = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7), (3, 8), (8, 9)]


def graph(seed=0, m=2):
    return uniform(np.random.default_rng(seed).standard_normal((10, m)), np.array(TREE), 0.01, 0.1)


def points(spark, x):
    return readers.from_array(spark, x)


# ---- plane ----------------------------------------------------------------------


def test_plane_geometry():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]])
    assert plane.polygon_area(square[:, 0], square[:, 1]) == 4
    assert np.isclose(plane.compactness(square), 4 * np.pi * 4 / 36)
    assert plane.in_hull(square, np.array([[1, 1], [2, 2], [3, 1.0]])).tolist() == [True, False, False]
    assert np.allclose(plane.inset(square, 0.1)[0], [0.1 * 2**0.5] * 2)
    assert plane.line_crossing([0, 0], [1, 1], [0, 2], [2, 0]) == (1.0, 1.0)
    assert plane.line_crossing([0, 0], [1, 0], [0, 1], [1, 1])[0] == float("inf")
    y, e = plane.remove_crossings(np.array([[0, 0], [2, 2], [0, 2], [2, 0.0]]), [(0, 1), (2, 3)])
    assert len(y) == 5 and len(e) == 4 and np.allclose(y[4], 1)
    d = plane.mahalanobis(np.random.default_rng(0).standard_normal((500, 2)), np.zeros(2))
    assert np.isclose((d**2).mean(), 2, atol=0.1)
    w = plane.centre_weights(np.array([[1, 1], [1.5, 1], [1.9, 1.0]]), square, np.array([(0, 1), (1, 2), (2, 3), (0, 3)]), np.array([1, 1.0]) + 1e-9)
    assert w[0] == 1 and w[1] == 1 and np.isclose(w[2], 0.1, atol=1e-6)  # above the threshold in full, the others as they are
    low = plane.centre_weights(np.array([[1.5, 1.0]]), square, np.array([(0, 1), (1, 2), (2, 3), (0, 3)]), np.array([1, 1.0]) + 1e-9, threshold=0.6)
    assert np.isclose(low[0], 0.5, atol=1e-6)
    flat = np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])  # no spread across the diagonal
    assert np.allclose(plane.mahalanobis(flat, flat.mean(0)), np.abs(np.arange(4) - 1.5) / np.std(np.arange(4), ddof=1))


def test_vector_expressions(spark):
    row = spark.sql("select array(1d, 2d) a, array(4d, 6d) b, array(0d, 0d) z")
    got = row.select(
        V.sqdist(F.col("a"), F.col("b")), V.edge_share(F.col("b"), F.col("z"), F.col("a")), V.edge_share(F.col("a"), F.col("z"), F.col("z")),
        V.crossing(F.col("z"), F.col("a"), F.col("z"), F.col("b"))[0], V.is_between(F.col("z"), F.col("b"), F.col("a")), V.cosine_distance(F.col("a"), F.col("a")),
    ).first()
    assert [got[0], round(got[1], 9), got[2], got[3], got[4], round(got[5], 9)] == [25.0, 3.2, 0.0, 0.0, True, 0.0]


# ---- projection --------------------------------------------------------------------


def test_projection_is_never_farther_than_the_node(spark):
    g, x = graph(), np.random.default_rng(1).standard_normal((400, 2))
    rows = J.project(points(spark, x), g).collect()
    assert all(r["d2_proj"] <= r["d2"] + 1e-12 for r in rows)
    one = J.project(points(spark, g.y[:1]), g).first()
    assert one["d2"] < 1e-12 and one["edge_id"] == 0
    far = J.project(points(spark, x + 100), g, 1.0).first()
    assert far["node_id"] == -1 and far["edge_id"] is None


def test_report_of_a_perfect_fit(spark):
    g = graph()
    row, _ = J.fit_report(PointCloud(points(spark, g.y)).points, g)
    assert abs(row["mse"]) < 1e-12 and abs(row["fve"] - 1) < 1e-9 and row["nnodes"] == 10


# ---- neighbours -------------------------------------------------------------------------


def test_blocks_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 17)
    x = np.random.default_rng(2).standard_normal((90, 4))
    x[50] = x[51] = x[52]
    got = {}
    for r in N.knn(points(spark, x), 4, "euclidean").orderBy("point_id", "rank").collect():
        got.setdefault(r["point_id"], []).append(r["neighbor_id"])
    for i in range(90):
        d = np.round(np.linalg.norm(x - x[i], axis=1), N.TIES)
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(90), d))[:4].tolist()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_rows_are_exact_and_bounded(metric, monkeypatch):
    """Many equal rows, zeros and places far from the origin; what is held does not follow the number of pairs."""
    import tracemalloc

    rng = np.random.default_rng(4)
    y = np.vstack([rng.standard_normal((2500, 6)), np.repeat(rng.standard_normal((1, 6)), 500, 0), np.zeros((3, 6))])[rng.permutation(3003)]
    for shift in (0.0, 1e4):
        x, ids = y[:700] + shift, np.arange(3003)
        got = N.nearest_rows(ids[:700], x, ids, y + shift, 7, metric)
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y + shift, axis=1)
        d = 1 - np.divide(x @ (y + shift).T, n, out=np.zeros_like(n), where=n > 0) if metric == "cosine" else np.sqrt(((x[:, None] - y - shift) ** 2).sum(2))
        d = np.round(d, N.TIES) + 0.0
        d[ids[:700, None] == ids] = np.inf
        assert got[1].reshape(700, 7).tolist() == np.argsort(d, axis=1, kind="stable")[:, :7].tolist()
    big = rng.standard_normal((8000, 8))
    tracemalloc.start()
    N.nearest_rows(np.arange(8000), big, np.arange(8000), big, 5, metric)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # the pairs as doubles take 512 MB
    tracemalloc.stop()


def test_few_large_blocks_are_copied(spark):
    """A table of 30,000 rows is cut in 12 blocks, so that each row goes to 12 cells a side, packed: a row per cell."""
    df = spark.range(30_000).select(F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("x"), F.lit(0).alias("g"))
    grid = F.broadcast(df.groupBy("g").agg(N._blocks(F.count("*")).alias("nl")).withColumn("nr", F.col("nl")))
    assert N._packed(df, grid, "nl").count() == 12
    assert spark.range(1).select(N._blocks(F.lit(600_000))).first()[0] == 19


def test_stages_and_limits(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 3))
    df = points(spark, x).withColumn("stage", F.concat(F.lit("s"), (F.col("point_id") % 4).cast("string")))
    for r in N.knn_guide(df, 5).collect():
        assert abs(r["point_id"] % 4 - r["neighbor_id"] % 4) <= 1
    force = N.knn_force(df, 2).groupBy("point_id").count().collect()
    assert {r["count"] for r in force} == {6}
    both = N.supervised_knn(df, 6, 2, method="guide").groupBy("point_id").agg(F.count("*").alias("n"), F.countDistinct("neighbor_id").alias("d")).collect()
    assert all(r["n"] == r["d"] <= 6 for r in both)
    with pytest.raises(ValueError):
        N.supervised_knn(df, 7)


def test_geodesic_is_dijkstras(spark):
    import heapq

    x = np.random.default_rng(4).random((60, 2))
    got = {r["point_id"]: r["pt"] for r in N.geodesic(points(spark, x), 6, 0).collect()}
    d = np.round(np.linalg.norm(x[:, None] - x, axis=2), N.TIES)
    near = {i: set(np.argsort(np.where(np.arange(60) == i, np.inf, d[i]), kind="stable")[:6].tolist()) for i in range(60)}
    best, todo = {}, [(0.0, 0)]
    while todo:
        c, i = heapq.heappop(todo)
        if i not in best:
            best[i] = c
            for j in range(60):
                if j in near[i] or i in near[j]:
                    heapq.heappush(todo, (c + d[i, j], j))
    assert got.keys() == best.keys() and all(abs(got[i] - best[i]) < 1e-9 for i in best)
    with pytest.raises(ValueError):
        N.geodesic(points(spark, np.vstack([x, x + 100])), 2, 0)


# ---- windows -----------------------------------------------------------------------------------


def test_order_over_ranges(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, v double")
    got = {r["id"]: r["rn"] for r in B.ordered(df, "v", "id", ranges=16).collect()}
    order = np.lexsort((np.arange(500), v))
    assert [got[int(i)] for i in order] == list(range(1, 501))


@pytest.mark.parametrize("kind", ["double", "int", "long", "decimal(12,2)", "decimal(38,2)"])
@pytest.mark.parametrize("ranges", [2, 16, 64])
def test_order_with_nulls_and_frequent_values(spark, kind, ranges):
    rng = np.random.default_rng(8)
    n = 600
    v = [None if p < 0.3 else 7 if p < 0.7 else int(x) for p, x in zip(rng.random(n), rng.integers(-20, 40, n))]
    tie = rng.permutation(n)
    df = spark.createDataFrame([(i, x, int(t)) for i, (x, t) in enumerate(zip(v, tie))], "id long, v int, tie long")
    made = B.ordered(df.withColumn("v", F.col("v").cast(kind)), "v", "tie", F.lit(2.0), ranges)
    got = {r["id"]: (r["rn"], r["cum"], r["n"], r["all_w"]) for r in made.collect()}
    order = sorted(range(n), key=lambda i: (v[i] is not None, v[i] or 0, tie[i]))
    assert [got[i] for i in order] == [(k, 2.0 * k, n, 2.0 * n) for k in range(1, n + 1)]


def test_order_of_odd_rows(spark):
    rows = [(0, float("nan"), "b"), (1, float("nan"), "a"), (2, None, "c"), (3, 1.0, None), (4, 1.0, "a"), (5, float("inf"), "d")]
    got = B.ordered(spark.createDataFrame(rows, "id long, v double, tie string"), "v", "tie").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rn"])] == [2, 3, 4, 5, 1, 0]
    empty = spark.createDataFrame([], "id long, v double, tie long")
    assert B.ordered(empty, "v", "tie").count() == 0
    nulls = spark.createDataFrame([(1, None), (0, None)], "id long, v double")
    assert [(r["id"], r["rn"]) for r in B.ordered(nulls, "v", "id").orderBy("id").collect()] == [(0, 1), (1, 2)]


def test_halving_counts_the_cuts_below(spark):
    for n in (1, 2, 3, 7, 8, 9, 100):
        cuts = [float(c) for c in range(0, 2 * n, 2)]
        rows = spark.range(-2, 2 * n + 2).select(F.col("id").cast("double").alias("v")).withColumn("at", B._place(F.col("v"), cuts)).collect()
        assert all(r["at"] == sum(c < r["v"] for c in cuts) for r in rows)


@pytest.mark.parametrize("n,b", [(30, 7), (100, 20), (5, 5), (3, 5)])
def test_even_bins(spark, n, b):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, v double")
    got = [r["bin"] for r in B.even_bins(df, "v", "id", b).orderBy("id").collect()]
    assert got == [((i + 1) * b - 1) // n for i in range(n)]


def test_equal_width_falls_back_and_gaps(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.2), (3, 10.0)], "id long, v double")
    assert [r["bin"] for r in B.equal_width_bins(df, "v", 5).orderBy("id").collect()] == [0, 0, 0, 4]
    assert [r["bin"] for r in B.bin_pseudotime(df, "v", "id", 4).orderBy("id").collect()] == [0, 1, 2, 3]
    same = spark.createDataFrame([(0, 1.0), (1, 1.0)], "id long, v double")
    assert {r["bin"] for r in B.equal_width_bins(same, "v", 3).collect()} == {0}
    gaps = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, float("nan")), (4, 4.0), (5, None)], "pos int, v double")
    assert [r["filled"] for r in B.fill_gaps(gaps, "pos", "v").orderBy("pos").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    ends = gaps.agg(B.first_known("v", "pos").alias("a"), B.last_known("v", "pos").alias("b"), B.first_gap("v", "pos").alias("c")).first()
    assert (ends["a"], ends["b"], ends["c"]) == (1.0, 4.0, 0)
    assert np.allclose(B.resample(np.array([[0, 0], [0, 1], [0, 4.0]])), [[0, 0], [0, 2], [0, 4]])


# ---- paths ---------------------------------------------------------------------------------------


def test_structures():
    g = graph()
    assert P.branches(g) == [[0, 1, 2, 3], [3, 4, 5, 6], [3, 7], [3, 8, 9]]
    assert P.subgraph(g, "branches&bpoints") == {"Branch_0": [0, 1, 2], "Branch_1": [4, 5, 6], "Branch_2": [7], "Branch_3": [8, 9], "BranchPoint_0": [3]}
    assert len(P.subgraph(g, "end2end")) == 6 and len(P.subgraph(g, "branching")[3]) == 4
    assert P.rooted_branches(g, 0) == [[0, 1, 2, 3], [4, 5, 6], [7], [8, 9]]
    assert [p for p, _ in P.trajectories(g, 0)][0] == [0]
    ring = Graph(np.zeros((4, 1)), [(0, 1), (1, 2), (2, 3), (0, 3)], 1.0, 1.0)
    assert P.subgraph(ring, "circle") == [0, 1, 2, 3, 0] and P.cycles(ring) == [(0, 1, 2, 3)] and len(P.branches(ring)) == 1
    eight = Graph(np.zeros((5, 1)), [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)], 1.0, 1.0)
    assert P.cycles(eight) == [(0, 1, 2), (2, 3, 4)] and P.cycles(eight, source=0) == [(0, 1, 2)]
    assert P.simple_path_through(ring, 0, 1, [2]) == [0, 3, 2, 1]
    assert set(P.vertex_branches(g)) == set(range(10))
    with pytest.raises(ValueError):
        P.root_paths(g, 3)
    with pytest.raises(ValueError):
        P.subgraph(g, "star")


def test_pseudotime_starts_at_zero_and_grows(spark):
    g = uniform(np.array([[0.0, 0], [1, 0], [2, 0], [1, 1]]), np.array([(0, 1), (1, 2), (1, 3)]), 0.01, 0.1)
    x = np.array([[0.0, 0], [0.4, 0.1], [1.2, 0], [2, 0], [1, 0.9], [-1, 0]])
    got = {r["point_id"]: r["pt"] for r in P.pseudotime(J.project(points(spark, x), g), g, 0, 2).collect()}
    assert np.allclose([got[i] for i in (0, 1, 2, 3, 5)], [0, 0.4, 1.2, 2, 0]) and got[4] is None
    back = {r["point_id"]: r["pt"] for r in P.pseudotime(J.project(points(spark, x), g), g, 2).collect()}
    assert np.allclose([back[i] for i in (0, 1, 2, 3, 4)], [2, 1.6, 0.8, 0, 1.9])


# ---- trajectories ------------------------------------------------------------------------------------


def test_regressions(spark):
    t = np.linspace(0, 1, 120)
    rows = [(0, float(a), "up", 2 * float(a) + 1) for a in t] + [(0, float(a), "class", float(a > 0.5)) for a in t] + [(0, float(a), "wave", float(np.sin(6 * a))) for a in t]
    df = spark.createDataFrame(rows, "traj_id int, pst double, var string, v double")
    lin = {r["var"]: r for r in T.linear_regression(df).collect()}
    assert np.isclose(lin["up"]["slope"], 2) and np.isclose(lin["up"]["r2"], 1)
    assert T.spearman(df.where("var = 'up'")).first()["value"] == pytest.approx(1)
    cls = T.regression(df.where("var = 'class'"), "BINARY", threshold=-1).first()["r2"]
    gpr = T.regression(df.where("var = 'wave'"), method="gpr", threshold=-1).first()["r2"]
    assert cls > 0.9 and gpr > 0.9
    with pytest.raises(Exception):
        T.regression(df, method="kr").collect()


# ---- propagation --------------------------------------------------------------------------------------


@pytest.mark.parametrize("flavor", ["knn", "ot", "ot_unbalanced", "ot_equal"])
def test_labels_travel_to_the_near_side(spark, flavor):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2))])
    src = points(spark, x).withColumn("label", F.when(F.col("point_id") < 30, "a").otherwise("b"))
    found = {r["point_id"]: r["label"] for r in L.propagate(src, points(spark, x + 0.05), flavor, 5, reg=0.05, reg_mass=0.5).collect()}
    assert all(found[i] == ("a" if i < 30 else "b") for i in range(60))


# ---- editing --------------------------------------------------------------------------------------------


def line_cloud(n=300, seed=0):
    rng = np.random.default_rng(seed)
    return np.stack([rng.random(n) * 4, rng.normal(0, 0.02, n)], 1)


def test_leaves_are_extended(spark):
    g = uniform(np.array([[1.0, 0], [2, 0], [3, 0]]), np.array([(0, 1), (1, 2)]), 0.01, 0.1)
    df = PointCloud(points(spark, line_cloud())).points
    for mode in ("QuantCentroid", "WeightedCentroid", "QuantDists"):
        made = E.extend_leaves(df, g, mode=mode, par=0.8, anneal_rounds=50)
        assert made.k == 5 and made.is_connected() and made.y[3, 0] < 0.6 and made.y[4, 0] > 3.4
    assert E.extend_leaves(df.where("point_id < 0"), g, mode="QuantCentroid").k == 3


def test_branches_collapse_and_shift(spark):
    y = np.array([[0.0, 0], [1, 0], [2, 0], [3, 0], [1, 0.2]])
    g = uniform(y, np.array([(0, 1), (1, 2), (2, 3), (1, 4)]), 0.01, 0.1)
    df = PointCloud(points(spark, line_cloud())).points
    made = E.collapse_branches(df, g, "PointNumber_Leaves", 60)
    assert made.is_connected() and made.k <= 4
    for mode in E.COLLAPSE:
        assert E.collapse_branches(df, g, mode, 0).k == g.k
    moved = E.shift_branching(df, g, "Manual", {1: 2})
    assert sorted(map(tuple, moved.edges.tolist())) == [(0, 2), (1, 2), (2, 3), (2, 4)] and moved.is_connected()
    for kwargs in ({"mode": "NodePoints"}, {"mode": "NodeDensity", "density_radius": 0.3}):
        assert E.shift_branching(df, g, **kwargs).is_connected()


def test_paths_are_added_found_and_deleted(spark):
    a = np.random.default_rng(7).random(600) * 2 * np.pi
    x = np.stack([np.cos(a), np.sin(a)], 1) + np.random.default_rng(8).normal(0, 0.02, (600, 2))
    df = PointCloud(points(spark, x)).points
    curve = topologies.curve(PointCloud(df).engine(), 14).graph
    assert not P.cycles(curve)
    ends = np.nonzero(curve.degrees() == 1)[0].tolist()
    closed = E.add_path(df, curve, *ends, n_nodes=3, allow_crossing=True)
    assert len(P.cycles(closed)) == 1 and closed.k == curve.k + 3
    found = E.find_paths(df, curve, n_nodes=6, radius=1.5, max_points=100, min_compactness=0.2, max_inner_fraction=0.5)
    assert found is None or len(P.cycles(found)) >= 1
    cut = E.delete_path(closed, ends[0], closed.neighbours()[ends[0]][0])
    assert not P.cycles(cut)
    again = E.refit_graph(df, closed, lam=0.01, mu=0.1, cycle_lam=0.02, cycle_mu=0.2)
    assert len(again.edges) == len(closed.edges)
    to_place = E.add_path(df, curve, ends[0], np.array([3.0, 0.0]), 2, allow_crossing=True)
    assert to_place.k == curve.k + 3 and np.allclose(to_place.y[-1], [3, 0])


# ---- sources, store, streams --------------------------------------------------------------------------------


def test_csv_and_store(spark, tmp_path):
    x = np.random.default_rng(9).random((50, 3)).round(4)
    np.savetxt(tmp_path / "p.csv", np.vstack([x, x[:1]]), delimiter=",")
    df = readers.read_csv(spark, str(tmp_path / "p.csv"), 3, keep=[0, 1])
    assert df.count() == 51 and df.select("point_id").distinct().count() == 51 and len(df.first()["x"]) == 2
    fitted = topologies.tree(PointCloud(df), 5, trace=True)
    store.save(spark, fitted, str(tmp_path / "g"))
    back = store.load(spark, str(tmp_path / "g"))
    assert np.allclose(back.y, fitted.graph.y) and (back.edges == fitted.graph.edges).all()
    assert fitted.report_frame(spark).count() >= 1
    assert readers.random_points(spark, 20, 4).count() == 20


def test_clouds_leave_out_broken_rows(spark):
    rows = [(1, [1.0, 2.0], None), (2, None, 1.0), (3, [1.0], 1.0), (4, [1.0, float("nan")], 1.0), (5, [None, 1.0], 1.0), (6, [3.0, 4.0], 2.0)]
    cloud = PointCloud(spark.createDataFrame(rows, "point_id long, x array<double>, w double"))
    assert (cloud.count, cloud.dim) == (2, 2) and cloud.engine().w.tolist() == [1.0, 2.0]
    assert PointCloud(spark.createDataFrame([], "point_id long, x array<double>, w double")).count == 0


def test_walks_branch():
    x, owner = synthetic.grow(synthetic.walkers(1, 10, seed=1), steps=400, chance=0.05, seed=1)
    assert x.shape[1] == 10 and owner.max() >= 1


def test_drift_counts_a_batch_once(spark):
    g, df = graph(), points(spark, np.random.default_rng(10).standard_normal((80, 2)))
    drift = Drift(g)
    drift.update(df, 0)
    drift.update(df, 0)
    assert drift.stats.total == 80
    assert np.isfinite(drift.step().y).all()


def test_layout_keeps_neighbours_near():
    at = plotdata.layout(graph())
    d = np.linalg.norm(at[:, None] - at, axis=2)
    assert max(d[a, b] for a, b in TREE) < d.max() / 2


def test_points_that_cannot_be_assigned(spark):
    rows = [(1, [0.0, 0.1]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [1.0, 1.0]), (7, [])]
    got = A.nearest_node(spark.createDataFrame(rows, "point_id long, x array<double>"), np.array([[0.0, 0.0], [1.0, 1.0]]), keep=["x"])
    assert {r["point_id"]: r["node_id"] for r in got.collect()} == {1: 0, 2: None, 3: None, 4: None, 5: None, 6: 1, 7: None}
    assert got.where("node_id is null and d2 is not null").count() == 0


def test_geodesic_follows_a_chain_to_its_end(spark):
    n = 300
    chain = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "point_id long, x array<double>")
    got = {r["point_id"]: r["pt"] for r in N.geodesic(chain, 20, 0).collect()}
    assert all(abs(got[i] - i) < 1e-9 for i in range(n))
    with pytest.raises(RuntimeError):
        N.geodesic(chain, 20, 0, rounds=3)


def test_leaf_ends_are_dealt_over_tasks(spark):
    """Costs by products are those by segments, ties go to the first, and candidates go to parts; the result is that of trying each."""
    rng = np.random.default_rng(9)
    x, a = rng.standard_normal((400, 5)), rng.standard_normal(5)
    x[7], x[300] = a, x[20]
    slow = np.array([np.quantile(E.segment_distance2(x, a, b), 0.9) for b in x])
    fast = E.end_costs(x, a, x, 0.9)
    assert np.allclose(fast, slow, atol=1e-9) and fast.argmin() == slow.argmin() and fast.min() == slow.min()
    g = Graph(np.array([[0.0, 0], [1, 0], [2, 0]]), np.array([[0, 1], [1, 2]]), np.full(2, 0.1), np.full(3, 0.1))
    y = rng.standard_normal((700, 2)) * 0.3 + [2.5, 0]
    got = E.extended_ends(points(spark, y), g, "QuantDists", 0.9, anneal_rounds=0).where("leaf = 2").orderBy("dim").collect()
    own = y[y[:, 0] > 2]
    assert [r["value"] for r in got] == own[np.argmin([np.quantile(E.segment_distance2(own, g.y[2], b), 0.9) for b in own])].tolist()


def test_transport_beyond_one_matrix(spark, monkeypatch):
    """Windows too large for one task's matrix are coupled by pairs of blocks, with the same labels."""
    from filigree.operators import propagate as L

    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((70, 3)), rng.standard_normal((60, 3)) + 0.3
    source = points(spark, x).withColumn("label", F.concat(F.lit("l"), (F.col("point_id") % 3).cast("string")))
    run = lambda most: {r["point_id"]: r["label"] for r in L.propagate(source, points(spark, y), "ot", reg=1.0, most=most).collect()}
    assert run(50) == run(100) and len(run(50)) == 60
