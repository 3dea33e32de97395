"""One query per operator over the driver's tables.

Unless said otherwise the cloud is ``embeddings``, the nodes are the labels'
centroids and the edges are EDGES, a tree with a junction of four rays at node 3.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cloud import PointCloud
from ..functions import vectors as V
from ..graph import Graph, adjust_by_constant, uniform, uniform_with_cycle
from ..operators import assign as A
from ..operators import bins as B
from ..operators import editing as E
from ..operators import neighbours as N
from ..operators import paths as P
from ..operators import project as J
from ..operators import propagate as L
from ..operators import trajectories as T
from ..session import ensure_checkpoint_dir
from ..sources import readers, store, synthetic
from ..streaming.score import Drift, occupancy, score
from . import grammar, plotdata, topologies
from .embed import Rules, embed, embed_barycentric
from .oracles import CYCLE, EDGES, LAM, MU, RADII, TRIM, sql

K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return points.select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x"), F.lit(1.0).alias("w"), *more)


def centroids(spark: SparkSession, sf_dir: str) -> np.ndarray:
    own = cloud(spark, sf_dir, F.col("label").alias("node_id"))
    return A.to_matrix(A.node_means(own), K)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return uniform(centroids(spark, sf_dir), np.array(EDGES), LAM, MU)


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def long_nodes(spark: SparkSession, rows: list[tuple[int, int, np.ndarray]]) -> DataFrame:
    """``(cand_id, node_id, dim, value)`` of places."""
    flat = [(int(c), int(n), d, round(float(v), 6)) for c, n, y in rows for d, v in enumerate(y)]
    return frame(spark, flat, "cand_id int, node_id int, dim int, value double")


def matrix(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return frame(spark, [(int(i), int(j), round(float(m[i, j]), 9)) for i, j in zip(*np.nonzero(m))], "i int, j int, value double")


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)  # no negative zero


# ---- assignment -------------------------------------------------------------


@query
def entry_node_summary(spark, sf):
    found = A.nearest_node(cloud(spark, sf), centroids(spark, sf), keep=["x"])
    return found.groupBy("node_id").agg(F.count("*").alias("n"), r(F.avg("d2")).alias("mse"), r(F.avg(F.col("x")[0])).alias("mean_x0")).orderBy("node_id")


@query
def join_1_nearest_node(spark, sf):
    found = A.nearest_node(cloud(spark, sf), centroids(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))


@query
def join_1_expression(spark, sf):
    found = A.nearest_node_expression(cloud(spark, sf), centroids(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))


@query
def prj_4_trimmed_assign(spark, sf):
    found = A.nearest_node(cloud(spark, sf), centroids(spark, sf), TRIM)
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))


def _reassigned(spark, sf, edit, **kwargs):
    y = centroids(spark, sf)
    at = (y[0] + y[1]) / 2 if edit != "remove" else None
    found = A.reassign(A.distance_arrays(cloud(spark, sf), y), edit, kwargs.get("node"), at)
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))


Q["join_3_repartition_add_node"] = partial(_reassigned, edit="add")
Q["join_3_repartition_move_node"] = partial(_reassigned, edit="move", node=0)
Q["join_3_repartition_remove_node"] = partial(_reassigned, edit="remove", node=0)


@query
def join_4_barycenter_assign(spark, sf):
    found = A.barycentric(cloud(spark, sf), centroids(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d").alias("d"))


@query
def join_5_node_distances(spark, sf):
    nodes = store.nodes_frame(spark, graph(spark, sf)).select("node_id", "y")
    other = F.broadcast(nodes.select(F.col("node_id").alias("b"), F.col("y").alias("yb")))
    return nodes.crossJoin(other).select(F.col("node_id").alias("a"), "b", r(F.sqrt(V.sqdist(F.col("y"), F.col("yb")))).alias("dist"))


@query
def join_7_radial_count(spark, sf):
    return A.radial_count(cloud(spark, sf), centroids(spark, sf), RADII)


@query
def join_8_project_graph(spark, sf):
    found = J.project(cloud(spark, sf), graph(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), "edge_id", r("edge_loc").alias("edge_loc"), r("d2_proj").alias("d2_proj"))


@query
def join_8_project_join(spark, sf):
    g, own = graph(spark, sf), cloud(spark, sf)
    found = J.project_join(A.nearest_node(own, g.y, keep=["x"]), store.nodes_frame(spark, g).select("node_id", "y"), store.edges_frame(spark, g).select("edge_id", "src", "dst"))
    return found.select(F.col("point_id").alias("vec_id"), "edge_id", r("edge_loc").alias("edge_loc"), r("d2_proj").alias("d2_proj"))


@query
def join_10_projection_points(spark, sf):
    found = J.project(cloud(spark, sf), graph(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"), F.posexplode("x_proj").alias("dim", "v")).select("vec_id", "node_id", "d2", "dim", r("v").alias("value"))


@query
def join_16_branch_members(spark, sf):
    g = graph(spark, sf)
    own = P.members(A.nearest_node(cloud(spark, sf), g.y), P.branches(g))
    return own.groupBy("path_id").agg(F.count("*").alias("n_points"))


@query
def join_19_nearest_member(spark, sf):
    own = cloud(spark, sf)
    found = A.nearest_node(own, centroids(spark, sf))
    return found.groupBy("node_id").agg(F.min_by("point_id", F.struct(F.round("d2", 9), "point_id")).alias("vec_id"))


@query
def join_20_nearest_start_node(spark, sf):
    """Fixed nodes at the means of each region's suppliers' balances are tied to the nearest node of a grid."""
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    fixed = s.groupBy("n_regionkey").agg(F.avg("s_acctbal").alias("at"))
    grid = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(range(0, 10001, 1000))])
    near = F.array_min(F.transform(grid, lambda n: F.struct(F.abs(n["v"] - F.col("at")).alias("d"), n["i"].alias("i"))))["i"]
    return fixed.select(F.col("n_regionkey").alias("fixed_id"), near.cast("int").alias("node_id"))


@query
def join_21_row_norms(spark, sf):
    return cloud(spark, sf).select(F.col("point_id").alias("vec_id"), r(V.norm2(F.col("x"))).alias("x2"))


@query
def volume_lineitem_assign(spark, sf):
    """The largest table as a cloud of three dimensions: nodes are the means per line number."""
    line = table(spark, sf, "lineitem")
    scaled = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10]
    rows = line.groupBy((F.col("l_linenumber") - 1).alias("node_id")).agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate(scaled)]).orderBy("node_id").collect()
    y = np.array([[v["c0"], v["c1"], v["c2"]] for v in rows])
    points = line.select(F.xxhash64("l_orderkey", "l_linenumber").alias("point_id"), F.array(*scaled).alias("x"))
    return A.nearest_node(points, y).groupBy("node_id").agg(F.count("*").alias("n"), r(F.avg("d2")).alias("mse"))


# ---- neighbours -------------------------------------------------------------


def _near(found: DataFrame) -> DataFrame:
    return found.select(F.col("point_id").alias("vec_id"), "rank", "neighbor_id")


@query
def join_12_knn_cosine(spark, sf):
    return _near(N.knn(cloud(spark, sf), 5))


@query
def join_13_knn_guide(spark, sf):
    return _near(N.knn_guide(cloud(spark, sf, F.col("label").alias("stage")), 5))


@query
def join_14_knn_force(spark, sf):
    return _near(N.knn_force(cloud(spark, sf, F.col("label").alias("stage")), 3))


@query
def join_15_supervised(spark, sf):
    return _near(N.supervised_knn(cloud(spark, sf, F.col("label").alias("stage")), 9, 3))


@query
def io_7_sparse_neighbours(spark, sf):
    found = N.coo(N.knn(cloud(spark, sf), 3, "euclidean"))
    return found.select("row", "col", r("value").alias("value"))


@query
def agg_12_density(spark, sf):
    return N.density(cloud(spark, sf), 1.25).withColumnRenamed("point_id", "vec_id")


@query
def agg_13_kde_weights(spark, sf):
    return N.kde_weights(cloud(spark, sf), 0.5).select(F.col("point_id").alias("vec_id"), r("weight", 9).alias("weight"))


@query
def path_19_geodesic(spark, sf):
    ensure_checkpoint_dir(spark)
    return N.geodesic(cloud(spark, sf), 15, 0).select(F.col("point_id").alias("vec_id"), r("pt").alias("pt"))


# ---- sums over nodes, branches and features ----------------------------------


@query
def agg_1_node_centers(spark, sf):
    assigned = A.nearest_node(cloud(spark, sf), centroids(spark, sf), TRIM, keep=["x", "w"])
    return A.node_means(assigned).select("node_id", "dim", r("center").alias("center"), r("rel_size").alias("rel_size"))


def _energy(spark, sf, kind, alpha, beta):
    g = graph(spark, sf)
    done = J.fit_report(cloud(spark, sf), g)[0]["mse"]
    from ..graph import energy

    e = energy(g, done, kind, alpha, beta)
    return frame(spark, [tuple(round(float(v), 6) for v in (e.total, e.mse, e.stretch, e.bend))], "energy double, mse double, ep double, rp double")


Q["agg_2_energy_base"] = partial(_energy, kind="Base", alpha=0.0, beta=0.0)
Q["agg_4_energy_penalized"] = partial(_energy, kind="Penalized", alpha=0.01, beta=0.5)


@query
def agg_6_label_entropy(spark, sf):
    g, own = graph(spark, sf), cloud(spark, sf, F.col("label").alias("label"))
    found = P.members(A.nearest_node(own, g.y), P.branches(g)).withColumnRenamed("path_id", "branch_id")
    return T.label_entropy(found.join(own.select("point_id", "label"), "point_id")).select("branch_id", r("h", 4).alias("h"))


@query
def agg_7_label_loss(spark, sf):
    own = table(spark, sf, "embeddings").count()
    return frame(spark, [(round(T.label_loss(agg_6_label_entropy(spark, sf), own), 5),)], "loss double")


@query
def agg_8_report(spark, sf):
    row, _ = J.fit_report(cloud(spark, sf), graph(spark, sf))
    from .fit import REPORT

    names = [c for c in REPORT if c != "barcode"]
    return frame(spark, [(k, round(float(row[k]), 5)) for k in names], "metric string, value double")


@query
def agg_9_barcode(spark, sf):
    from ..graph import barcode

    return frame(spark, [(barcode(graph(spark, sf)),)], "barcode string")


@query
def agg_10_degrees(spark, sf):
    g = graph(spark, sf)
    return store.adjacency(store.edges_frame(spark, g)).groupBy("u").count().groupBy(F.col("count").cast("int").alias("degree")).agg(F.count("*").alias("n"))


def _assigned(spark, sf):
    own = cloud(spark, sf)
    return A.nearest_node(own, centroids(spark, sf)).join(own, "point_id")


@query
def agg_15_feature_r2(spark, sf):
    return T.feature_r2(_assigned(spark, sf)).select("dim", r("r2").alias("r2"))


@query
def agg_16_selected(spark, sf):
    own = cloud(spark, sf)
    return T.explained_features(own, own, centroids(spark, sf), 0.02).select("dim", r("r2").alias("r2"))


@query
def agg_17_proj_embedding(spark, sf):
    plane = cloud(spark, sf).select("point_id", F.slice("x", 1, 2).alias("x"))
    return T.node_embedding(_assigned(spark, sf), plane, K).select("node_id", "dim", r("value").alias("value"))


@query
def agg_18_leaf_quantile(spark, sf):
    beyond = T.leaf_points(J.project(cloud(spark, sf), graph(spark, sf)), graph(spark, sf))
    return beyond.groupBy("leaf").agg(r(F.percentile("d2", 0.9)).alias("q"))


@query
def agg_19_moving_average(spark, sf):
    own = table(spark, sf, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("double").alias("day"), "o_totalprice")
    return B.moving_average(own, "day", "o_totalprice", 30, 3).select("bin", r("value", 2).alias("value"))


def _trajectories(spark, sf):
    g, own = graph(spark, sf), cloud(spark, sf)
    found = P.trajectory_pseudotime(J.project(own, g), g, P.root_paths(g, 0))
    long = own.select("point_id", F.posexplode("x").alias("var", "v")).where("var < 4")
    return found.join(long, "point_id").withColumn("pst", F.round("pst", 9))


@query
def agg_20_spearman(spark, sf):
    return T.spearman(_trajectories(spark, sf)).select("traj_id", "var", r("value", 5).alias("value"))


@query
def agg_21_linear_r2(spark, sf):
    return T.linear_regression(_trajectories(spark, sf)).select("traj_id", "var", r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"), r("r2", 5).alias("r2"))


@query
def agg_21_logistic_r2(spark, sf):
    own = _trajectories(spark, sf).withColumn("v", (F.col("v") > 0).cast("double"))
    return T.regression(own, "BINARY", threshold=-10).select("traj_id", "var", r("r2", 4).alias("r2"))


@query
def agg_22_regression_table(spark, sf):
    return T.regression(_trajectories(spark, sf), threshold=0.001).select("traj_id", "var", r("r2", 5).alias("r2"))


@query
def agg_23_node_label_ratio(spark, sf):
    own = A.nearest_node(cloud(spark, sf), centroids(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label"), "point_id")
    return T.label_shares(own, "label").select("node_id", "label", r("ratio").alias("ratio"))


@query
def agg_24_edge_means(spark, sf):
    g, own = graph(spark, sf), cloud(spark, sf)
    return T.edge_means(J.project(own, g), own.select("point_id", F.col("x")[0].alias("v")), g).select("edge_id", r("value").alias("value"))


@query
def agg_25_mahalanobis(spark, sf):
    """Parts by size and price: distance from the mean in units of their covariance, by aggregates and an expression."""
    own = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    m = own.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("aa"), F.var_samp("b").alias("bb"), F.covar_samp("a", "b").alias("ab"))
    da, db = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    d = F.sqrt((da * da * F.col("bb") - 2 * da * db * F.col("ab") + db * db * F.col("aa")) / det)
    return own.crossJoin(F.broadcast(m)).select("p_partkey", r(d, 5).alias("d"))


@query
def agg_26_polygon_area(spark, sf):
    """The polygon of the ten centroids' first two coordinates, in order: shoelace by window and compactness."""
    from pyspark.sql import Window

    nodes = store.nodes_frame(spark, graph(spark, sf)).select("node_id", F.col("y")[0].alias("px"), F.col("y")[1].alias("py"))
    w, every = Window.orderBy("node_id"), Window.partitionBy()
    nx, ny = F.lead("px").over(w), F.lead("py").over(w)
    first = F.min_by(F.struct("px", "py"), F.col("node_id")).over(every)
    step = nodes.select("node_id", (F.col("px") * F.coalesce(ny, first["py"]) - F.col("py") * F.coalesce(nx, first["px"])).alias("s"), F.sqrt(F.pow(nx - F.col("px"), 2) + F.pow(ny - F.col("py"), 2)).alias("l"))
    area = F.abs(F.sum("s")) / 2
    return step.agg(r(area).alias("area"), r(4 * F.pi() * area / F.pow(F.sum("l"), 2)).alias("compactness"))


# ---- elastic matrices and edits -----------------------------------------------


@query
def prj_1_column_subset(spark, sf):
    own = cloud(spark, sf).select("point_id", F.slice("x", 1, 3).alias("x"))
    y = centroids(spark, sf)[:, :3]
    return A.nearest_node(own, y).select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))


@query
def prj_5_centering(spark, sf):
    own = A.coordinates(cloud(spark, sf), "point_id")
    mean = own.groupBy("dim").agg(F.avg("v").alias("m"))
    return own.join(F.broadcast(mean), "dim").select(F.col("point_id").alias("vec_id"), "dim", r(F.col("v") - F.col("m")).alias("value"))


@query
def prj_6_pca_variance(spark, sf):
    _, cov = PointCloud(cloud(spark, sf)).engine().moments()
    value = np.sort(np.linalg.eigvalsh(cov))[::-1]
    return frame(spark, [(i, round(float(v), 6)) for i, v in enumerate(value)], "component int, variance double")


@query
def prj_6_covariance(spark, sf):
    own = cloud(spark, sf).select("point_id", F.slice("x", 1, 4).alias("x"))
    _, cov = PointCloud(own).engine(small=0).moments()
    return frame(spark, [(i, j, round(float(cov[i, j]), 6)) for i in range(4) for j in range(4)], "i int, j int, value double")


@query
def prj_11_uniform_em(spark, sf):
    return matrix(spark, graph(spark, sf).matrix())


@query
def prj_12_cycle_em(spark, sf):
    return matrix(spark, uniform_with_cycle(np.zeros((K, 1)), np.array(EDGES), LAM, MU, 0.05, 0.5, CYCLE).matrix())


@query
def prj_13_encode(spark, sf):
    return matrix(spark, Graph(np.zeros((K, 1)), np.array(EDGES), LAM, MU).matrix())


@query
def prj_14_decode(spark, sf):
    g = Graph.from_matrix(np.zeros((K, 1)), graph(spark, sf).matrix())
    return frame(spark, [(i, int(a), int(b), float(v)) for i, ((a, b), v) in enumerate(zip(g.edges, g.lam))], "edge_id int, src int, dst int, lam double")


@query
def prj_16_adjust(spark, sf):
    return matrix(spark, adjust_by_constant(graph(spark, sf)).matrix())


@query
def fit_1_laplacian(spark, sf):
    return matrix(spark, np.round(graph(spark, sf).laplacian(), 12))


@query
def fit_2_m_step(spark, sf):
    from .embed import solve

    g, engine = graph(spark, sf), PointCloud(cloud(spark, sf)).engine()
    y = solve(g, engine.stats([g.y])[0])
    return frame(spark, [(i, d, round(float(v), 6)) for i, p in enumerate(y) for d, v in enumerate(p)], "node_id int, dim int, value double")


def _embedded(spark, sf, small):
    done = embed(PointCloud(cloud(spark, sf)).engine(small), [graph(spark, sf)], Rules(eps=1e-6, iterations=5))[0]
    return frame(spark, [(i, d, round(float(v), 6)) for i, p in enumerate(done.graph.y) for d, v in enumerate(p)], "node_id int, dim int, value double")


Q["fit_5_embed_on_driver"] = partial(_embedded, small=1 << 30)
Q["fit_5_embed_distributed"] = partial(_embedded, small=0)


@query
def fit_10_barycentric(spark, sf):
    own = PointCloud(cloud(spark, sf)).engine(1 << 30)
    g, _ = embed_barycentric(own.x, own.w, graph(spark, sf), Rules())
    return frame(spark, [(i, d, round(float(v), 6)) for i, p in enumerate(g.y) for d, v in enumerate(p)], "node_id int, dim int, value double")


def _sums(spark, sf):
    g = graph(spark, sf)
    s = PointCloud(cloud(spark, sf)).engine().stats([g.y])[0]
    return g, s.weight, s.sums / np.maximum(s.weight, 1e-300)[:, None]


@query
def fit_14_remove_node(spark, sf):
    g = graph(spark, sf)
    return long_nodes(spark, [(c, n, y) for c, made in enumerate(grammar.remove_leaves(g)) for n, y in enumerate(made.y)])


@query
def fit_15_bisect_edge(spark, sf):
    return long_nodes(spark, [(c, made.k - 1, made.y[-1]) for c, made in enumerate(grammar.bisect_edges(graph(spark, sf)))])


@query
def fit_15_bisect_edge_moduli(spark, sf):
    made = grammar.bisect_edges(graph(spark, sf))
    return frame(spark, [(c, int(a), int(b), round(float(v), 9)) for c, m in enumerate(made) for (a, b), v in zip(m.edges, m.lam)], "cand_id int, src int, dst int, lam double")


@query
def fit_16_add_node(spark, sf):
    g, weight, centres = _sums(spark, sf)
    return long_nodes(spark, [(c, made.k - 1, made.y[-1]) for c, made in enumerate(grammar.add_nodes(g, weight, centres))])


@query
def fit_17_shrink_edge(spark, sf):
    g = graph(spark, sf)
    degree = g.degrees()
    inner = [int(a) for a, b in g.edges if min(degree[a], degree[b]) > 1]
    return long_nodes(spark, [(c, a, made.y[a]) for c, (a, made) in enumerate(zip(inner, grammar.shrink_edges(g)))])


@query
def fit_21_avoid_solitary(spark, sf):
    g = graph(spark, sf)
    made = grammar.bisect_edges(g)
    stats = PointCloud(cloud(spark, sf)).engine().stats([m.y for m in made])
    return frame(spark, [(c, int((s.weight > 0).sum()), bool((s.weight > 0).all())) for c, s in enumerate(stats)], "cand_id int, n_used int, kept boolean")


def _fitted(spark, sf, kind, **kwargs):
    own = PointCloud(cloud(spark, sf))
    f = getattr(topologies, kind)
    made = f(own, init=graph(spark, sf), **kwargs) if kind in ("fine_tune", "grow_leaves") else f(own, **kwargs)
    return frame(spark, [(i, d, round(float(v), 6)) for i, p in enumerate(made.graph.y) for d, v in enumerate(p)], "node_id int, dim int, value double")


Q["fit_25_circle"] = partial(_fitted, kind="circle", nodes=10)
Q["fit_26_tree"] = partial(_fitted, kind="tree", nodes=10)
Q["fit_27_curve"] = partial(_fitted, kind="curve", nodes=12)
Q["fit_28_fine_tune"] = partial(_fitted, kind="fine_tune", nodes=12)
Q["fit_29_grow_leaves"] = partial(_fitted, kind="grow_leaves", nodes=14)


@query
def fit_24_replicas(spark, sf):
    """Three replicas of 70 % of the rows each and their consensus: the report of each."""
    made = topologies.tree(PointCloud(cloud(spark, sf)), 6, replicas=3, share=0.7, seed=3)
    rows = [(f.replica, f.graph.k, len(f.graph.edges), round(float(f.energy.mse), 5)) for f in made]
    return frame(spark, rows, "replica int, n_nodes int, n_edges int, mse double")


# ---- paths --------------------------------------------------------------------


@query
def path_1_branches(spark, sf):
    return P.path_table(spark, P.branches(graph(spark, sf)))


@query
def path_1_end_to_end(spark, sf):
    return P.path_table(spark, P.end_to_end(graph(spark, sf)))


@query
def path_3_bfs(spark, sf):
    _, depth, _ = P.bfs(graph(spark, sf), 0)
    return frame(spark, [(int(n), int(d)) for n, d in depth.items()], "node_id int, depth int")


@query
def path_6_root_paths(spark, sf):
    return P.path_table(spark, P.root_paths(graph(spark, sf), 0))


@query
def path_7_pseudotime(spark, sf):
    g = graph(spark, sf)
    return P.pseudotime(J.project(cloud(spark, sf), g), g, 0, 9).select(F.col("point_id").alias("vec_id"), r("pt").alias("pt"))


@query
def path_7_pseudotime_tree(spark, sf):
    g = graph(spark, sf)
    return P.pseudotime(J.project(cloud(spark, sf), g), g, 0).select(F.col("point_id").alias("vec_id"), r("pt").alias("pt"))


@query
def path_10_trajectories(spark, sf):
    g = graph(spark, sf)
    found = P.trajectory_pseudotime(J.project(cloud(spark, sf), g), g, P.root_paths(g, 0))
    return found.select("traj_id", F.col("point_id").alias("vec_id"), r("pst").alias("pst"))


@query
def path_14_branch_labels(spark, sf):
    g = graph(spark, sf)
    return P.branch_labels(A.distance_arrays(cloud(spark, sf), g.y), g).select(F.col("point_id").alias("vec_id"), "branch_id")


@query
def path_17_cycles(spark, sf):
    g = graph(spark, sf)
    ring = Graph(g.y, np.vstack([g.edges, [[6, 7], [7, 9]]]), np.append(g.lam, [LAM, LAM]), g.mu)
    return P.path_table(spark, [list(c) for c in P.cycles(ring)])


@query
def path_20_components(spark, sf):
    g = graph(spark, sf)
    cut = Graph(g.y, np.delete(g.edges, [3, 6], axis=0), np.delete(g.lam, [3, 6]), g.mu)
    return frame(spark, [(c, int(n)) for c, own in enumerate(P.components(cut)) for n in own], "component int, node_id int")


# ---- windows and bins -----------------------------------------------------------


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7 + 1).cast("double").alias("w"))


def _bins(binned: DataFrame) -> DataFrame:
    return binned.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean"))


@query
def win_1_even_bins(spark, sf):
    return _bins(B.even_bins(_orders(spark, sf), "o_totalprice", "o_orderkey", 20))


@query
def win_4_weighted_bins(spark, sf):
    return _bins(B.weighted_bins(_orders(spark, sf), "o_totalprice", "o_orderkey", "w", 20))


@query
def win_9_equal_width(spark, sf):
    return _bins(B.equal_width_bins(_orders(spark, sf), "o_totalprice", 20))


@query
def win_7_filled_means(spark, sf):
    """Balances of suppliers in narrow bins: empty bins take their neighbours' means."""
    own = table(spark, sf, "supplier").select("s_acctbal")
    made = B.bin_means(B.equal_width_bins(own, "s_acctbal", 100), 100, "s_acctbal")
    return made.select("bin", "n", r("mean", 4).alias("mean"))


@query
def win_14_path_distance(spark, sf):
    from pyspark.sql import Window

    g = graph(spark, sf)
    nodes = store.nodes_frame(spark, g).select("node_id", "y")
    path = P.path_table(spark, [P.shortest_path(g, 0, 9)]).join(nodes, "node_id")
    w = Window.partitionBy("path_id").orderBy("pos")
    step = F.coalesce(F.sqrt(V.sqdist(F.col("y"), F.col("before"))), F.lit(0.0))
    return path.withColumn("before", F.lag("y").over(w)).withColumn("s", step).select("pos", "node_id", r(F.sum("s").over(w)).alias("dist"))


@query
def win_15_early_groups(spark, sf):
    ensure_checkpoint_dir(spark)
    g, own = graph(spark, sf), cloud(spark, sf, F.col("label").alias("label"))
    pt = P.pseudotime(J.project(own, g), g, 0)
    found = L.early_groups(own.join(pt, "point_id").withColumn("pt", F.round("pt", 9)), 5, "knn", 10)
    return found.select(F.col("point_id").alias("vec_id"), "window", "group")


@query
def win_16_transport_labels(spark, sf):
    own = cloud(spark, sf, F.col("label").alias("label"))
    found = L.propagate(own.select("point_id", "x", "label"), own.select("point_id", "x"), "ot", reg=0.05)
    return found.select(F.col("point_id").alias("vec_id"), "label")


@query
def win_20_gap_fill(spark, sf):
    """Mean value of purchases per hour and type; hours without any are filled along time."""
    own = table(spark, sf, "events").select("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "value")
    per = own.groupBy("event_type", "hour").agg(F.avg("value").alias("m"), F.count("*").alias("n")).withColumn("m", F.when(F.col("n") > 1, F.col("m")))
    return B.fill_gaps(per, "hour", "m", "event_type").select("event_type", F.col("hour").alias("pos"), r("filled", 6).alias("value"))


# ---- limits, sets, editing --------------------------------------------------------


@query
def sort_2_longest_edges(spark, sf):
    g = store.edges_frame(spark, graph(spark, sf))
    return g.orderBy(F.desc(F.round("len", 9)), "edge_id").limit(3).select("edge_id")


@query
def sort_3_busiest_nodes(spark, sf):
    found = A.nearest_node(cloud(spark, sf), centroids(spark, sf)).groupBy("node_id").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "node_id").limit(3)


@query
def sort_4_shortest_edges(spark, sf):
    g = graph(spark, sf)
    degree = g.degrees()
    inner = [int(i) for i, (a, b) in enumerate(g.edges) if min(degree[a], degree[b]) > 1]
    return store.edges_frame(spark, g).where(F.col("edge_id").isin(inner)).orderBy(F.round("len", 9), "edge_id").limit(3).select("edge_id")


@query
def set_3_equivalent_loops(spark, sf):
    """Loops are sets of points: loop i holds the points of the labels i to i + 5."""
    own = table(spark, sf, "embeddings").withColumn("loop_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("label") - 5), F.col("label"))))
    loops = own.groupBy("loop_id").agg(F.collect_set("vec_id").alias("points"))
    return E.equivalent(loops).select("a", "b", r("overlap").alias("overlap"))


def _ends(spark, sf, mode, par):
    found = E.extended_ends(cloud(spark, sf), graph(spark, sf), mode, par)
    return found.select("leaf", "dim", r("value").alias("value"))


Q["edit_1_extend_quantcentroid"] = partial(_ends, mode="QuantCentroid", par=0.6)
Q["edit_1_extend_weighted"] = partial(_ends, mode="WeightedCentroid", par=0.8)
Q["edit_1_extend_quantdists"] = partial(_ends, mode="QuantDists", par=0.9)


@query
def edit_3_branch_stats(spark, sf):
    g = graph(spark, sf)
    found = E.branch_stats(J.project(cloud(spark, sf), g), g)
    return found.select("branch_id", "n_points", "n_inner", "n_leaf", "n_edges", r("length").alias("length"))


@query
def edit_3_collapse(spark, sf):
    made = E.collapse_branches(cloud(spark, sf), graph(spark, sf), "EdgesNumber", 2)
    return frame(spark, [(int(a), int(b)) for a, b in made.edges], "src int, dst int")


@query
def edit_4_shift_target(spark, sf):
    return E.shift_targets(cloud(spark, sf), graph(spark, sf))


@query
def edit_4_shift_branching(spark, sf):
    made = E.shift_branching(cloud(spark, sf), graph(spark, sf), "Manual", {3: 2})
    return frame(spark, [(int(a), int(b)) for a, b in made.edges], "src int, dst int")


@query
def edit_6_add_path(spark, sf):
    made = E.add_path(cloud(spark, sf), graph(spark, sf), 6, 7, 4, allow_crossing=True)
    return frame(spark, [(int(a), int(b)) for a, b in made.edges], "src int, dst int")


@query
def edit_7_del_path(spark, sf):
    made = E.delete_path(graph(spark, sf), 0, 2)
    return frame(spark, [(int(a), int(b)) for a, b in made.edges], "src int, dst int")


@query
def edit_8_refit(spark, sf):
    g = graph(spark, sf)
    made = E.refit_graph(cloud(spark, sf), g, {0: np.zeros(g.y.shape[1])})
    return frame(spark, [(i, d, round(float(v), 6)) for i, p in enumerate(made.y) for d, v in enumerate(p)], "node_id int, dim int, value double")


# ---- sources, streams, plot data ----------------------------------------------------


@query
def io_5_branching_walk(spark, sf):
    made = synthetic.walk_points(spark, 4, 3, seed=1, steps=200)
    return made.groupBy("walker", "branch").agg(F.count("*").alias("n"))


@query
def io_9_adjacency(spark, sf):
    return store.adjacency(store.edges_frame(spark, graph(spark, sf))).select("u", "v", r("len").alias("len"))


@query
def io_2_table_source(spark, sf):
    own = readers.from_table(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return own.select("point_id", F.posexplode("x").alias("dim", "value"))


def _streamed(spark, sf, name):
    """The table as a file stream, each file a micro-batch."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # streams read folders


@query
def str_1_stream_score(spark, sf):
    """Runs the stream to its end into the shared folder and returns what it wrote."""
    import uuid

    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    g = graph(spark, sf)
    points = _streamed(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x"))
    out = score(points, g).select(F.col("point_id").alias("vec_id"), "node_id", r("d2").alias("d2"))
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query
def str_2_drift(spark, sf):
    drift, own = Drift(graph(spark, sf)), cloud(spark, sf)
    drift.update(own, 0)
    drift.update(own, 0)  # delivered again
    return frame(spark, [(i, int(n)) for i, n in enumerate(drift.stats.weight)], "node_id int, n long")


@query
def str_3_occupancy(spark, sf):
    """Events by value near seven nodes, per day."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), "ts", F.array(F.col("value")).alias("x"))
    found = occupancy(events, np.arange(0.0, 70.0, 10.0)[:, None], "1 day")
    return found.select(F.unix_timestamp("start").alias("start"), "node_id", "n")


@query
def viz_1_scatter(spark, sf):
    return plotdata.scatter(cloud(spark, sf), graph(spark, sf)).select(F.col("point_id").alias("vec_id"), "dim", r("value", 5).alias("value"))


@query
def viz_2_tree_view(spark, sf):
    found = plotdata.tree_view(cloud(spark, sf), graph(spark, sf))
    return found.select(F.col("point_id").alias("vec_id"), r("px", 4).alias("px"), r("py", 4).alias("py"))


@query
def viz_3_pseudotime_curve(spark, sf):
    return T.pseudotime_curve(_trajectories(spark, sf), 10).select("traj_id", "var", r("pst", 5).alias("pst"), r("value", 5).alias("value"))


@query
def viz_4_pies(spark, sf):
    own = A.nearest_node(cloud(spark, sf), centroids(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label"), "point_id")
    return plotdata.pies(own, "label", graph(spark, sf)).select("node_id", "label", r("ratio").alias("ratio"), r("px", 4).alias("px"), r("py", 4).alias("py"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registry_alone

    return Q | registry_alone.Q


def oracle_sql() -> dict[str, str]:
    from . import registry_alone

    return sql() | registry_alone.SQL
