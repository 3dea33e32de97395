"""Queries for operators that the others only pass through, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..graph import Graph, energy
from ..operators import assign as A
from ..operators import bins as B
from ..operators import neighbours as N
from ..operators import paths as P
from ..operators import project as J
from ..session import ensure_checkpoint_dir
from ..sources import readers, store
from . import grammar
from .embed import _relative_shift
from .oracles import _COS, BASE, EDGES, LAM, MU

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def alone(sql: str):
    """Registers a query of the name with the SQL that gives its rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _own():
    from . import registry

    return registry


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)  # no negative zero


def _nodes(spark, sf) -> DataFrame:
    return store.nodes_frame(spark, _own().graph(spark, sf)).select("node_id", "y")


def _ends(spark, sf) -> DataFrame:
    """Edges with the places of their two nodes: ``(edge_id, src, dst, len, a, b)``."""
    nodes = _nodes(spark, sf)
    edges = store.edges_frame(spark, _own().graph(spark, sf)).select("edge_id", "src", "dst", "len")
    edges = edges.join(F.broadcast(nodes.select(F.col("node_id").alias("src"), F.col("y").alias("a"))), "src")
    return edges.join(F.broadcast(nodes.select(F.col("node_id").alias("dst"), F.col("y").alias("b"))), "dst")


# ---- sources ----------------------------------------------------------------


@alone("SELECT round(s_acctbal, 6) AS c0, s_nationkey::DOUBLE AS c1, 1.0::DOUBLE AS w, count(*) AS n FROM supplier GROUP BY ALL")
def io_1_csv_points(spark, sf):
    """Suppliers written as numbers between commas without a header, and read as points."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    _own().table(spark, sf, "supplier").select(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double")).write.csv(path)
    points = readers.read_csv(spark, path, 2)
    return points.groupBy(r(F.col("x")[0]).alias("c0"), F.col("x")[1].alias("c1"), "w").agg(F.countDistinct("point_id").alias("n"))


@alone(f"{BASE} SELECT node_id::BIGINT AS point_id, (dim)::INT AS dim, round(c, 6) + 0 AS value FROM cen")
def io_3_array_source(spark, sf):
    points = readers.from_array(spark, _own().centroids(spark, sf))
    return points.select("point_id", F.posexplode("x").alias("dim", "v")).select("point_id", "dim", r("v").alias("value"))


@alone(f"{BASE} SELECT edge_id, src, dst, round(len, 6) AS len, {LAM}::DOUBLE AS lambda FROM ends")
def io_8_edge_table(spark, sf):
    g = store.edges_frame(spark, _own().graph(spark, sf))
    return g.select("edge_id", "src", "dst", r("len").alias("len"), "lambda")


# ---- vectors and plane --------------------------------------------------------


@alone(f"{BASE} SELECT a.node_id AS a, b.node_id AS b, round(list_distance(a.y, b.y) ** 2, 6) AS d2 FROM nodes a, nodes b WHERE a.node_id < b.node_id")
def join_6_square_distances(spark, sf):
    nodes = _nodes(spark, sf)
    other = F.broadcast(nodes.select(F.col("node_id").alias("b"), F.col("y").alias("yb")))
    return nodes.join(other, F.col("node_id") < F.col("b")).select(F.col("node_id").alias("a"), "b", r(V.sqdist(F.col("y"), F.col("yb"))).alias("d2"))


@alone(f"{BASE} SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, round(ln(1 + list_inner_product(x, x)), 6) AS log1, round(exp(-list_inner_product(x, x)), 6) AS decay FROM pts")
def sca_1_scalars(spark, sf):
    x2 = V.norm2(F.col("x"))
    return _own().cloud(spark, sf).select(F.col("point_id").alias("vec_id"), r(F.sqrt(x2)).alias("norm"), r(F.log(1 + x2)).alias("log1"), r(F.exp(-x2)).alias("decay"))


@alone(f"""{BASE} SELECT edge_id, round(list_inner_product(ya, yb), 6) + 0 AS dot, round(list_inner_product(ya, ya), 6) AS norm2,
    round(list_sum(list_transform(list_zip(ya, yb), lambda p: (p[1] + p[2]) / 2)), 6) + 0 AS middle FROM ends""")
def sca_2_vectors(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _ends(spark, sf).select("edge_id", r(V.dot(a, b)).alias("dot"), r(V.norm2(a)).alias("norm2"), r(V.total(V.midpoint(a, b))).alias("middle"))


@alone(f"""{BASE} SELECT vec_id, round((list_inner_product(x, yb) - list_inner_product(x, ya) - list_inner_product(ya, yb) + list_inner_product(ya, ya)) / (len * len), 6) + 0 AS u
    FROM pts, ends WHERE edge_id = 0""")
def sca_4_edge_share(spark, sf):
    edge = F.broadcast(_ends(spark, sf).where("edge_id = 0").select("a", "b"))
    found = _own().cloud(spark, sf).join(edge, F.col("a").isNotNull())
    return found.select(F.col("point_id").alias("vec_id"), r(V.edge_share(F.col("x"), F.col("a"), F.col("b"))).alias("u"))


@alone(f"""{BASE}, m AS (SELECT node_id, list(median ORDER BY dim) AS z FROM (SELECT label AS node_id, dim, max(v) AS median FROM flat GROUP BY ALL) GROUP BY 1)
    SELECT round(max(list_distance(y, z) ** 2 / list_inner_product(z, z)), 6) AS change FROM nodes JOIN m USING (node_id)""")
def sca_5_relative_change(spark, sf):
    """Nodes moved from their points' means to the largest coordinates of their points."""
    old = _own().centroids(spark, sf)
    long = _own().cloud(spark, sf, F.col("label").alias("node_id")).select("node_id", F.posexplode("x").alias("dim", "v"))
    new = np.zeros_like(old)
    for row in long.groupBy("node_id", "dim").agg(F.max("v").alias("v")).collect():  # a row per node and dimension
        new[row["node_id"], row["dim"]] = row["v"]
    return spark.createDataFrame([(round(_relative_shift(old, new), 6),)], "change double")


_EDGE_PAIRS = f"""{BASE}, p AS (SELECT e.edge_id AS e, f.edge_id AS f, e.ya[1] AS ax, e.ya[2] AS ay, e.yb[1] - e.ya[1] AS dx, e.yb[2] - e.ya[2] AS dy,
    f.ya[1] AS bx, f.ya[2] AS by_, f.yb[1] - f.ya[1] AS ex, f.yb[2] - f.ya[2] AS ey FROM ends e JOIN ends f ON e.edge_id < f.edge_id),
  t AS (SELECT *, ((bx - ax) * ey - (by_ - ay) * ex) / (dx * ey - dy * ex) AS s FROM p)"""


def _pairs_of_edges(spark, sf) -> DataFrame:
    one = _ends(spark, sf).select(F.col("edge_id").alias("e"), F.col("a").alias("a1"), F.col("b").alias("a2"))
    two = F.broadcast(_ends(spark, sf).select(F.col("edge_id").alias("f"), F.col("a").alias("b1"), F.col("b").alias("b2")))
    return one.join(two, F.col("e") < F.col("f"))


@alone(f"{_EDGE_PAIRS} SELECT e, f, round(ax + s * dx, 4) + 0 AS px, round(ay + s * dy, 4) + 0 AS py FROM t")
def sca_6_line_crossings(spark, sf):
    """Where the lines of each two edges meet in the first two dimensions."""
    x, y = V.crossing(*[F.col(c) for c in ("a1", "a2", "b1", "b2")])
    return _pairs_of_edges(spark, sf).select("e", "f", r(x, 4).alias("px"), r(y, 4).alias("py"))


@alone(f"""{BASE} SELECT edge_id, node_id, (list_inner_product(y, yb) - list_inner_product(y, ya) - list_inner_product(ya, yb) + list_inner_product(ya, ya)) BETWEEN -1e-12 AND len * len + 1e-12 AS within
    FROM ends, nodes WHERE node_id NOT IN (src, dst)""")
def sca_7_is_between(spark, sf):
    """Whether each other node's foot lies within an edge."""
    nodes = F.broadcast(_nodes(spark, sf))
    found = _ends(spark, sf).join(nodes, (F.col("node_id") != F.col("src")) & (F.col("node_id") != F.col("dst")))
    return found.select("edge_id", "node_id", V.is_between(F.col("a"), F.col("b"), F.col("y")).alias("within"))


# ---- graphs and grammars --------------------------------------------------------


@alone(f"""{BASE}, e AS (SELECT edge_id, src, dst, len, a.degree AS da, b.degree AS db FROM ends JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst),
  t AS (SELECT (SELECT avg(d2) FROM near) AS mse, (SELECT sum(({LAM} + 0.05 * greatest(0, greatest(da, db) - 2)) * len * len) FROM e) AS ep, (SELECT sum({MU} * degree ** 0.3 * s2) FROM star) AS rp)
  SELECT round(mse + ep + rp, 6) AS energy, round(ep, 6) AS ep, round(rp, 6) AS rp FROM t""")
def agg_3_penalties(spark, sf):
    g = _own().graph(spark, sf)
    e = energy(g, J.fit_report(_own().cloud(spark, sf), g)[0]["mse"], "Penalized", 0.05, 0.3)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (e.total, e.stretch, e.bend))], "energy double, ep double, rp double")


@alone(f"SELECT unnest([0, 1, 2]) AS node_id, unnest([0.0, {MU}, 0.0])::DOUBLE AS mu")
def prj_19_unbend_leaves(spark, sf):
    y = _own().centroids(spark, sf)[:3]
    g = grammar.unbend_leaves(Graph(y, np.array(EDGES[:2]), np.full(2, LAM), np.full(3, MU)))
    return store.nodes_frame(spark, g).select("node_id", "mu")


@alone(f"""{BASE} SELECT 'addnode2node' AS edit, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'bisectedge', (SELECT count(*) FROM ends)
    UNION ALL SELECT 'removenode', (SELECT count(*) FROM deg WHERE degree = 1)
    UNION ALL SELECT 'shrinkedge', (SELECT count(*) FROM ends JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst WHERE a.degree > 1 AND b.degree > 1)""")
def fit_13_candidate_counts(spark, sf):
    """How many graphs each edit of the tree gives."""
    g = _own().graph(spark, sf)
    made = {e: len(grammar.candidates(g, e, np.ones(g.k), g.y + 0.1)) for e in ("addnode2node", "bisectedge", "removenode", "shrinkedge")}
    return spark.createDataFrame(list(made.items()), "edit string, n long")


@alone(f"""{BASE}, tried AS (SELECT edge_id, (SELECT avg(d) FROM (SELECT least(min(dist.d2), min(list_distance(x, list_transform(list_zip(ya, yb), lambda p: (p[1] + p[2]) / 2)) ** 2)) AS d
    FROM dist JOIN pts USING (vec_id) GROUP BY vec_id)) AS mse FROM ends) SELECT edge_id, round(mse, 6) AS mse FROM tried ORDER BY round(mse, 9), edge_id LIMIT 1""")
def sort_1_best_candidate(spark, sf):
    """Of the trees with a node in the middle of one edge, that with the least mean squared distance, the first of equals."""
    g = _own().graph(spark, sf)
    tried = [(i, np.vstack([g.y, (g.y[a] + g.y[b]) / 2])) for i, (a, b) in enumerate(g.edges)]
    own = _own().cloud(spark, sf)
    each = None
    for i, y in tried:
        one = A.nearest_node(own, y).agg(F.avg("d2").alias("mse")).select(F.lit(i).alias("edge_id"), "mse")
        each = one if each is None else each.unionByName(one)
    best = each.agg(F.min(F.struct(F.round("mse", 9).alias("by"), "edge_id", "mse")).alias("m"))
    return best.select("m.edge_id", r("m.mse").alias("mse"))


# ---- paths and sets ---------------------------------------------------------------


_BFS = f"{BASE}, o AS (SELECT node_id, len(path) - 1 AS depth, row_number() OVER (ORDER BY len(path), path) - 1 AS pos FROM walk)"


@alone(f"{_BFS} SELECT pos::INT AS pos, node_id::INT AS node_id FROM o")
def path_4_breadth_first_order(spark, sf):
    order, _, _ = P.bfs(_own().graph(spark, sf), 0)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(order)], "pos int, node_id int")


@alone("SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6), (2, 0, 7), (3, 0, 8), (3, 1, 9)) t(path_id, pos, node_id)")
def path_5_rooted_branches(spark, sf):
    """Branches from node 0 on: the junction 3 belongs to the one that leads to it."""
    return P.path_table(spark, P.rooted_branches(_own().graph(spark, sf), 0))


@alone("SELECT * FROM (VALUES (0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3), (8, 4), (9, 4)) t(node_id, branch)")
def path_2_vertex_branches(spark, sf):
    """A branch number per node, breadth first from node 0: a junction and what follows it begin new ones."""
    return spark.createDataFrame([(int(n), int(b)) for n, b in P.vertex_branches(_own().graph(spark, sf), 0).items()], "node_id int, branch int")


@alone(f"""{BASE}, steps AS (SELECT path_id, path, unnest(generate_series(1, len(path) - 1)) AS k FROM rootpath)
    SELECT path_id AS traj_id, (k - 1)::INT AS pos, edge_id FROM steps JOIN edges ON (src = path[k] AND dst = path[k + 1]) OR (dst = path[k] AND src = path[k + 1])""")
def path_8_trajectory_edges(spark, sf):
    found = [t for t in P.trajectories(_own().graph(spark, sf), 0) if t[1]]
    return spark.createDataFrame([(i, p, int(e)) for i, (_, edges) in enumerate(found) for p, e in enumerate(edges)], "traj_id int, pos int, edge_id int")


@alone("SELECT * FROM (VALUES ('BranchPoint_0', 3), ('Branch_0', 0), ('Branch_0', 1), ('Branch_0', 2), ('Branch_1', 4), ('Branch_1', 5), ('Branch_1', 6), ('Branch_2', 7), ('Branch_3', 8), ('Branch_3', 9)) t(part, node_id)")
def set_4_parts_without_junctions(spark, sf):
    found = P.branches_and_points(_own().graph(spark, sf))
    return spark.createDataFrame([(name, int(n)) for name, own in found.items() for n in own], "part string, node_id int")


@alone(f"{BASE} SELECT node_id, degree > 2 AS junction FROM deg WHERE degree <> 2")
def set_1_ends_and_junctions(spark, sf):
    """The union of the ends of edges that meet no second edge and of those that meet more."""
    ends = store.adjacency(store.edges_frame(spark, _own().graph(spark, sf))).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))
    leaves = ends.where("degree = 1").select("node_id", F.lit(False).alias("junction"))
    return leaves.union(ends.where("degree > 2").select("node_id", F.lit(True).alias("junction"))).distinct()


@alone(f"{BASE} SELECT DISTINCT path_id, n.vec_id FROM near n JOIN branch ON list_contains(path, node_id)")
def set_5_distinct_members(spark, sf):
    g = _own().graph(spark, sf)
    return P.members(A.nearest_node(_own().cloud(spark, sf), g.y), P.branches(g)).dropDuplicates().select("path_id", F.col("point_id").alias("vec_id"))


@alone("SELECT unnest(flatten([[0, 1, 2, 3], [3, 4, 5, 6], [3, 7], [3, 8, 9]])) AS node_id")
def prj_18_flatten(spark, sf):
    table = P.path_table(spark, P.branches(_own().graph(spark, sf)))
    lists = table.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("path"))
    return lists.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("path_id", "path"))), lambda s: s["path"])).alias("all")).select(F.explode("all").alias("node_id"))


# ---- windows ------------------------------------------------------------------------


_SERIES = """WITH per AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS hour, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT event_type, hour, CASE WHEN n > 1 THEN m END AS m FROM per)"""


def _series(spark, sf) -> DataFrame:
    own = _own().table(spark, sf, "events").select("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "value")
    per = own.groupBy("event_type", "hour").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return per.withColumn("m", F.when(F.col("n") > 1, F.col("m")))


@alone(f"{_SERIES} SELECT event_type, round(arg_min(m, hour) FILTER (WHERE m IS NOT NULL), 6) AS value FROM s GROUP BY 1")
def win_17_first_known(spark, sf):
    return _series(spark, sf).groupBy("event_type").agg(r(B.first_known("m", "hour")).alias("value"))


@alone(f"{_SERIES} SELECT event_type, min(hour) FILTER (WHERE m IS NULL) AS hour FROM s GROUP BY 1")
def win_18_first_gap(spark, sf):
    return _series(spark, sf).groupBy("event_type").agg(B.first_gap("m", "hour").alias("hour"))


@alone(f"{_SERIES} SELECT event_type, round(arg_max(m, hour) FILTER (WHERE m IS NOT NULL), 6) AS value FROM s GROUP BY 1")
def win_19_last_known(spark, sf):
    return _series(spark, sf).groupBy("event_type").agg(r(B.last_known("m", "hour")).alias("value"))


@alone(f"""{BASE}, main AS (SELECT unnest(generate_series(0, 6)) AS pos), leg AS (SELECT pos, c.dim, c.c, lead(c.c) OVER (PARTITION BY c.dim ORDER BY pos) AS ahead FROM main JOIN cen c ON c.node_id = pos),
    step AS (SELECT pos, sqrt(sum((ahead - c) ** 2)) AS d FROM leg WHERE ahead IS NOT NULL GROUP BY 1),
    along AS (SELECT pos, d, coalesce(sum(d) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun, sum(d) OVER () AS total FROM step),
    want AS (SELECT pos AS k, pos * (SELECT max(total) FROM along) / 6 AS t FROM main),
    hit AS (SELECT k, pos, greatest(0, least(1, (t - begun) / d)) AS u FROM want JOIN along ON t >= begun - 1e-12 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1)
    SELECT k::INT AS pos, dim, round(c + u * (ahead - c), 5) + 0 AS value FROM hit JOIN leg USING (pos)""")
def win_12_resampled_path(spark, sf):
    """The path from node 0 to node 6 as seven points at equal distances along it."""
    y = _own().centroids(spark, sf)
    made = B.resample(y[P.shortest_path(_own().graph(spark, sf), 0, 6)])
    return spark.createDataFrame([(i, d, round(float(v), 5) + 0.0) for i, p in enumerate(made) for d, v in enumerate(p)], "pos int, dim int, value double")


@alone("SELECT unnest([0, 1, 2, 3, 4, 5])::INT AS bin, unnest([1.0, 2.0, 3.0, 3.0, 3.0, 3.0])::DOUBLE AS value, unnest([false, false, false, false, true, true]) AS bad")
def win_8_flagged_bins(spark, sf):
    """Bins without points take their neighbours' mean, filled ones included, and are flagged where both neighbours were empty."""
    rows = spark.createDataFrame([(0, [1.0]), (2, [3.0])], "bin int, x array<double>")
    y, bad = B.bin_vectors(rows.unionByName(rows.where("bin = 99")), 6)
    return spark.createDataFrame([(i, None if np.isnan(v[0]) else float(v[0]), bool(b)) for i, (v, b) in enumerate(zip(y, bad))], "bin int, value double, bad boolean")


@alone(f"""{BASE}, pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round({_COS}, 9) AS d FROM pts a, pts b WHERE a.vec_id <> b.vec_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS k FROM pairs QUALIFY k <= 4)
    SELECT vec_id, array_to_string(list(neighbor_id ORDER BY d, neighbor_id), ',') AS neighbors FROM best GROUP BY 1""")
def sort_7_sorted_neighbours(spark, sf):
    found = N.knn(_own().cloud(spark, sf), 4, "cosine").select("point_id", F.struct(F.round("dist", 9).alias("d"), "neighbor_id").alias("s"))
    lists = found.groupBy("point_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select(F.col("point_id").alias("vec_id"), F.array_join(F.transform("s", lambda s: s["neighbor_id"].cast("string")), ",").alias("neighbors"))
