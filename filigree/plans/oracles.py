"""The SQL that gives the rows of the registry's queries: independent of the operators, for DuckDB."""

from __future__ import annotations

#: The tree that the queries use, in the order of its edges' ids, and its moduli.
EDGES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7), (3, 8), (8, 9)]
LAM, MU = 0.01, 0.1
#: Radii that pairs are counted within, the trimming radius, and nodes that one query takes for a cycle.
RADII, TRIM, CYCLE = [0.9, 0.95, 1.0], 0.97, [3, 4, 5]

_EDGES = "edges(edge_id, src, dst) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(EDGES)) + ")"

#: Points, their coordinates, the labels' centroids and all distances.
BASE = f"""
WITH RECURSIVE pts AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings
), flat AS (
  SELECT vec_id, label, unnest(generate_series(0, len(x) - 1))::INT AS dim, unnest(x) AS v FROM pts
), cen AS (
  SELECT label AS node_id, dim, avg(v) AS c FROM flat GROUP BY ALL
), nodes AS (
  SELECT node_id, list(c ORDER BY dim) AS y FROM cen GROUP BY node_id
), dist AS (
  SELECT vec_id, label, node_id, list_distance(x, y) ** 2 AS d2 FROM pts, nodes
), near AS (
  SELECT vec_id, label, node_id, d2 FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), node_id) = 1
), {_EDGES}, ends AS (
  SELECT edge_id, src, dst, a.y AS ya, b.y AS yb, list_distance(a.y, b.y) AS len
  FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst
), deg AS (
  SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1
), cand AS (
  SELECT n.vec_id, n.node_id, n.d2, edge_id, src, dst, x, ya, yb, len,
    (list_inner_product(x, yb) - list_inner_product(x, ya) - list_inner_product(ya, yb) + list_inner_product(ya, ya)) / (len * len) AS u
  FROM near n JOIN pts USING (vec_id) JOIN ends ON n.node_id IN (src, dst)
), foot AS (
  SELECT *, list_transform(list_zip(ya, yb), lambda p: p[1] + greatest(0, least(1, u)) * (p[2] - p[1])) AS f FROM cand
), proj AS (
  SELECT *, list_distance(x, f) ** 2 AS d2_proj FROM foot
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(x, f) ** 2, 9), edge_id) = 1
), both_ways AS (
  SELECT src AS u, dst AS v, len FROM ends UNION ALL SELECT dst, src, len FROM ends
), walk AS (
  SELECT 0 AS node_id, [0] AS path, 0::DOUBLE AS far
  UNION ALL
  SELECT v, list_append(path, v), far + len FROM walk JOIN both_ways ON u = node_id WHERE NOT list_contains(path, v)
), branch(path_id, path) AS (VALUES (0, [0, 1, 2, 3]), (1, [3, 4, 5, 6]), (2, [3, 7]), (3, [3, 8, 9])
), rootpath AS (
  SELECT (row_number() OVER (ORDER BY node_id) - 1)::INT AS path_id, path FROM walk JOIN deg USING (node_id) WHERE degree = 1 AND node_id <> 0
), traj AS (
  SELECT path_id AS traj_id, vec_id,
    least(coalesce(nullif(list_position(path, src), 0), 99), coalesce(nullif(list_position(path, dst), 0), 99)) - 1 + greatest(0, least(1, u)) AS pst
  FROM proj JOIN rootpath ON list_contains(path, node_id) AND (list_contains(path, src) OR list_contains(path, dst))
), tv AS (
  SELECT traj_id, t.vec_id, round(pst, 9) AS pst, dim AS var, v FROM traj t JOIN flat f ON f.vec_id = t.vec_id WHERE dim < 4
), stretch AS (
  SELECT sum({LAM} * len * len) AS ep FROM ends
), star AS (
  SELECT d.node_id, degree, list_distance(n.y, (SELECT list(m ORDER BY dim) FROM (
      SELECT dim, avg(c) AS m FROM cen JOIN both_ways ON v = cen.node_id WHERE both_ways.u = d.node_id GROUP BY dim))) ** 2 AS s2
  FROM deg d JOIN nodes n USING (node_id) WHERE degree > 1
)
"""

_NEW = "list_transform(list_zip((SELECT y FROM nodes WHERE node_id = 0), (SELECT y FROM nodes WHERE node_id = 1)), lambda p: (p[1] + p[2]) / 2)"
_BEST = "SELECT vec_id, node_id, round(d2, 6) AS d2 FROM alld QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), node_id) = 1"
_COS = "1 - list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)))"
_PAIRS = f", pairs AS (SELECT a.vec_id, a.label AS la, b.vec_id AS neighbor_id, b.label AS lb, round({_COS}, 9) AS d FROM pts a, pts b)"
_RANK = "row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id)"
_FORCE = ", force AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, lb ORDER BY d, neighbor_id) AS r FROM pairs WHERE vec_id <> neighbor_id AND abs(la - lb) <= 1) WHERE r <= CASE WHEN la = lb AND la IN (0, 9) THEN 6 ELSE 3 END)"
_ORDERS = "SELECT o_orderkey, o_totalprice, (o_custkey % 7 + 1)::DOUBLE AS w FROM orders"
_BINS = "SELECT bin::INT AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM b GROUP BY bin"
_ON = f"SELECT i, j, {{}} AS value FROM (SELECT src AS i, dst AS j FROM edges UNION ALL SELECT dst, src FROM edges)"
_REPORT = f"""
, totals AS (
  SELECT (SELECT avg(d2) FROM near) AS mse, (SELECT avg(d2_proj) FROM proj) AS msep, ep, (SELECT sum({MU} * s2) FROM star) AS rp,
    (SELECT sum(v) FROM (SELECT var_samp(v) AS v FROM flat GROUP BY dim)) AS tv FROM stretch
)"""


def sql() -> dict[str, str]:
    """For each query that SQL expresses: DuckDB's SQL."""
    add = f"{BASE}, alld AS (SELECT vec_id, node_id, d2 FROM dist UNION ALL SELECT vec_id, 10, list_distance(x, {_NEW}) ** 2 FROM pts) {_BEST}"
    move = f"{BASE}, alld AS (SELECT vec_id, node_id, d2 FROM dist WHERE node_id <> 0 UNION ALL SELECT vec_id, 0, list_distance(x, {_NEW}) ** 2 FROM pts) {_BEST}"
    drop = f"{BASE}, alld AS (SELECT vec_id, node_id - 1 AS node_id, d2 FROM dist WHERE node_id <> 0) {_BEST}"
    nearest = f"{BASE} SELECT vec_id, node_id, round(d2, 6) AS d2 FROM near"
    projected = f"{BASE} SELECT vec_id, edge_id, round(u, 6) AS edge_loc, round(d2_proj, 6) AS d2_proj FROM proj"
    degree_edges = f"{BASE}, e AS (SELECT edge_id, src, dst, len, a.degree AS da, b.degree AS db FROM ends JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst)"
    penalized = "SELECT sum((0.01 + 0.01 * greatest(0, greatest(da, db) - 2)) * len * len) FROM e"
    ring = "(6, 7), (7, 9)"
    beyond = ", beyond AS (SELECT p.vec_id, p.node_id AS leaf, d2 FROM proj p JOIN deg USING (node_id) WHERE degree = 1 AND ((src = p.node_id AND u < 0) OR (dst = p.node_id AND u > 1)))"
    out = {
        "entry_node_summary": f"{BASE} SELECT node_id, count(*) AS n, round(avg(d2), 6) AS mse, round(avg(x[1]), 6) AS mean_x0 FROM near JOIN pts USING (vec_id) GROUP BY node_id",
        "join_1_nearest_node": nearest,
        "join_1_expression": nearest,
        "str_1_stream_score": nearest,
        "prj_4_trimmed_assign": f"{BASE} SELECT vec_id, CASE WHEN d2 > {TRIM} * {TRIM} THEN -1 ELSE node_id END AS node_id, round(least(d2, {TRIM} * {TRIM}), 6) AS d2 FROM near",
        "join_3_repartition_add_node": add,
        "join_3_repartition_move_node": move,
        "join_3_repartition_remove_node": drop,
        "join_4_barycenter_assign": f"""{BASE}, s AS (SELECT n.node_id, stddev_pop(v) AS s FROM near n JOIN flat f ON f.vec_id = n.vec_id GROUP BY 1)
            SELECT vec_id, node_id, round(d2 / s + s, 6) AS d FROM dist JOIN s USING (node_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d2 / s + s, 9), node_id) = 1""",
        "join_5_node_distances": f"{BASE} SELECT a.node_id AS a, b.node_id AS b, round(list_distance(a.y, b.y), 6) AS dist FROM nodes a, nodes b",
        "join_7_radial_count": f"{BASE} SELECT radius::DOUBLE AS radius, count(*) FILTER (WHERE d2 < radius * radius) AS n_pairs FROM dist, (SELECT unnest({RADII}::DOUBLE[]) AS radius) GROUP BY 1",
        "join_8_project_graph": projected,
        "join_8_project_join": projected,
        "join_10_projection_points": f"{BASE} SELECT vec_id, node_id, round(d2, 6) AS d2, unnest(generate_series(0, len(f) - 1))::INT AS dim, round(unnest(f), 6) + 0 AS value FROM proj",
        "join_16_branch_members": f"{BASE} SELECT path_id, count(*) AS n_points FROM near JOIN branch ON list_contains(path, node_id) GROUP BY 1",
        "join_19_nearest_member": f"{BASE} SELECT node_id, vec_id FROM near QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(d2, 9), vec_id) = 1",
        "join_20_nearest_start_node": """SELECT n_regionkey AS fixed_id, (SELECT i FROM (SELECT unnest(generate_series(0, 10)) AS i) ORDER BY abs(i * 1000.0 - bal), i LIMIT 1)::INT AS node_id
            FROM (SELECT n_regionkey, avg(s_acctbal) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)""",
        "join_21_row_norms": f"{BASE} SELECT vec_id, round(list_inner_product(x, x), 6) AS x2 FROM pts",
        "volume_lineitem_assign": """WITH p AS (SELECT row_number() OVER () AS k, l_linenumber - 1 AS own, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount * 10 AS c FROM lineitem),
            n AS (SELECT own AS node_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM p GROUP BY 1),
            d AS (SELECT k, node_id, (p.a - n.a) ** 2 + (p.b - n.b) ** 2 + (p.c - n.c) ** 2 AS d2 FROM p, n),
            m AS (SELECT arg_min(node_id, d2) AS node_id, min(d2) AS d2 FROM d GROUP BY k)
            SELECT node_id::INT AS node_id, count(*) AS n, round(avg(d2), 6) AS mse FROM m GROUP BY 1""",
        "join_12_knn_cosine": f"{BASE}{_PAIRS} SELECT vec_id, {_RANK}::INT AS rank, neighbor_id FROM pairs WHERE vec_id <> neighbor_id QUALIFY {_RANK} <= 5",
        "join_13_knn_guide": f"{BASE}{_PAIRS} SELECT vec_id, {_RANK}::INT AS rank, neighbor_id FROM pairs WHERE abs(la - lb) <= 1 QUALIFY {_RANK} <= 5",
        "join_14_knn_force": f"{BASE}{_PAIRS}{_FORCE} SELECT vec_id, {_RANK}::INT AS rank, neighbor_id FROM force",
        "join_15_supervised": f"""{BASE}{_PAIRS}{_FORCE}, nat AS (SELECT vec_id, {_RANK} AS rank, neighbor_id FROM pairs WHERE vec_id <> neighbor_id QUALIFY {_RANK} <= 3)
            SELECT vec_id, rank::INT AS rank, neighbor_id FROM nat UNION ALL
            SELECT vec_id, (3 + {_RANK})::INT, neighbor_id FROM force ANTI JOIN nat USING (vec_id, neighbor_id) QUALIFY {_RANK} <= 6""",
        "io_7_sparse_neighbours": f"""{BASE}, pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.x, b.x), 9) AS d FROM pts a, pts b WHERE a.vec_id <> b.vec_id)
            SELECT vec_id AS row, neighbor_id AS col, round(d, 6) AS value FROM pairs QUALIFY {_RANK} <= 3""",
        "agg_12_density": f"{BASE} SELECT a.vec_id, count(*) FILTER (WHERE list_distance(a.x, b.x) < 1.25) AS n_neighbors FROM pts a, pts b GROUP BY 1",
        "agg_13_kde_weights": f"""{BASE}, k AS (SELECT a.vec_id, 1 / sum(exp(-(list_distance(a.x, b.x) ** 2) / (2 * 0.25))) AS v FROM pts a, pts b GROUP BY 1)
            SELECT vec_id, round(v / sum(v) OVER (), 9) AS weight FROM k""",
        "agg_1_node_centers": f"""{BASE}, t AS (SELECT n.vec_id, node_id FROM near n WHERE d2 <= {TRIM} * {TRIM}), s AS (SELECT node_id, count(*) AS n FROM t GROUP BY 1)
            SELECT node_id, dim, round(avg(v), 6) AS center, round(any_value(n) / (SELECT count(*) FROM pts), 6) AS rel_size FROM t JOIN flat USING (vec_id) JOIN s USING (node_id) GROUP BY node_id, dim""",
        "agg_2_energy_base": f"{BASE}{_REPORT} SELECT round(mse + ep + rp, 6) AS energy, round(mse, 6) AS mse, round(ep, 6) AS ep, round(rp, 6) AS rp FROM totals",
        "agg_4_energy_penalized": f"""{degree_edges}, t AS (SELECT (SELECT avg(d2) FROM near) AS mse, ({penalized}) AS ep, (SELECT sum({MU} * sqrt(degree) * s2) FROM star) AS rp)
            SELECT round(mse + ep + rp, 6) AS energy, round(mse, 6) AS mse, round(ep, 6) AS ep, round(rp, 6) AS rp FROM t""",
        "agg_6_label_entropy": _entropy("branch_id, round(h, 4) AS h FROM h"),
        "agg_7_label_loss": _entropy("round(sum(round(h, 4)) * 0.01 / (SELECT count(*) FROM pts), 5) AS loss FROM h"),
        "agg_8_report": f"""{BASE}{_REPORT} SELECT metric, round(value::DOUBLE, 5) AS value FROM (
            SELECT unnest(['energy', 'nnodes', 'nedges', 'nribs', 'nstars', 'nrays', 'nrays2', 'mse', 'msep', 'fve', 'fvep', 'ue', 'ur', 'urn', 'urn2', 'ursd']) AS metric,
              unnest([mse + ep + rp, 10, 9, (SELECT count(*) FROM deg WHERE degree = 2), (SELECT count(*) FROM deg WHERE degree = 3), 0, 0, mse, msep, (tv - mse) / tv, (tv - msep) / tv, ep, rp, rp * 10, rp * 100, 0]::DOUBLE[]) AS value FROM totals)""",
        "agg_9_barcode": f"""{BASE}, h AS (SELECT d AS degree, (SELECT count(*) FROM deg WHERE degree = d) AS n FROM (SELECT unnest(generate_series(3, (SELECT max(degree) FROM deg))) AS d))
            SELECT string_agg(n::VARCHAR, '|' ORDER BY degree DESC) || '||' || (SELECT count(*) FROM deg) AS barcode FROM h""",
        "agg_10_degrees": f"{BASE} SELECT degree::INT AS degree, count(*) AS n FROM deg GROUP BY 1",
        "agg_15_feature_r2": _r2(""),
        "agg_16_selected": _r2("WHERE fit / var > 0.02"),
        "agg_17_proj_embedding": f"{BASE} SELECT node_id, dim, round(avg(v), 6) AS value FROM near JOIN flat USING (vec_id) WHERE dim < 2 GROUP BY node_id, dim",
        "agg_18_leaf_quantile": f"{BASE}{beyond} SELECT leaf, round(quantile_cont(d2, 0.9), 6) AS q FROM beyond GROUP BY leaf",
        "agg_19_moving_average": """WITH o AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, o_totalprice FROM orders),
            b AS (SELECT floor((day - (SELECT min(day) FROM o)) / 30)::INT AS bin, avg(o_totalprice) AS m FROM o GROUP BY 1)
            SELECT bin, round(avg(m) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 2) AS value FROM b""",
        "agg_20_spearman": f"""{BASE}, k AS (SELECT traj_id, var,
              rank() OVER (PARTITION BY traj_id, var ORDER BY pst) + (count(*) OVER (PARTITION BY traj_id, var, pst) - 1) / 2.0 AS a,
              rank() OVER (PARTITION BY traj_id, var ORDER BY v) + (count(*) OVER (PARTITION BY traj_id, var, v) - 1) / 2.0 AS b FROM tv)
            SELECT traj_id, var, round(corr(a, b), 5) AS value FROM k GROUP BY traj_id, var""",
        "agg_21_linear_r2": f"{BASE} SELECT traj_id, var, round(regr_slope(v, pst), 5) AS slope, round(regr_intercept(v, pst), 5) AS intercept, round(regr_r2(v, pst), 5) AS r2 FROM tv GROUP BY traj_id, var",
        "agg_22_regression_table": f"{BASE} SELECT traj_id, var, round(regr_r2(v, pst), 5) AS r2 FROM tv GROUP BY traj_id, var HAVING regr_r2(v, pst) > 0.001",
        "agg_23_node_label_ratio": f"{BASE} SELECT node_id, label, round(count(*) / sum(count(*)) OVER (PARTITION BY node_id), 6) AS ratio FROM near GROUP BY node_id, label",
        "agg_24_edge_means": f"""{BASE}, f0 AS (SELECT vec_id, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS s FROM flat WHERE dim = 0),
            m AS (SELECT edge_id, avg(s) AS m FROM proj JOIN f0 USING (vec_id) GROUP BY 1),
            filled AS (SELECT e.edge_id, coalesce(m.m, (SELECT avg(n.m) FROM edges o JOIN m n ON n.edge_id = o.edge_id
              WHERE o.edge_id <> e.edge_id AND (o.src IN (e.src, e.dst) OR o.dst IN (e.src, e.dst)))) AS v FROM edges e LEFT JOIN m ON m.edge_id = e.edge_id)
            SELECT edge_id, round(v, 6) AS value FROM filled""",
        "agg_25_mahalanobis": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part),
            m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM p)
            SELECT p_partkey, round(sqrt(((a - ma) ** 2 * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) ** 2 * aa) / (aa * bb - ab * ab)), 5) AS d FROM p, m""",
        "agg_26_polygon_area": f"""{BASE}, p AS (SELECT node_id, y[1] AS px, y[2] AS py FROM nodes), q AS (SELECT px, py, lead(px) OVER w AS nx, lead(py) OVER w AS ny, first(px) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fx, first(py) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fy FROM p WINDOW w AS (ORDER BY node_id)),
            t AS (SELECT abs(sum(px * coalesce(ny, fy) - py * coalesce(nx, fx))) / 2 AS area, sum(sqrt((nx - px) ** 2 + (ny - py) ** 2)) AS len FROM q)
            SELECT round(area, 6) AS area, round(4 * pi() * area / len ** 2, 6) AS compactness FROM t""",
        "prj_1_column_subset": f"""{BASE} SELECT vec_id, node_id, round(list_distance(x[1:3], y[1:3]) ** 2, 6) AS d2 FROM pts, nodes
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(x[1:3], y[1:3]) ** 2, 9), node_id) = 1""",
        "prj_5_centering": f"{BASE} SELECT vec_id, dim, round(v - avg(v) OVER (PARTITION BY dim), 6) AS value FROM flat",
        "prj_6_covariance": f"{BASE} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.v, b.v), 6) AS value FROM flat a JOIN flat b USING (vec_id) WHERE a.dim < 4 AND b.dim < 4 GROUP BY a.dim, b.dim",
        "prj_11_uniform_em": f"{BASE} {_ON.format(f'{LAM}::DOUBLE')} UNION ALL SELECT node_id, node_id, {MU}::DOUBLE FROM deg WHERE degree > 1",
        "prj_12_cycle_em": f"""{BASE} SELECT i, j, CASE WHEN i IN (3, 4, 5) OR j IN (3, 4, 5) THEN 0.05 ELSE {LAM} END::DOUBLE AS value FROM (SELECT src AS i, dst AS j FROM edges UNION ALL SELECT dst, src FROM edges)
            UNION ALL SELECT node_id, node_id, CASE WHEN node_id IN (3, 4, 5) THEN 0.5 ELSE {MU} END::DOUBLE FROM deg WHERE degree > 1 OR node_id IN (3, 4, 5)""",
        "prj_13_encode": f"{BASE} {_ON.format(f'{LAM}::DOUBLE')} UNION ALL SELECT node_id, node_id, {MU}::DOUBLE FROM deg",
        "prj_14_decode": f"{BASE} SELECT (row_number() OVER (ORDER BY dst, src) - 1)::INT AS edge_id, src, dst, {LAM}::DOUBLE AS lam FROM edges",
        "prj_16_adjust": f"""{BASE}, o AS (SELECT node_id, degree, greatest(degree + CASE WHEN degree > 1 THEN 1 ELSE 0 END - 1, 1) AS o FROM deg)
            SELECT i, j, round({LAM} / CASE WHEN a.o > 2 THEN 10 ELSE 1 END / CASE WHEN b.o > 2 THEN 10 ELSE 1 END, 9)::DOUBLE AS value
            FROM (SELECT src AS i, dst AS j FROM edges UNION ALL SELECT dst, src FROM edges) JOIN o a ON a.node_id = i JOIN o b ON b.node_id = j
            UNION ALL SELECT node_id, node_id, (CASE WHEN o > 2 THEN {MU} / 10 ELSE {MU} END)::DOUBLE FROM o WHERE degree > 1""",
        "fit_1_laplacian": f"""{BASE}, t(i, j, v) AS (
              SELECT src, src, {LAM}::DOUBLE FROM edges UNION ALL SELECT dst, dst, {LAM} FROM edges UNION ALL SELECT src, dst, -{LAM} FROM edges UNION ALL SELECT dst, src, -{LAM} FROM edges
              UNION ALL SELECT node_id, node_id, {MU} FROM deg WHERE degree > 1
              UNION ALL SELECT d.node_id, b.v, -{MU} / degree FROM deg d JOIN both_ways b ON b.u = d.node_id WHERE degree > 1
              UNION ALL SELECT b.v, d.node_id, -{MU} / degree FROM deg d JOIN both_ways b ON b.u = d.node_id WHERE degree > 1
              UNION ALL SELECT b.v, c.v, {MU} / degree ** 2 FROM deg d JOIN both_ways b ON b.u = d.node_id JOIN both_ways c ON c.u = d.node_id WHERE degree > 1)
            SELECT i, j, round(sum(v), 9) AS value FROM t GROUP BY i, j HAVING round(sum(v), 12) <> 0""",
        "fit_14_remove_node": f"""{BASE}, leaf AS (SELECT node_id AS l, (row_number() OVER (ORDER BY node_id) - 1)::INT AS cand_id FROM deg WHERE degree = 1)
            SELECT cand_id, (node_id - CASE WHEN node_id > l THEN 1 ELSE 0 END)::INT AS node_id, dim, round(c, 6) AS value FROM leaf, cen WHERE node_id <> l""",
        "fit_15_bisect_edge": f"{BASE} SELECT edge_id AS cand_id, 10 AS node_id, a.dim, round((a.c + b.c) / 2, 6) AS value FROM edges JOIN cen a ON a.node_id = src JOIN cen b ON b.node_id = dst AND b.dim = a.dim",
        "fit_15_bisect_edge_moduli": f"""{BASE}, c AS (SELECT edge_id AS cand_id FROM edges)
            SELECT cand_id, src, dst, {LAM}::DOUBLE AS lam FROM c, edges WHERE edge_id <> cand_id
            UNION ALL SELECT edge_id, src, 10, {LAM} FROM edges UNION ALL SELECT edge_id, dst, 10, {LAM} FROM edges""",
        "fit_16_add_node": f"""{BASE}, pm AS (SELECT node_id, dim, avg(v) AS m FROM near JOIN flat USING (vec_id) GROUP BY node_id, dim),
            nm AS (SELECT b.u AS node_id, dim, avg(c) AS m FROM both_ways b JOIN cen ON cen.node_id = b.v GROUP BY b.u, dim)
            SELECT d.node_id::INT AS cand_id, 10 AS node_id, c.dim, round(CASE WHEN degree = 1 THEN 2 * c.c - nm.m ELSE coalesce(pm.m, nm.m) END, 6) AS value
            FROM deg d JOIN cen c ON c.node_id = d.node_id JOIN nm ON nm.node_id = d.node_id AND nm.dim = c.dim LEFT JOIN pm ON pm.node_id = d.node_id AND pm.dim = c.dim""",
        "fit_17_shrink_edge": f"""{degree_edges}, i AS (SELECT (row_number() OVER (ORDER BY edge_id) - 1)::INT AS cand_id, src, dst FROM e WHERE least(da, db) > 1)
            SELECT cand_id, src AS node_id, a.dim, round((a.c + b.c) / 2, 6) AS value FROM i JOIN cen a ON a.node_id = src JOIN cen b ON b.node_id = dst AND b.dim = a.dim""",
        "fit_21_avoid_solitary": f"""{BASE}, mid AS (SELECT edge_id AS cand_id, list_transform(list_zip(ya, yb), lambda p: (p[1] + p[2]) / 2) AS y FROM ends),
            alld AS (SELECT cand_id, vec_id, node_id, d2 FROM dist, (SELECT cand_id FROM mid) UNION ALL SELECT cand_id, vec_id, 10, list_distance(x, y) ** 2 FROM pts, mid),
            best AS (SELECT cand_id, node_id FROM alld QUALIFY row_number() OVER (PARTITION BY cand_id, vec_id ORDER BY round(d2, 9), node_id) = 1)
            SELECT cand_id, count(DISTINCT node_id)::INT AS n_used, count(DISTINCT node_id) = 11 AS kept FROM best GROUP BY 1""",
        "path_1_branches": f"{BASE} SELECT path_id, unnest(generate_series(0, len(path) - 1))::INT AS pos, unnest(path) AS node_id FROM branch",
        "path_1_end_to_end": f"""{BASE}, far(s, node_id, path) AS (SELECT node_id, node_id, [node_id] FROM deg WHERE degree = 1 UNION ALL SELECT s, v, list_append(path, v) FROM far JOIN both_ways ON u = node_id WHERE NOT list_contains(path, v)),
            f AS (SELECT (row_number() OVER (ORDER BY s, node_id) - 1)::INT AS path_id, path FROM far JOIN deg USING (node_id) WHERE degree = 1 AND s < node_id)
            SELECT path_id, unnest(generate_series(0, len(path) - 1))::INT AS pos, unnest(path)::INT AS node_id FROM f""",
        "path_3_bfs": f"{BASE} SELECT node_id::INT AS node_id, (len(path) - 1)::INT AS depth FROM walk",
        "path_6_root_paths": f"{BASE} SELECT path_id, unnest(generate_series(0, len(path) - 1))::INT AS pos, unnest(path)::INT AS node_id FROM rootpath",
        "path_7_pseudotime": _pseudotime("WHERE list_contains((SELECT path FROM walk WHERE node_id = 9), p.node_id)", "(SELECT path FROM walk WHERE node_id = 9)"),
        "path_7_pseudotime_tree": _pseudotime("", None),
        "path_10_trajectories": f"{BASE} SELECT traj_id, vec_id, round(pst, 6) AS pst FROM traj",
        "path_14_branch_labels": f"""{BASE}, b AS (SELECT path_id, unnest(path) AS node_id FROM branch), inner_d AS (SELECT vec_id, path_id, min(round(d2, 9)) AS d FROM dist JOIN b USING (node_id) WHERE node_id <> 3 GROUP BY ALL),
            j AS (SELECT vec_id, arg_min(path_id, (d, path_id)) AS path_id FROM inner_d GROUP BY 1)
            SELECT n.vec_id, CASE WHEN n.node_id = 3 THEN j.path_id ELSE b.path_id END::INT AS branch_id FROM near n JOIN j USING (vec_id) LEFT JOIN b ON b.node_id = n.node_id AND n.node_id <> 3""",
        "path_17_cycles": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges UNION ALL (SELECT * FROM (VALUES {ring})) UNION ALL (SELECT * FROM (VALUES (7, 6), (9, 7)))),
            w AS (SELECT u AS s, v AS cur, [u, v] AS path FROM e WHERE v > u UNION ALL SELECT s, v, list_append(path, v) FROM w JOIN e ON u = cur WHERE v > s AND NOT list_contains(path, v)),
            c AS (SELECT path FROM w JOIN e ON e.u = cur AND e.v = s WHERE len(path) > 2 AND path[2] < path[len(path)]),
            n AS (SELECT (row_number() OVER (ORDER BY len(path), path) - 1)::INT AS path_id, path FROM c)
            SELECT path_id, unnest(generate_series(0, len(path) - 1))::INT AS pos, unnest(path)::INT AS node_id FROM n""",
        "path_20_components": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT src AS u, dst AS v FROM edges WHERE edge_id NOT IN (3, 6) UNION ALL SELECT dst, src FROM edges WHERE edge_id NOT IN (3, 6)),
            r AS (SELECT unnest(generate_series(0, 9)) AS s, s AS cur UNION SELECT s, v FROM r JOIN e ON u = cur),
            m AS (SELECT s AS node_id, min(cur) AS least FROM r GROUP BY 1)
            SELECT (dense_rank() OVER (ORDER BY least) - 1)::INT AS component, node_id::INT AS node_id FROM m""",
        "win_1_even_bins": f"WITH o AS ({_ORDERS}), b AS (SELECT *, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) * 20 - 1) // count(*) OVER () AS bin FROM o) {_BINS}",
        "win_4_weighted_bins": f"WITH o AS ({_ORDERS}), c AS (SELECT *, round(sum(w) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(w) OVER () * 20, 9) AS s FROM o), b AS (SELECT *, least(19, greatest(0, ceil(s) - 1)) AS bin FROM c) {_BINS}",
        "win_9_equal_width": f"WITH o AS ({_ORDERS}), e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS wd FROM o), b AS (SELECT *, greatest(0, least(19, ceil(round((o_totalprice - lo) / wd, 9)) - 1)) AS bin FROM o, e) {_BINS}",
        "win_14_path_distance": f"{BASE}, p AS (SELECT unnest(path) AS node_id, unnest(generate_series(0, len(path) - 1))::INT AS pos FROM walk WHERE node_id = 9) SELECT pos, p.node_id::INT AS node_id, round(far, 6) AS dist FROM p JOIN walk USING (node_id)",
        "win_20_gap_fill": """WITH e AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS pos, value FROM events),
            p AS (SELECT event_type, pos, CASE WHEN count(*) > 1 THEN avg(value) END AS m FROM e GROUP BY ALL),
            q AS (SELECT event_type, pos, last_value(CASE WHEN m IS NOT NULL THEN {'p': pos, 'v': m} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
              first_value(CASE WHEN m IS NOT NULL THEN {'p': pos, 'v': m} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
            SELECT event_type, pos, round(CASE WHEN b.p - a.p > 0 THEN a.v + (b.v - a.v) * (pos - a.p) / (b.p - a.p) ELSE coalesce(a.v, b.v) END, 6) AS value FROM q""",
        "sort_2_longest_edges": f"{BASE} SELECT edge_id FROM ends ORDER BY round(len, 9) DESC, edge_id LIMIT 3",
        "sort_3_busiest_nodes": f"{BASE} SELECT node_id, count(*) AS n FROM near GROUP BY node_id ORDER BY n DESC, node_id LIMIT 3",
        "sort_4_shortest_edges": f"{degree_edges} SELECT edge_id FROM e WHERE least(da, db) > 1 ORDER BY round(len, 9), edge_id LIMIT 3",
        "set_3_equivalent_loops": """WITH l AS (SELECT vec_id, unnest(generate_series(greatest(0, label - 5), label)) AS loop_id FROM embeddings), s AS (SELECT loop_id, count(*) AS n FROM l GROUP BY 1),
            o AS (SELECT a.loop_id AS a, b.loop_id AS b, count(*) AS n FROM l a JOIN l b USING (vec_id) WHERE a.loop_id < b.loop_id GROUP BY ALL)
            SELECT a::INT AS a, b::INT AS b, round(o.n / greatest(x.n, y.n), 6) AS overlap FROM o JOIN s x ON x.loop_id = a JOIN s y ON y.loop_id = b WHERE o.n / greatest(x.n, y.n) > 2 / 3""",
        "edit_1_extend_quantcentroid": f"""{BASE}{beyond}, q AS (SELECT leaf, quantile_cont(d2, 0.6) AS q FROM beyond GROUP BY 1)
            SELECT leaf, dim, round(avg(v), 6) AS value FROM beyond JOIN q USING (leaf) JOIN flat f USING (vec_id) WHERE d2 >= q - 1e-12 GROUP BY leaf, dim""",
        "edit_1_extend_weighted": f"""{BASE}{beyond}, w AS (SELECT vec_id, leaf, pow(d2, 1.6) / max(pow(d2, 1.6)) OVER (PARTITION BY leaf) AS w FROM beyond)
            SELECT leaf, dim, round(sum(w * v) / sum(w), 6) AS value FROM w JOIN flat USING (vec_id) GROUP BY leaf, dim""",
        "edit_3_branch_stats": f"""{BASE}, be AS (SELECT path_id, edge_id, len FROM branch JOIN ends ON list_contains(path, src) AND list_contains(path, dst)),
            s AS (SELECT path_id, count(*)::INT AS n_edges, sum(len) AS length FROM be GROUP BY 1),
            p AS (SELECT path_id, count(*) AS n_points, count(*) FILTER (WHERE u > 0 AND u < 1) AS n_inner FROM proj JOIN be USING (edge_id) GROUP BY 1),
            l AS (SELECT path_id, count(*) AS n_leaf FROM near JOIN deg USING (node_id) JOIN branch ON list_contains(path, node_id) WHERE degree = 1 GROUP BY 1)
            SELECT path_id AS branch_id, coalesce(n_points, 0) AS n_points, coalesce(n_inner, 0) AS n_inner, coalesce(n_leaf, 0) AS n_leaf, n_edges, round(length, 6) AS length FROM s LEFT JOIN p USING (path_id) LEFT JOIN l USING (path_id)""",
        "edit_4_shift_target": f"""{BASE}, hops AS (SELECT 3 AS node_id, 3 AS cur, [3] AS path UNION ALL SELECT h.node_id, v, list_append(path, v) FROM hops h JOIN both_ways ON u = cur WHERE NOT list_contains(path, v) AND len(path) <= 3),
            c AS (SELECT h.node_id, cur AS target, (len(path) - 1)::INT AS hops, (SELECT count(*) FROM near n WHERE n.node_id = cur) AS value FROM hops h)
            SELECT node_id, target::INT AS target, hops, value FROM c QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY value DESC, hops, target) = 1""",
        "edit_4_shift_branching": "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3), (2, 4), (4, 5), (5, 6), (2, 7), (2, 8), (8, 9)) t(src, dst)",
        "edit_6_add_path": f"WITH {_EDGES} SELECT src, dst FROM edges UNION ALL SELECT * FROM (VALUES (6, 10), (10, 11), (11, 12), (12, 13), (7, 13)) t(src, dst)",
        "edit_7_del_path": f"WITH {_EDGES} SELECT src - 2 AS src, dst - 2 AS dst FROM edges WHERE edge_id NOT IN (0, 1)",
        "io_9_adjacency": f"{BASE} SELECT u, v, round(len, 6) AS len FROM both_ways",
        "io_2_table_source": "SELECT p_partkey AS point_id, unnest([0, 1])::INT AS dim, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part",
        "str_2_drift": f"{BASE} SELECT node_id, count(*) AS n FROM near GROUP BY 1",
        "str_3_occupancy": """WITH n AS (SELECT unnest(generate_series(0, 6)) AS node_id), d AS (SELECT event_id, ts, arg_min(node_id, (round((value - node_id * 10) ** 2, 9), node_id)) AS node_id FROM events, n GROUP BY event_id, ts)
            SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS start, node_id::INT AS node_id, count(*) AS n FROM d GROUP BY 1, 2""",
        "viz_3_pseudotime_curve": f"""{BASE}, g AS (SELECT traj_id, var, regr_slope(v, pst) AS s, regr_intercept(v, pst) AS i, min(pst) AS lo, max(pst) AS hi FROM tv GROUP BY traj_id, var)
            SELECT traj_id, var, round(lo + (hi - lo) * k / 9, 5) AS pst, round(i + s * (lo + (hi - lo) * k / 9), 5) AS value FROM g, (SELECT unnest(generate_series(0, 9)) AS k)""",
        "win_7_filled_means": """WITH e AS (SELECT min(s_acctbal) AS lo, (max(s_acctbal) - min(s_acctbal)) / 100 AS wd FROM supplier),
            b AS (SELECT greatest(0, least(99, ceil(round((s_acctbal - lo) / wd, 9)) - 1))::INT AS bin, s_acctbal FROM supplier, e), m AS (SELECT bin, count(*) AS n, avg(s_acctbal) AS m FROM b GROUP BY 1),
            g AS (SELECT k AS bin, coalesce(n, 0) AS n, m FROM (SELECT unnest(generate_series(0, 99))::INT AS k) LEFT JOIN m ON bin = k), o AS (SELECT * FROM g ORDER BY bin),
            f AS (SELECT list(m ORDER BY bin) AS ms, list(n ORDER BY bin) AS ns FROM g),
            r(i, acc) AS (SELECT 0, []::DOUBLE[] UNION ALL SELECT i + 1, list_append(acc, coalesce(ms[i + 1], CASE WHEN (i > 0 AND acc[i] IS NOT NULL) AND ms[i + 2] IS NOT NULL THEN (acc[i] + ms[i + 2]) / 2 ELSE coalesce(CASE WHEN i > 0 THEN acc[i] END, ms[i + 2]) END)) FROM r, f WHERE i < 100)
            SELECT unnest(generate_series(0, 99))::INT AS bin, unnest(ns) AS n, round(unnest(acc), 4) AS mean FROM r, f WHERE i = 100""",
    }
    out["win_7_filled_means"] = out["win_7_filled_means"].replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    return out


def _entropy(what: str) -> str:
    return f"""{BASE}, b AS (SELECT path_id AS branch_id, label, count(*) AS n FROM near JOIN branch ON list_contains(path, node_id) GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY branch_id) AS a FROM b),
        h AS (SELECT branch_id, CASE WHEN max(a) > 1 THEN sum(-n / a * ln(n / a)) / ln(max(a)) * max(a) ELSE 1.0 END AS h FROM t GROUP BY 1) SELECT {what}"""


def _r2(where: str) -> str:
    return f"""{BASE}, m AS (SELECT node_id, dim, count(*) AS n, avg(v) AS m FROM near JOIN flat USING (vec_id) GROUP BY ALL),
        f AS (SELECT dim, sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 AS fit FROM m GROUP BY 1), v AS (SELECT dim, var_pop(v) AS var FROM flat GROUP BY 1)
        SELECT dim, round(fit / var, 6) AS r2 FROM f JOIN v USING (dim) {where}"""


def _pseudotime(where: str, path: str | None) -> str:
    on = f"list_contains({path}, p.node_id)" if path else "true"
    place = (lambda n: f"coalesce(nullif(list_position({path}, {n}), 0), 99)") if path else (lambda n: f"(SELECT far FROM walk w WHERE w.node_id = {n})")
    far = lambda n: f"(SELECT far FROM walk w WHERE w.node_id = {n})"
    return f"""{BASE} SELECT vec_id, CASE WHEN {on} THEN round(CASE WHEN {place('src')} <= {place('dst')} THEN {far('src')} + len * greatest(0, least(1, u))
        ELSE {far('dst')} + len * (1 - greatest(0, least(1, u))) END, 6) END AS pt FROM proj p"""
