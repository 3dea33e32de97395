"""The familiar calls over arrays or clouds, with their usual keyword arguments and result dictionaries.

``X`` is a numpy matrix, a DataFrame ``(point_id, x)`` or a ``PointCloud``.  A
graph is a dictionary with ``NodePositions`` and ``Edges`` (pairs, stretch moduli, bending
moduli).  Arguments that only steer another execution (processes, blocks, GPU, plots) are accepted and have no effect;
others that are not supported raise an error unless they have the value that changes nothing.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cloud import Engine, LocalEngine, PointCloud
from .graph import Graph
from .operators import editing as E
from .operators import paths as P
from .operators import project as J
from .operators.supervise import puller
from .plans import topologies
from .plans.fit import Fitted
from .sources.readers import from_array

#: The familiar keyword arguments and ours.
RENAMED = {
    "Lambda": "lam", "Mu": "mu", "InitNodes": "init_nodes", "MaxNumberOfIterations": "iterations", "eps": "eps", "TrimmingRadius": "radius",
    "CenterData": "center", "ReduceDimension": "dimensions", "FinalEnergy": "final_energy", "alpha": "alpha", "beta": "beta", "Mode": "mode",
    "MaxFailedOperations": "max_failed", "MaxSteps": "max_steps", "NumEdges": "max_edges", "AvoidSolitary": "avoid_solitary",
    "MaxNumberOfGraphCandidatesDict": "limits", "AdjustElasticMatrix": "adjust", "nReps": "replicas", "ProbPoint": "share", "Subsets": "subsets",
    "ICOver": "configuration", "DensityRadius": "density_radius", "PseudotimeLambda": "goal_pull", "FixNodesAtPoints": "fixed_points", "random_seed": "seed",
    "pseudotimeLambda": "goal_pull", "AdjustElasticMatrix_Initial": "adjust_first", "GrammarOrder": "order", "GrammarOptimization": "optimise", "SampleIC": "sample_start",
}

#: Familiar arguments that steer only how a call runs, what it prints or what it draws.
EXECUTION = {
    "verbose", "ShowTimer", "n_cores", "MinParOp", "ComputeMSEP", "DisplayWarnings", "StoreGraphEvolution", "GPU", "plot",
    "drawAccuracyComplexity", "drawPCAView", "drawEnergy", "ClusType", "ParallelRep", "FastSolve", "Do_PCA",
}
#: Familiar arguments that are not supported, with the value that changes nothing.
IDLE = {"AvoidResampling": True, "EmbPointProb": 1, "label": None, "labelLambda": 0.01, "AdjustVect": None, "ElasticMatrix": None, "Lambda_Initial": None, "Mu_Initial": None, "Configuration": None, "gamma": 0, "Compensate": False}


def _check(call: str, kwargs: dict, *own: str) -> None:
    """Raises for arguments that would be without effect though they ask for one."""
    for k, v in kwargs.items():
        idle = k in IDLE and (v is None or (np.ndim(v) == 0 and v == IDLE[k]))
        if k not in own and k not in EXECUTION and not idle:
            raise TypeError(f"{call}: {k}={v!r} is not supported")


def _renamed(call: str, kwargs: dict, *own: str) -> dict:
    _check(call, kwargs, *RENAMED, *own)
    out = {RENAMED[k]: v for k, v in kwargs.items() if k in RENAMED and v is not None}
    if "order" in out:
        out["order"] = tuple(out["order"])
    if not len(np.shape(out.get("fixed_points", [0]))) or not len(out.get("fixed_points", [0])):
        del out["fixed_points"]
    if not len(out.get("subsets", [0])):
        del out["subsets"]
    return out


def _spark() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("start a SparkSession first")
    return spark


def _cloud(X: Any, weights: np.ndarray | None = None) -> PointCloud:
    if weights is not None and isinstance(X, (PointCloud, DataFrame)):
        raise TypeError("weights of a cloud or table are its column w")
    if isinstance(X, PointCloud):
        return X
    return PointCloud(X if isinstance(X, DataFrame) else from_array(_spark(), X, weights))


def _points(X: Any, weights: np.ndarray | None = None) -> DataFrame:
    return _cloud(X, weights).points


def as_graph(PG: dict) -> Graph:
    edges, lam, mu = PG["Edges"]
    return Graph(PG["NodePositions"], edges, lam, mu)


def as_dict(f: Fitted | Graph) -> dict:
    g = f.graph if isinstance(f, Fitted) else f
    out: dict[str, Any] = {"NodePositions": g.y, "Edges": (g.edges, g.lam, g.mu)}
    if isinstance(f, Fitted):
        out |= {"FinalReport": f.final_report(), "ReportTable": f.report, "Lambda": f.options.lam, "Mu": f.options.mu, "FinalEnergy": f.options.rules.final_energy, "SubSetID": f.subset, "ReplicaID": f.replica, "TotalTimer": f.seconds}
    return out


def _fit(kind: str, X: Any, NumNodes: int, weights: np.ndarray | None = None, **kwargs) -> list[dict]:
    own = _renamed(kind, kwargs, "InitNodePositions", "InitEdges", "pseudotime")
    if kwargs.get("InitNodePositions") is not None:
        own["init"] = Graph(kwargs["InitNodePositions"], kwargs["InitEdges"], own.get("lam", 0.01), own.get("mu", 0.1))
    own["trace"] = True
    cloud: PointCloud | Engine = _cloud(X, weights)
    if kwargs.get("pseudotime") is not None:
        engine = cloud.engine()
        if not isinstance(engine, LocalEngine):
            raise ValueError("a fit that follows pseudotime works on a cloud that the driver can hold; sample it first")
        centre = engine.moments()[0] if own.get("center", True) else 0.0
        own["goals"], cloud = puller(engine.x - centre, np.asarray(kwargs["pseudotime"], float), engine.w), engine
    own = {k: v for k, v in own.items() if isinstance(cloud, PointCloud) or k not in ("replicas", "share", "subsets", "sample_start")}
    made = getattr(topologies, kind)(cloud, nodes=NumNodes, **own)
    return [as_dict(f) for f in (made if isinstance(made, list) else [made])]


def computeElasticPrincipalTree(X: Any, NumNodes: int, PointWeights=None, **kwargs) -> list[dict]:
    return _fit("tree", X, NumNodes, PointWeights, **kwargs)


def computeElasticPrincipalCurve(X: Any, NumNodes: int, PointWeights=None, **kwargs) -> list[dict]:
    return _fit("curve", X, NumNodes, PointWeights, **kwargs)


def computeElasticPrincipalCircle(X: Any, NumNodes: int, PointWeights=None, **kwargs) -> list[dict]:
    return _fit("circle", X, NumNodes, PointWeights, **kwargs)


def fineTuneBR(X: Any, NumNodes: int, InitNodePositions, InitEdges, GrammarOptimization: bool = False, **kwargs) -> list[dict]:
    own = _renamed("fineTuneBR", kwargs)
    init = Graph(InitNodePositions, InitEdges, own.get("lam", 0.01), own.get("mu", 0.1))
    return [as_dict(topologies.fine_tune(_cloud(X), init, NumNodes, optimise=GrammarOptimization, **own))]


def GrowLeaves(X: Any, NumNodes: int, InitNodePositions, InitEdges, **kwargs) -> list[dict]:
    own = _renamed("GrowLeaves", kwargs)
    init = Graph(InitNodePositions, InitEdges, own.get("lam", 0.01), own.get("mu", 0.1))
    return [as_dict(topologies.grow_leaves(_cloud(X), init, NumNodes, **own))]


def ExtendLeaves(X: Any, PG: dict, Mode: str = "QuantDists", ControlPar: float = 0.9, DoSA: bool = True, DoSA_maxiter: int = 2000, LeafIDs=None, TrimmingRadius: float = np.inf) -> dict:
    return as_dict(E.extend_leaves(_points(X), as_graph(PG), mode=Mode, par=ControlPar, anneal_rounds=DoSA_maxiter if DoSA else 0, leaves=LeafIDs, radius=TrimmingRadius))


def CollapseBranches(X: Any, PG: dict, Mode: str = "PointNumber", ControlPar: float = 5, TrimmingRadius: float = np.inf) -> dict:
    return as_dict(E.collapse_branches(_points(X), as_graph(PG), Mode, ControlPar, TrimmingRadius))


def ShiftBranching(X: Any, PG: dict, SelectionMode: str = "NodePoints", DensityRadius: float | None = None, MaxShift: int = 3, BrIds=None, BrIdsTarget=None, TrimmingRadius: float = np.inf, **kwargs) -> dict:
    _check("ShiftBranching", kwargs)
    if SelectionMode == "Manual":
        return as_dict(E.shift_branching(_points(X), as_graph(PG), "Manual", dict(zip(BrIds, BrIdsTarget))))
    return as_dict(E.shift_branching(_points(X), as_graph(PG), SelectionMode, density_radius=DensityRadius, most=MaxShift, junctions=BrIds, radius=TrimmingRadius))


def findPaths(X: Any, PG: dict, weights=None, **kwargs) -> dict | None:
    known = {"min_path_len": "min_path_len", "nnodes": "n_nodes", "max_inner_fraction": "max_inner_fraction", "min_node_n_points": "min_node_points", "max_n_points": "max_points", "min_compactness": "min_compactness",
             "radius": "radius", "allow_same_branch": "allow_same_branch", "fit_loops": "fit_loops", "Lambda": "lam", "Mu": "mu", "cycle_Lambda": "cycle_lam", "cycle_Mu": "cycle_mu", "ignore_equivalent": "ignore_equivalent"}
    _check("findPaths", kwargs, *known)
    made = E.find_paths(_points(X, weights), as_graph(PG), **{known[k]: v for k, v in kwargs.items() if k in known and v is not None})
    return as_dict(made) if made is not None else None


def addPath(X: Any, PG: dict, source: int, target, n_nodes: int | None = None, weights=None, refit_graph: bool = False, Mu: float = 0.1, Lambda: float = 0.01, cycle_Mu: float = 0.1, cycle_Lambda: float = 0.01, **kwargs) -> dict:
    _check("addPath", kwargs)
    return as_dict(E.add_path(_points(X, weights), as_graph(PG), source, target, n_nodes or max(2, len(PG["NodePositions"]) // 6), refit_graph, Lambda, Mu, cycle_Lambda, cycle_Mu))


def delPath(X: Any, PG: dict, source: int, target: int, nodes_to_include=None, weights=None, refit_graph: bool = False, Mu: float = 0.1, Lambda: float = 0.01, cycle_Mu: float = 0.1, cycle_Lambda: float = 0.01, **kwargs) -> dict:
    _check("delPath", kwargs)
    made = E.delete_path(as_graph(PG), source, target, nodes_to_include)
    return as_dict(E.refit_graph(_points(X, weights), made, lam=Lambda, mu=Mu, cycle_lam=cycle_Lambda, cycle_mu=cycle_Mu) if refit_graph else made)


def refitGraph(X: Any, PG: dict, shift_nodes_pos: dict | None = None, PointWeights=None, Mu=None, Lambda=None, cycle_Mu=None, cycle_Lambda=None, **kwargs) -> None:
    """Embeds the graph anew in place, as the familiar call does."""
    _check("refitGraph", kwargs)
    PG.update(as_dict(E.refit_graph(_points(X, PointWeights), as_graph(PG), shift_nodes_pos, Lambda, Mu, cycle_Lambda, cycle_Mu)))


def getProjection(X: Any, PG: dict) -> None:
    """Stores the projection of the points in the graph, as arrays in the points' order; for clouds of any size use ``operators.project``."""
    g = as_graph(PG)
    rows = J.project(_points(X), g).orderBy("point_id").toArrow()
    at = lambda c: rows[c].to_numpy(zero_copy_only=False)
    place = np.stack([np.asarray(v, float) for v in rows["x_proj"].to_pylist()])
    PG["projection"] = {"node_id": at("node_id"), "node_dist": at("d2"), "edge_id": at("edge_id"), "edge_loc": at("edge_loc"), "X_projected": place, "conn": g.edges, "edge_len": g.edge_lengths(), "MSEP": float(np.nanmean(at("d2_proj").astype(float)))}


def getPseudotime(X: Any, PG: dict, source: int, target: int | None = None, nodes_to_include=None, project: bool = True) -> None:
    """Stores each point's pseudotime in the graph, not a number off the path."""
    if project:
        getProjection(X, PG)
    g = as_graph(PG)
    found = P.pseudotime(J.project(_points(X), g), g, source, target, nodes_to_include).orderBy("point_id").toArrow()
    PG["pseudotime"] = found["pt"].to_numpy(zero_copy_only=False).astype(float)
    PG["pseudotime_params"] = {"source": source, "target": target, "nodes_to_include": nodes_to_include}


def getWeights(X: Any, bandwidth: float = 1, griddelta: float = 100, exponent: float = 1, method: str = "sklearn", **kwargs) -> np.ndarray:
    """Weights by the exact density whatever the ``method``; ``griddelta`` steers an approximation that is not made."""
    _check("getWeights", kwargs)
    if method not in ("sklearn", "fft"):
        raise ValueError(f"no such method: {method}")
    from .operators.neighbours import kde_weights

    found = kde_weights(_points(X), bandwidth, exponent).orderBy("point_id").toArrow()
    return found["weight"].to_numpy(zero_copy_only=False)[:, None]


def supervised_knn(X: Any, stages_labels, stages=None, n_neighbors: int = 15, n_natural: int = 0, m: str = "cosine", method: str = "force", **kwargs) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of the neighbours, a row per point; short rows are padded with infinity and -1."""
    from .operators.neighbours import supervised_knn as run

    _check("supervised_knn", kwargs)

    points = _points(X)
    table = _spark().createDataFrame([(i, str(s)) for i, s in enumerate(stages_labels)], "point_id long, stage string")
    found = run(points.join(F.broadcast(table), "point_id"), n_neighbors, n_natural, m, method, [str(s) for s in stages] if stages is not None else None)
    dist, near = np.full((len(stages_labels), n_neighbors), np.inf), np.full((len(stages_labels), n_neighbors), -1)
    for r in found.collect():
        dist[r["point_id"], r["rank"] - 1], near[r["point_id"], r["rank"] - 1] = r["dist"], r["neighbor_id"]
    return dist, near


def geodesic_pseudotime(X: Any, k: int, root: int) -> np.ndarray:
    from .operators.neighbours import geodesic

    return geodesic(_points(X), k, root).orderBy("point_id").toArrow()["pt"].to_numpy(zero_copy_only=False)
