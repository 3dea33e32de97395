"""The familiar calls, end to end on a small cloud: fit, edit, project, order."""

import numpy as np
import pytest

from filigree import compat as C


def cloud(seed=0, n=300):
    rng = np.random.default_rng(seed)
    ends = np.array([[1.0, 0.0], [-0.5, 0.9], [-0.5, -0.9]])
    return np.vstack([rng.random((n // 3, 1)) * e for e in ends]) + rng.normal(0, 0.03, (n, 2))


def test_fit_edit_and_order(spark):
    x = cloud()
    (pg,) = C.computeElasticPrincipalTree(x, 12, Lambda=0.02, Mu=0.05, nReps=1, drawPCAView=False, n_cores=2)
    assert pg["NodePositions"].shape == (12, 2) and len(pg["Edges"][0]) == 11 and pg["FinalReport"]["nnodes"] == 12
    assert C.CollapseBranches(x, pg, "PointNumber", 2)["NodePositions"].shape[0] <= 12
    longer = C.ExtendLeaves(x, pg, "QuantCentroid", 0.5)
    assert len(longer["NodePositions"]) >= 12
    assert len(C.ShiftBranching(x, pg, "NodePoints")["NodePositions"]) == 12
    (tuned,) = C.fineTuneBR(x, 13, pg["NodePositions"], pg["Edges"][0])
    (grown,) = C.GrowLeaves(x, 14, pg["NodePositions"], pg["Edges"][0])
    assert len(grown["NodePositions"]) == 14 and len(tuned["NodePositions"]) >= 12
    leaf = int(np.nonzero(np.bincount(pg["Edges"][0].ravel()) == 1)[0][0])
    C.getPseudotime(x, pg, leaf)
    assert len(pg["pseudotime"]) == 300 and np.nanmin(pg["pseudotime"]) >= 0 and pg["projection"]["MSEP"] < 0.05
    C.refitGraph(x, pg, {0: np.array([9.0, 9.0])})
    assert np.allclose(pg["NodePositions"][0], 9)


def test_curves_circles_weights_and_neighbours(spark):
    x = cloud()
    w = C.getWeights(x, 0.5)
    assert np.isclose(w.sum(), 1) and w.shape == (300, 1)
    (curve,) = C.computeElasticPrincipalCurve(x, 6, PointWeights=w.ravel())
    (circle,) = C.computeElasticPrincipalCircle(x, 6, TrimmingRadius=0.8)
    assert len(curve["Edges"][0]) == 5 and len(circle["Edges"][0]) == 6
    (led,) = C.computeElasticPrincipalTree(x, 12, pseudotime=np.linalg.norm(x, axis=1), PseudotimeLambda=0.3)
    assert len(led["NodePositions"]) == 12
    several = C.computeElasticPrincipalTree(x, 5, nReps=2, ProbPoint=0.9)
    assert len(several) == 3
    assert len(C.computeElasticPrincipalTree(x, 5, nReps=2, ProbPoint=0.9, SampleIC=False, FixNodesAtPoints=[], Subsets=[])) == 3
    dist, near = C.supervised_knn(x, np.arange(300) % 3, n_neighbors=6, n_natural=2)
    assert dist.shape == (300, 6) and (near >= 0).all()
    assert C.geodesic_pseudotime(x, 12, 0)[0] == 0


def test_arguments_without_effect_raise(spark):
    x = cloud(n=60)
    pg = {"NodePositions": np.array([[0.0, 0.0], [1.0, 0.0], [0.5, 1.0]]), "Edges": (np.array([[0, 1], [0, 2]]), 0.01, 0.1)}
    for call in (
        lambda: C.computeElasticPrincipalCurve(x, 4, AvoidResampling=False),
        lambda: C.computeElasticPrincipalCurve(x, 4, Lambdda=0.1),
        lambda: C.ShiftBranching(x, pg, Compensate=True),
        lambda: C.addPath(x, pg, 1, 2, weight=np.ones(60)),
        lambda: C.getWeights(x, 0.5, kernel="tophat"),
        lambda: C.supervised_knn(x, np.arange(60) % 2, metric="cosine"),
    ):
        with pytest.raises(TypeError):
            call()
    C.computeElasticPrincipalCurve(x, 4, AvoidResampling=True, Lambda_Initial=None, n_cores=4)
