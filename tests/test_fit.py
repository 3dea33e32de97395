"""Embedding and search: both engines agree, energies fall, shapes come out as they should."""

import itertools
import numpy as np
import pytest

from filigree.cloud import LocalEngine, PointCloud, SparkEngine, nearest
from filigree.graph import barcode, uniform
from filigree.operators.supervise import augmented, centroids_by_branch, even_place, path_means, puller, weighted_place
from filigree.plans import topologies
from filigree.plans.embed import Rules, embed, embed_barycentric, solve
from filigree.sources.readers import from_array


def branching(n=600, seed=0):
    """Three arms from a point, with noise."""
    rng = np.random.default_rng(seed)
    ends = np.array([[1.0, 0.0], [-0.5, 0.9], [-0.5, -0.9]])
    return np.vstack([rng.random((n // 3, 1)) * e for e in ends]) + rng.normal(0, 0.03, (n, 2))


def ring(n=400, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random(n) * 2 * np.pi
    return np.stack([np.cos(a), np.sin(a)], 1) + rng.normal(0, 0.03, (n, 2))


def start(x, k=5):
    y = x[:: len(x) // k][:k]
    return uniform(y, np.stack([np.arange(k - 1), np.arange(1, k)], 1), 0.01, 0.1)


@pytest.mark.parametrize("radius", [np.inf, 0.4])
def test_engines_agree(spark, radius):
    x = branching()
    w = np.random.default_rng(1).random(len(x)) + 0.5
    cloud = PointCloud(from_array(spark, x, w).repartition(5))
    local, far = LocalEngine(x, w), cloud.engine(small=0)
    assert isinstance(far, SparkEngine) and isinstance(cloud.engine(), LocalEngine)
    ys = [x[:7], x[100:104], x[300:312]]
    for a, b in zip(local.stats(ys, radius), far.stats(ys, radius)):
        assert np.allclose(a.weight, b.weight) and np.allclose(a.sums, b.sums) and np.isclose(a.mse, b.mse)
    for a, b in zip(local.moments(), far.moments()):
        assert np.allclose(a, b)
    rules = Rules(radius=radius, eps=1e-6)
    a, b = (embed(e, [start(x), start(x, 8)], rules) for e in (local, far))
    for p, q in zip(a, b):
        assert np.allclose(p.graph.y, q.graph.y) and np.isclose(p.energy.total, q.energy.total)


def test_trees_from_both_engines_agree(spark):
    x = branching()
    cloud = PointCloud(from_array(spark, x))
    a, b = topologies.tree(LocalEngine(x), 6), topologies.tree(cloud.engine(small=0), 6)
    assert np.allclose(a.graph.y, b.graph.y, atol=1e-8) and (a.graph.edges == b.graph.edges).all()


def test_assignment_ties_and_trimming():
    y = np.array([[0.0], [2.0]])
    node, d2 = nearest(np.array([[1.0], [5.0], [2.0]]), y, 1.5)
    assert node.tolist() == [0, -1, 1] and d2.tolist() == [1.0, 2.25, 0.0]


def test_energy_falls():
    x = branching()
    engine, g = LocalEngine(x), start(x, 9)
    last = np.inf
    for _ in range(8):
        done = embed(engine, [g], Rules(iterations=1, eps=0.0, refresh=True))[0]
        assert done.energy.total <= last + 1e-12
        g, last = done.graph, done.energy.total


def test_solution_is_the_minimum():
    x = branching()
    engine, g = LocalEngine(x), start(x)
    s = engine.stats([g.y])[0]
    y = solve(g, s)
    node = nearest(x, g.y)[0]

    def cost(y):
        return ((x - y[node]) ** 2).sum(1).mean() + np.trace(y.T @ g.laplacian() @ y)

    rng = np.random.default_rng(0)
    assert all(cost(y) <= cost(y + rng.normal(0, 0.01, y.shape)) for _ in range(50))


def test_weights_count_like_repeats():
    x = branching(300)
    g = start(x)
    w = np.random.default_rng(0).integers(1, 4, len(x))
    a = embed(LocalEngine(x, w), [g], Rules())[0]
    b = embed(LocalEngine(np.repeat(x, w, axis=0)), [g], Rules())[0]
    assert np.allclose(a.graph.y, b.graph.y)


def test_rotation_changes_nothing():
    x = branching(300)
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    a, b = topologies.curve(LocalEngine(x), 6, init=start(x, 3)), topologies.curve(LocalEngine(x @ turn), 6, init=start(x @ turn, 3))
    assert np.allclose(a.graph.y @ turn, b.graph.y, atol=1e-8)


def test_shapes():
    curve, circle = topologies.curve(LocalEngine(branching()), 12), topologies.circle(LocalEngine(ring()), 12)
    assert barcode(curve.graph) == "0||12" and len(curve.graph.edges) == 11
    assert (circle.graph.degrees() == 2).all() and len(circle.graph.edges) == 12
    assert np.allclose(np.linalg.norm(circle.graph.y, axis=1), 1, atol=0.15)
    tree = topologies.tree(LocalEngine(branching()), 12)
    assert len(tree.graph.edges) == 11 and tree.graph.is_connected()
    assert 3 in tree.graph.degrees() and (tree.graph.degrees() == 1).sum() == 3
    far = np.linalg.norm(tree.graph.y[tree.graph.degrees() == 1], axis=1)
    assert (far > 0.6).all()


def test_scenarios_of_all_options():
    """A small factorial of search mode, kind of energy and trimming; the structure must hold."""
    x = branching(300)
    lam, mu = 0.05, 0.05
    for nodes, (mode, kind, radius) in enumerate(itertools.product((1, 2), ("Base", "Penalized"), (np.inf, 0.75)), 7):
        f = topologies.tree(LocalEngine(x), nodes, lam=lam, mu=mu, radius=radius, final_energy=kind, alpha=0.02, beta=0.02, mode=mode, center=False, limits={"BisectEdge": 5, "AddNode2Node": 5, "ShrinkEdge": 5}, trace=True)
        assert f.graph.k == nodes and len(f.graph.edges) == nodes - 1 and f.graph.is_connected() and np.isfinite(f.energy.total)
        assert f.report[-1]["nnodes"] == nodes and 0 < f.report[-1]["fve"] <= 1
        tuned = topologies.fine_tune(LocalEngine(x), f.graph, nodes + 1, mode=mode)
        assert tuned.graph.is_connected()
        grown = topologies.grow_leaves(LocalEngine(x), f.graph, nodes + 2)
        assert grown.graph.k == nodes + 2 and grown.graph.is_connected()


def test_fixed_nodes_stay():
    x = branching()
    f = topologies.tree(LocalEngine(x), 8, fixed_points=[x[:20], x[-20:]])
    assert np.allclose(f.graph.y[0], x[:20].mean(0)) and np.allclose(f.graph.y[1], x[-20:].mean(0))


def test_fewer_dimensions():
    x = np.hstack([branching(), np.random.default_rng(0).normal(0, 0.001, (600, 3))])
    f = topologies.tree(LocalEngine(x), 8, dimensions=[0, 1])
    g = topologies.tree(LocalEngine(x), 8, dimensions=0.99)
    assert f.graph.y.shape == (8, 5) and np.allclose(f.graph.y, g.graph.y)


@pytest.mark.parametrize("name", ["Line", "Circle", "Random", "RandomSpace", "Density", "DensityProb"])
def test_starts(name):
    g = topologies.starting(name, 4, 0.01, 0.1, density_radius=0.3, seed=1)(LocalEngine(branching()))
    assert g.is_connected() and g.k == (4 if name in ("Line", "Circle") else 2)
    with pytest.raises(ValueError):
        topologies.starting("Star", 4, 0.01, 0.1)(LocalEngine(branching()))


def test_lonely_nodes_are_avoided_and_adjusted():
    x = branching()
    f = topologies.tree(LocalEngine(x), 10, avoid_solitary=True, adjust=True)
    node = nearest(x, f.graph.y)[0]
    assert len(set(node.tolist())) == f.graph.k


def test_barycentric_embedding():
    x = branching()
    g, node = embed_barycentric(x, np.ones(len(x)), start(x), Rules())
    assert np.isfinite(g.y).all() and set(node) <= set(range(5))


def test_replicas_and_consensus(spark):
    made = topologies.tree(PointCloud(from_array(spark, branching())), 6, replicas=3, share=0.8, subsets=[[0, 1], [0]])
    assert [(f.subset, f.replica) for f in made] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert made[0].graph.y.shape[1] == 2 and made[-1].graph.y.shape[1] == 1


def test_replicas_on_executors_share_passes_and_give_their_blocks_back(spark, monkeypatch):
    x = branching()
    cloud = PointCloud(from_array(spark, x).repartition(3))
    near = topologies.tree(cloud, 5, replicas=3, share=0.8, seed=2)
    kept, engines = spark.sparkContext._jsc.getPersistentRDDs().size(), PointCloud.engine
    monkeypatch.setattr(PointCloud, "engine", lambda self: engines(self, small=0))
    far = topologies.tree(cloud, 5, replicas=3, share=0.8, seed=2)
    assert [f.replica for f in far] == [0, 1, 2, 3]
    for a, b in zip(near, far):  # edits of equal energy may number the same nodes in another order
        p, q = (g.y[np.lexsort(np.round(g.y, 6).T)] for g in (a.graph, b.graph))
        assert np.allclose(p, q, atol=1e-8) and np.isclose(a.energy.total, b.energy.total) and barcode(a.graph) == barcode(b.graph)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_points_are_kept_as_blocks_of_bytes(spark, monkeypatch):
    x = np.vstack([branching().astype("f4").astype(float), branching()])
    w = np.random.default_rng(1).random(len(x)) + 0.5
    far = PointCloud(from_array(spark, x, w).coalesce(1)).engine(small=0)
    blocks = far.blocks.collect()
    assert len(blocks) < 4 and sum(len(b["w"]) for b in blocks) == 8 * len(x)
    ys = [x[:7], x[100:104], x[:300], x[[5, 5, 9]], x[:1]]  # equal nodes tie; one candidate is larger than a stack
    for radius in (np.inf, 0.4):
        want = LocalEngine(x, w).stats(ys, radius)
        for direct in (1 << 25, 0):
            monkeypatch.setattr("filigree.cloud.DIRECT", direct)
            for a, b in zip(want, far.stats(ys, radius)):
                assert np.allclose(a.weight, b.weight) and np.allclose(a.sums, b.sums) and np.isclose(a.spread, b.spread) and np.isclose(a.total, b.total)
    far.close()


def test_supervision_follows_pseudotime():
    x = branching()
    t = np.linalg.norm(x, axis=1)
    f = topologies.tree(LocalEngine(x), 14, goals=puller(x, t), goal_pull=0.5)
    assert f.graph.is_connected()
    line = np.linspace(0, 1, 200)[:, None] * np.ones((1, 2))
    goal = path_means(line, line[:, 0], np.ones(200), 5)
    assert np.allclose(np.diff(goal, axis=0), np.diff(goal, axis=0)[0], atol=1e-9) and goal[0, 0] < 0.2 < 0.8 < goal[-1, 0]
    assert (even_place(10, 4) == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]).all() and weighted_place(np.array([1.0, 1, 2]), 2).tolist() == [0, 0, 1]
    g = start(x)
    goals = centroids_by_branch(x, t, np.ones(len(x)), nearest(x, g.y)[0], g)
    both = augmented(g, goals, 0.2)
    assert both.k == 2 * g.k and len(both.edges) == len(g.edges) + g.k


def test_refit_holds_given_nodes():
    x = branching()
    f = topologies.tree(LocalEngine(x), 8)
    at = np.array([2.0, 2.0])
    again = topologies.refit(LocalEngine(x), f.graph, held={3: at})
    assert np.allclose(again.graph.y[3], at) and (again.graph.edges == f.graph.edges).all()
