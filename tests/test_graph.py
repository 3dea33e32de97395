"""Graphs, elasticity and energies: identities that hold whatever the positions."""

import numpy as np
import pytest

from filigree.graph import Graph, adjust_by_constant, barcode, energy, uniform, uniform_with_cycle
from filigree.plans import grammar

TREE = np.array([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7), (3, 8), (8, 9)])


def tree(seed=0, m=3):
    return uniform(np.random.default_rng(seed).standard_normal((10, m)), TREE, 0.01, 0.1)


@pytest.mark.parametrize("seed", range(5))
def test_energy_is_the_laplacians_quadratic_form(seed):
    g = tree(seed)
    e = energy(g, 0.25)
    assert np.isclose(np.trace(g.y.T @ g.laplacian() @ g.y), e.stretch + e.bend)
    assert np.isclose(e.total, 0.25 + e.stretch + e.bend)


def test_laplacian_is_semidefinite_with_zero_rows():
    lap = tree().laplacian()
    assert np.allclose(lap.sum(1), 0) and np.allclose(lap, lap.T) and np.linalg.eigvalsh(lap).min() > -1e-12


def test_edges_are_ordered_by_their_larger_end():
    g = Graph(np.zeros((4, 1)), [(3, 0), (2, 1), (0, 1)], [3.0, 2.0, 1.0], 0.0)
    assert g.edges.tolist() == [[0, 1], [1, 2], [0, 3]] and g.lam.tolist() == [1.0, 2.0, 3.0]


def test_matrix_round_trip():
    g = tree()
    back = Graph.from_matrix(g.y, g.matrix())
    assert (back.edges == g.edges).all() and np.allclose(back.lam, g.lam) and np.allclose(back.mu, g.mu)


def test_barcodes():
    assert barcode(tree()) == "1|0||10"
    assert barcode(uniform(np.zeros((3, 1)), [(0, 1), (1, 2)], 1, 1)) == "0||3"


def test_cycle_elasticity():
    g = uniform_with_cycle(np.zeros((10, 1)), TREE, 0.01, 0.1, 0.5, 0.7, [3, 4])
    on = np.isin(g.edges, [3, 4]).any(1)
    assert (g.lam[on] == 0.5).all() and (g.lam[~on] == 0.01).all() and g.mu[3] == g.mu[4] == 0.7 and g.mu[0] == 0


def test_adjusting_weakens_stars_once():
    g = adjust_by_constant(tree())
    assert g.adjusted[3] and np.isclose(g.mu[3], 0.01) and np.allclose(adjust_by_constant(g).mu, g.mu)


def test_penalties_grow_with_rays():
    g = tree()
    base, more = energy(g, 0.0), energy(g, 0.0, "Penalized", 0.1, 1.0)
    assert more.stretch > base.stretch and more.bend > base.bend
    none = energy(g, 0.0, "Penalized", 0.0, 0.0)
    assert np.isclose(none.total, base.total)
    goals = g.y + 1.0
    assert np.isclose(energy(g, 0.0, "Penalized", goals=goals).stretch - none.stretch, 0.01 * 3 * 10)


@pytest.mark.parametrize("edit", grammar.EDITS)
def test_every_edit_keeps_a_tree_a_tree(edit):
    g = tree()
    made = grammar.candidates(g, edit, np.ones(10), np.zeros((10, 3)))
    change = {"a": 1, "b": 1, "r": -1, "s": -1}[edit[0]]
    assert made
    for c in made:
        assert c.k == g.k + change and len(c.edges) == c.k - 1 and c.is_connected()


def test_edits_of_the_junction_only():
    g = tree()
    assert len(grammar.candidates(g, "bisectedge_3", np.ones(10), g.y)) == 4
    assert len(grammar.candidates(g, "shrinkedge_3", np.ones(10), g.y)) == 3
    assert len(grammar.candidates(g, "addnode2node_1", np.ones(10), g.y)) == 4


def test_limits_take_the_right_candidates():
    g = tree()
    longest = int(np.argmax(g.edge_lengths()))
    (only,) = grammar.candidates(g, "bisectedge", np.ones(10), g.y, {"BisectEdge": 1})
    assert np.allclose(only.y[-1], g.y[g.edges[longest]].mean(0))
    (busy,) = grammar.candidates(g, "addnode2node", np.arange(10.0), g.y, {"AddNode2Node": 1})
    assert 9 in busy.edges[-1]
    with pytest.raises(ValueError):
        grammar.candidates(g, "removenode", np.ones(10), g.y, {"RemoveNode": 2})
    with pytest.raises(ValueError):
        grammar.candidates(g, "turnedge", np.ones(10), g.y)


def test_shrinking_merges_parallel_edges():
    ring = Graph(np.arange(3.0)[:, None], [(0, 1), (1, 2), (0, 2)], [1.0, 2.0, 3.0], 1.0)
    made = grammar.shrink_edges(ring)
    assert all(c.k == 2 and len(c.edges) == 1 for c in made)
    assert sorted(c.lam[0] for c in made) == [2.0, 3.0, 3.0]


def test_three_nodes_bend_in_the_middle():
    g = Graph(np.zeros((3, 1)), [(0, 1), (1, 2)], 1.0, 0.5)
    assert grammar.unbend_leaves(g).mu.tolist() == [0, 0.5, 0]
