"""Curves, circles and trees: where a fit starts and which edits it may use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np

from ..cloud import Engine, PointCloud
from ..graph import Graph, uniform
from .embed import Rules
from .fit import Fitted, Options, fit, fit_replicas, signed

#: Points that starts with random or dense points look at, at most.
MAX_POINTS = 10_000


def principal_axes(cloud: Engine, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``n`` principal directions in columns, and the standard deviations along them."""
    mean, cov = cloud.moments()
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:n]
    return mean, signed(vector[:, order]), np.sqrt(np.maximum(value[order], 0))


def line_start(cloud: Engine, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Equidistant nodes along the first principal axis, one standard deviation to either side."""
    mean, axis, sd = principal_axes(cloud, 1)
    y = mean + np.linspace(-1, 1, nodes)[:, None] * sd[0] * axis[:, 0]
    return y, np.stack([np.arange(nodes - 1), np.arange(1, nodes)], 1)


def circle_start(cloud: Engine, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on an ellipse in the plane of the first two principal axes, one standard deviation wide."""
    mean, axes, sd = principal_axes(cloud, 2)
    angle = np.linspace(0, 2 * np.pi, nodes, endpoint=False)
    y = mean + np.stack([np.cos(angle), np.sin(angle)], 1) * sd @ axes.T
    return y, np.stack([np.arange(nodes), (np.arange(nodes) + 1) % nodes], 1)


def random_start(cloud: Engine, nodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two random points with an edge between them."""
    return cloud.sample(2, seed)[:2], np.array([[0, 1]])


def random_space_start(cloud: Engine, nodes: int, seed: int = 0, groups: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Two random ones of the centres of ``groups`` groups of a sample."""
    from .kmeans import centres_of

    centres = centres_of(cloud.sample(MAX_POINTS, seed), groups, seed)
    pick = np.random.default_rng(seed).choice(len(centres), 2, replace=False)
    return centres[pick], np.array([[0, 1]])


def dense_start(cloud: Engine, nodes: int, radius: float, seed: int = 0, chance: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The point with the most others within ``radius`` (or one drawn with that chance) and a random one of those."""
    x = cloud.sample(MAX_POINTS, seed)
    rng = np.random.default_rng(seed)
    x2 = (x**2).sum(1)
    close = np.array([(np.maximum(0, x2 + x2[i] - 2 * x @ x[i]) < radius**2).sum() for i in range(len(x))])
    first = int(rng.choice(len(x), p=close / close.sum())) if chance else int(close.argmax())
    near = np.nonzero(np.linalg.norm(x - x[first], axis=1) < radius)[0]
    near = near[near != first]
    if not len(near):
        raise ValueError("no point within the density radius of the densest one")
    return x[[first, int(rng.choice(near))]], np.array([[0, 1]])


def starting(configuration: str, nodes: int, lam: float, mu: float, density_radius: float | None = None, seed: int = 0) -> Callable[[Engine], Graph]:
    """The start that a configuration names: Line, Circle, Random, RandomSpace, Density or DensityProb."""

    def make(cloud: Engine) -> Graph:
        match configuration:
            case "Line":
                y, e = line_start(cloud, nodes)
            case "Circle":
                y, e = circle_start(cloud, nodes)
            case "Random":
                y, e = random_start(cloud, nodes, seed)
            case "RandomSpace":
                y, e = random_space_start(cloud, nodes, seed)
            case "Density" | "DensityProb":
                if density_radius is None:
                    raise ValueError("a density start needs density_radius")
                y, e = dense_start(cloud, nodes, density_radius, seed, configuration == "DensityProb")
            case _:
                raise ValueError(f"no such configuration: {configuration}")
        return uniform(y, e, lam, mu) if len(y) > 2 else Graph(y, e, lam, mu)  # two nodes bend until there is a third

    return make


def _run(cloud: PointCloud | Engine, o: Options, configuration: str, init_nodes: int, init: Graph | None, replicas: int, share: float, subsets, density_radius, seed: int, fixed_points, sample_start: bool = True) -> Fitted | list[Fitted]:
    start = init if init is not None else starting(configuration, init_nodes, o.lam, o.mu, density_radius, seed)
    if isinstance(cloud, Engine):
        return fit(cloud, start, o, fixed_points)
    if replicas == 1 and share >= 1 and subsets is None:
        return fit(cloud.engine(), start, o, fixed_points)
    return fit_replicas(cloud, start, o, replicas, share, subsets, seed, fixed_points=fixed_points, sample_start=sample_start)


def _options(nodes: int, kwargs: dict, **own) -> tuple[Options, dict]:
    """Options and the arguments of ``_run`` from the keyword arguments of a topology."""
    known = {"iterations", "eps", "mode", "radius", "final_energy", "alpha", "beta", "goal_pull", "refresh"}
    rules = Rules(**({k: v for k, v in own.items() if k in known} | {k: v for k, v in kwargs.items() if k in known}))
    run = {"configuration": "Line", "init_nodes": 3, "init": None, "replicas": 1, "share": 1.0, "subsets": None, "density_radius": None, "seed": 0, "fixed_points": None, "sample_start": True}
    run |= {k: v for k, v in own.items() if k in run} | {k: v for k, v in kwargs.items() if k in run}
    rest = {k: v for k, v in (own | kwargs).items() if k not in known and k not in run}
    return Options(nodes, rules=rules, **rest), run


def curve(cloud: PointCloud | Engine, nodes: int, **kwargs) -> Fitted | list[Fitted]:
    """A curve: a line whose edges are bisected."""
    o, run = _options(nodes, kwargs, grow=(("bisectedge",),))
    return _run(cloud, o, **run)


def circle(cloud: PointCloud | Engine, nodes: int, **kwargs) -> Fitted | list[Fitted]:
    """A closed curve."""
    o, run = _options(nodes, kwargs, grow=(("bisectedge",),), configuration="Circle")
    return _run(cloud, o, **run)


#: The edits of a tree: two rounds of growth and one of shrinking make one node per step.
TREE_GROW, TREE_SHRINK = (("bisectedge", "addnode2node"),) * 2, (("shrinkedge", "removenode"),)


def tree(cloud: PointCloud | Engine, nodes: int, **kwargs) -> Fitted | list[Fitted]:
    """A tree: nodes are added and edges bisected, then an edge is shrunk or a leaf removed."""
    o, run = _options(nodes, kwargs, grow=TREE_GROW, shrink=TREE_SHRINK, final_energy="Penalized")
    return _run(cloud, o, **run)


def fine_tune(cloud: PointCloud | Engine, init: Graph, nodes: int | None = None, max_steps: int = 100, optimise: bool = False, **kwargs) -> Fitted:
    """Bisects and shrinks edges at branching nodes, to the given size or, to optimise, for so many steps."""
    nodes = init.k + 1 if nodes is None else nodes
    if optimise:
        order = ("Shrink", "Grow")
    else:
        order = ("Grow", "Shrink", "Grow") if nodes > init.k else ("Shrink", "Grow")
    o, run = _options(nodes, kwargs, grow=(("bisectedge_3",),), shrink=(("shrinkedge_3",),), order=order, max_steps=max_steps, optimise=optimise, init=init)
    return _run(cloud, o, **run)


def grow_leaves(cloud: PointCloud | Engine, init: Graph, nodes: int, max_steps: int = 100, **kwargs) -> Fitted:
    """Continues leaves until the graph has its nodes."""
    o, run = _options(nodes, kwargs, grow=(("addnode2node_1",),), max_steps=max_steps, init=init)
    return _run(cloud, o, **run)


def refit(cloud: Engine, g: Graph, rules: Rules = Rules(), held: dict[int, np.ndarray] | None = None) -> Fitted:
    """Embeds the graph anew; nodes in ``held`` are moved to the given places and stay there."""
    from .embed import embed

    held = held or {}
    order = np.array(sorted(held) + [i for i in range(g.k) if i not in held], np.int64)
    y = g.y.copy()
    for i, at in held.items():
        y[i] = at
    number = np.argsort(order)
    turned = Graph(y[order], number[g.edges], g.lam, g.mu[order], g.adjusted[order])
    done = embed(cloud, [turned], replace(rules, fixed=len(held)))[0]
    back = g.with_positions(done.graph.y[number])
    return Fitted(back, done.energy, float(np.trace(cloud.moments()[1])), Options(g.k, rules=rules))
