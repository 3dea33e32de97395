"""Lloyd's rounds on a sample that the driver holds."""

from __future__ import annotations

import numpy as np

from ..cloud import nearest


def centres_of(x: np.ndarray, groups: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Centres of ``groups`` groups of ``x``; empty groups keep their centre."""
    at = x[np.random.default_rng(seed).choice(len(x), min(groups, len(x)), replace=False)]
    for _ in range(rounds):
        node, _ = nearest(x, at)
        n = np.bincount(node, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, node, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at
