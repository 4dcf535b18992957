"""Centres of a bounded sample, for indexes and codes; a small helper in numpy."""

from __future__ import annotations

import numpy as np

#: Products of rows and centres held at once.
_PRODUCTS = 1 << 20


def nearest_centres(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the centre nearest to each row of m; the first of equals."""
    norms, step = (centres * centres).sum(axis=1)[None, :], max(1, _PRODUCTS // len(centres))
    parts = [np.argmin(norms - 2 * (m[at : at + step] @ centres.T), axis=1) for at in range(0, len(m), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def centres_of(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Up to k centres of the rows of sample, by Lloyd's rounds from distinct random rows; a centre without rows stays."""
    distinct = np.unique(sample, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.sort(np.random.default_rng(seed).choice(len(distinct), k, replace=False))].astype(np.float64)
    for _ in range(rounds):
        of = nearest_centres(sample, centres)
        n = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, weights=column, minlength=k) for column in sample.T], axis=1)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres
