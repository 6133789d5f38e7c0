"""Principal angles and distances between subspaces given by orthonormal bases."""

from __future__ import annotations

import numpy as np

from subspan.config import METRICS


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown distance: {metric}")


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ascending angles between the column spans of a and b (orthonormal columns, equally many)."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("the subspaces differ in dimension")
    return np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), 0.0, 1.0))


def distance(a: np.ndarray, b: np.ndarray, metric: str = "geodesic") -> float:
    _check(metric)
    angles = principal_angles(a, b)
    return float(np.sqrt((angles**2).sum() if metric == "geodesic" else (np.sin(angles) ** 2).sum()))


def distances(products: np.ndarray, metric: str) -> np.ndarray:
    """Distances from stacks of p x p inner products: closed form for p up to 2, singular values beyond."""
    _check(metric)
    p = products.shape[-1]
    if metric == "chordal":
        return np.sqrt(np.maximum(0.0, p - (products**2).sum(axis=(-1, -2))))
    if p == 1:
        return np.arccos(np.clip(np.abs(products[..., 0, 0]), 0.0, 1.0))
    if p == 2:
        half = (products**2).sum(axis=(-1, -2)) / 2
        det = np.abs(products[..., 0, 0] * products[..., 1, 1] - products[..., 0, 1] * products[..., 1, 0])
        large = half + np.sqrt(np.maximum(0.0, half * half - det * det))
        small = np.divide(det * det, large, out=np.zeros_like(large), where=large > 0)
        s = np.clip(np.sqrt(np.stack([large, small], axis=-1)), 0.0, 1.0)
    else:
        s = np.clip(np.linalg.svd(products, compute_uv=False), 0.0, 1.0)
    return np.sqrt((np.arccos(s) ** 2).sum(axis=-1))
