"""Geometric verification of matched places by RANSAC, for each query and candidate apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Matches that each model needs.
NEEDS = {"similarity": 2, "affine": 3, "homography": 4}


def _fit(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map from places a to places b by least squares, or None if the places don't determine one."""
    n, one, zero = len(a), np.ones(len(a)), np.zeros(len(a))
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    if model == "similarity":
        rows = np.concatenate([np.column_stack([x, -y, one, zero]), np.column_stack([y, x, zero, one])])
        p, _, rank, _ = np.linalg.lstsq(rows, np.concatenate([u, v]), rcond=None)
        return None if rank < 4 else np.array([[p[0], -p[1], p[2]], [p[1], p[0], p[3]], [0, 0, 1]])
    if model == "affine":
        p, _, rank, _ = np.linalg.lstsq(np.column_stack([x, y, one]), b, rcond=None)
        return None if rank < 3 else np.vstack([p.T, [0, 0, 1]])
    rows = np.zeros((2 * n, 9))
    rows[0::2] = np.column_stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u])
    rows[1::2] = np.column_stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v])
    _, s, vt = np.linalg.svd(rows)
    return None if s[min(len(s) - 1, 7)] < 1e-9 else vt[-1].reshape(3, 3)


def _inliers(h: np.ndarray, a: np.ndarray, b: np.ndarray, within: float) -> np.ndarray:
    p = np.column_stack([a, np.ones(len(a))]) @ h.T
    with np.errstate(all="ignore"):
        error = np.linalg.norm(p[:, :2] / p[:, 2:] - b, axis=1)
    return np.nan_to_num(error, nan=np.inf) <= within


def ransac(a: np.ndarray, b: np.ndarray, model: str = "homography", within: float = 2.0, rounds: int = 200, seed: int = 0) -> int:
    """The most matches that one map explains; 0 if there are fewer than the model needs."""
    need = NEEDS[model]
    if len(a) < need:
        return 0
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(rounds):
        pick = rng.choice(len(a), need, replace=False)
        h = _fit(model, a[pick], b[pick])
        if h is not None and (found := _inliers(h, a, b, within)).sum() > best.sum():
            best = found
    if best.sum() >= need and (h := _fit(model, a[best], b[best])) is not None:
        best = max(best, _inliers(h, a, b, within), key=lambda x: x.sum())
    return int(best.sum())


def verified(matches: DataFrame, by: list[str], model: str = "homography", within: float = 2.0, rounds: int = 200) -> DataFrame:
    """(by, n_matches, inliers) of matches (by, ax, ay, bx, by_): a group is one pair's matches."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ax", "ay", "bx", "by_"])
        n = ransac(pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by_"]].to_numpy(float), model, within, rounds)
        return pdf[by].head(1).assign(n_matches=len(pdf), inliers=n)

    return matches.groupBy(*by).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in by) + ", n_matches long, inliers long")
