"""Vector expressions and the blocked cosine kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, item: total + item,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double; 0 where a norm is 0; different lengths are an error."""
    scale = norm(left) * norm(right)
    checked = F.when(
        F.size(left) != F.size(right), F.raise_error(F.lit("vectors differ in length"))
    )
    return F.coalesce(
        checked.cast("double"),
        F.when(scale == 0, F.lit(0.0)).otherwise(_dot(left, right) / (norm(left) * norm(right))),
    )


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(lengths == 0, 1.0, lengths)[:, None]


def best_rows(
    block: np.ndarray, query: np.ndarray, approximate: np.ndarray, threshold: float, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the best ``k`` rows; equal scores keep row order.

    ``approximate`` comes from a matrix product whose last bits depend on the position in the
    block, so all rows near the cut are scored again the same way each before the final order."""
    slack = 1e-9
    near = approximate >= threshold - slack
    if k < len(approximate):
        near &= approximate >= np.partition(approximate, -k)[-k] - slack
    rows = np.flatnonzero(near)
    exact = cosine_rows(block[rows], query)
    keep = exact >= threshold
    rows, exact = rows[keep], exact[keep]
    order = np.argsort(-exact, kind="stable")[:k]
    return rows[order], exact[order]


def cosine_rows(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    dots = (rows * query).sum(axis=1)
    scale = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return np.divide(dots, scale, out=np.zeros_like(dots), where=scale != 0)
