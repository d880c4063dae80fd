"""Random sets of mutually nondominated points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import kernels

#: Names of the shapes.
SHAPES = {"simplex": "simplex", "linear": "simplex", "L": "simplex", "concave-sphere": "sphere", "sphere": "sphere", "C": "sphere", "convex-sphere": "1-sphere", "X": "1-sphere", "convex-simplex": "simplex2", "inverted-simplex": "1-simplex", "inverted-linear": "1-simplex", "concave-simplex": "1-simplex2"}


def draw(n: int, d: int, shape: str, rng: np.random.Generator) -> np.ndarray:
    base = shape.removeprefix("1-")
    x = rng.exponential(size=(n, d)) if base.startswith("simplex") else np.abs(rng.normal(size=(n, d)))
    x = x / (x.sum(1, keepdims=True) if base.startswith("simplex") else np.linalg.norm(x, axis=1, keepdims=True))
    x = x**2 if base == "simplex2" else x
    return 1.0 - x if shape.startswith("1-") else x


def nondominated_array(n: int, d: int, method: str, seed: int | None = None, integer: bool = False) -> np.ndarray:
    """``n`` points; drawn again until none dominates another, and doubled until whole numbers keep that."""
    if method not in SHAPES:
        raise ValueError(f"unknown method {method!r}")
    rng = np.random.default_rng(seed)
    while len(kernels.skyline(x := draw(n, d, SHAPES[method], rng))) < n:
        pass
    if not integer:
        return x
    scale = 64
    while len(kernels.skyline(y := (x * scale).astype(np.int64).astype(float))) < n:
        scale *= 2
    return y.astype(np.int64)


def generate_ndset(spark: SparkSession, n: int, d: int, method: str, seed: int | None = None, integer: bool = False) -> DataFrame:
    """A set of ``n`` nondominated points as columns f1 .. fd: doubles, or longs if ``integer``."""
    x = nondominated_array(n, d, method, seed, integer)
    return spark.createDataFrame(x.tolist(), ", ".join(f"f{i + 1} {'long' if integer else 'double'}" for i in range(d)))
