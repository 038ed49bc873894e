"""Interpolative separable density fitting of periodic orbitals.

Orbitals are row-arrays phi(g, re, im).  Points are chosen first; then every pass over the grid is a map
with the orbitals at the points (points x orbitals) in the tasks, or a grouped transform.  Matrices of points by
points are tiles: the fit's pseudo-inverse, the interaction and its lower factor are never whole in one place.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import dense_complex, lists
from ..functions.storage import stored
from ..operators import tiles
from ..operators.fourier import fft_rows
from ..operators.jacobi import pseudo_inverse
from ..operators.matrix import LOCAL_ENTRIES
from ..operators.tiles import SIZE, Tiled


def rows_at(phi: DataFrame, points: list[int]) -> np.ndarray:
    """The rows at some points, in their order: points x orbitals, which LOCAL_ENTRIES bounds."""
    much = F.raise_error(F.lit(f"{len(points)} points are more than the driver holds")).cast("array<double>")
    fits = lambda c: F.when(F.size(c) * len(points) <= LOCAL_ENTRIES, F.col(c)).otherwise(much).alias(c)
    t = phi.where(F.col("g").isin(sorted(set(points)))).select("g", fits("re"), fits("im")).toArrow()
    place = {g: k for k, g in enumerate(t["g"].to_pylist())}
    missing = sorted(set(points) - set(place))
    if missing:
        raise ValueError(f"the grid has no points {missing[:10]}")
    return dense_complex(t)[[place[g] for g in points]]


def _mapped(phi: DataFrame, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = f(dense_complex(batch))
                yield pa.RecordBatch.from_arrays([batch["g"], lists(y.real), lists(y.imag)], ["g", "re", "im"])

    return phi.select("g", "re", "im").mapInArrow(run, "g long, re array<double>, im array<double>")


def pseudo_density(phi: DataFrame, at: np.ndarray) -> DataFrame:
    """P[u, g] = sum_i conj(phi_i(u)) phi_i(g), as arrays over u."""
    return _mapped(phi, lambda x: x @ at.conj().T)


def czt(phi: DataFrame, at: np.ndarray, occupied: int | None = None) -> DataFrame:
    """P P*, or with occupied P_occ P*: entry by entry, as arrays over the points."""
    o = at.shape[1] if occupied is None else occupied
    return _mapped(phi, lambda x: (x[:, :o] @ at[:, :o].conj().T) * (x @ at.conj().T).conj())


@dataclass
class Factors:
    points: list[int]
    orbitals: np.ndarray  # at the points
    rank: int
    vectors: DataFrame  # zeta(g, re, im), arrays over the points
    m: Tiled


def products_at(spark: SparkSession, at: np.ndarray, occupied: int | None = None, size: int = SIZE) -> Tiled:
    """CC^T, the products of orbitals at the points with each other: conj(A_occ A_occ^H) and A A^H entry by entry."""
    every = tiles.from_local(spark, at, size)
    some = every if occupied is None else tiles.from_local(spark, np.ascontiguousarray(at[:, :occupied]), size)
    square = lambda a: tiles.product(a, a, "N", "C", hermitian=True)
    return tiles.zipped(square(some), square(every), lambda x, y: x.conj() * y).stored()


def fit(phi: DataFrame, points: list[int], n_grid: int, occupied: int | None = None, size: int = SIZE) -> tuple[np.ndarray, int, DataFrame]:
    """Solve CC^T X = CZ^T for the vectors zeta = X^H, with least norm where CC^T has no full rank."""
    at = rows_at(phi, points)
    inverse, s = pseudo_inverse(products_at(phi.sparkSession, at, occupied, size), 1e-12)
    rank = int((s >= len(s) * s[0] * np.finfo(float).eps).sum())
    return at, rank, tiles.rows_times(czt(phi, at, occupied), n_grid, tiles.transposed(inverse.stored()), conjugate=True)


def contracted(zeta: DataFrame, kernel: DataFrame, n_grid: int, n: int, size: int = SIZE) -> Tiled:
    """sum_G v(G) conj(zeta_u(G)) zeta_v(G) of rows (g, re, im) and kernel(g, v).

    By tiles, so that no task holds a sum of all u and v; if these are one tile, by tasks' sums.
    """
    if n <= size:
        return tiles.sums_of_rows(_weighted(zeta, kernel, "w"), n, n, lambda b: (x := dense_complex(b)).conj().T @ (x * b["w"].to_numpy()[:, None]), size).stored()
    zeta = stored(zeta)
    by_tiles = lambda rows: tiles.from_rows(rows, n_grid, n, size=size)
    return tiles.product(by_tiles(zeta), by_tiles(_weighted(zeta, kernel)), "C", "N", hermitian=True)


def contracted_halves(both: DataFrame, kernel: DataFrame, n_grid: int, n: int, size: int = SIZE) -> Tiled:
    """sum_G v(G) left_u(G) right_v(G), of rows that hold the left functions and then as many right ones."""
    if n <= size:
        return tiles.sums_of_rows(_weighted(both, kernel, "w"), n, n, lambda b: (x := dense_complex(b))[:, :n].T @ (x[:, n:] * b["w"].to_numpy()[:, None]), size).stored()
    both = stored(both)
    half = lambda rows, first: tiles.from_rows(rows.select("g", *[F.slice(c, first, n).alias(c) for c in ("re", "im")]), n_grid, n, size=size)
    return tiles.product(half(both, 1), half(_weighted(both, kernel), n + 1), "T", "N").stored()


def _weighted(rows: DataFrame, kernel: DataFrame, name: str | None = None) -> DataFrame:
    """Rows times the kernel, or with it in a column."""
    if name:
        return rows.select("g", "re", "im").join(kernel.select("g", F.col("v").alias(name)), "g")
    times = lambda c: F.transform(c, lambda x: x * F.col("v")).alias(c)
    return rows.join(kernel.select("g", "v"), "g").select("g", times("re"), times("im"))


def both_directions(zeta: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The backward transform of each function and then the forward ones, by one pass: the backward transform is the conjugate of the conjugate's forward one."""
    doubled = _mapped(zeta, lambda x: np.concatenate([x.conj(), x], 1))
    return _mapped(fft_rows(doubled, shape), lambda x: np.concatenate([x[:, : x.shape[1] // 2].conj(), x[:, x.shape[1] // 2 :]], 1))


def interaction(zeta: DataFrame, n: int, shape: tuple[int, int, int], kernel: DataFrame, half: bool, size: int = SIZE) -> Tiled:
    """Of n vectors zeta(g, re, im): sum_G v conj(zeta_u) zeta_v with forward transforms, or if half, backward_u times forward_v without conjugation."""
    n_grid = math.prod(shape)
    return contracted_halves(both_directions(zeta, shape), kernel, n_grid, n, size) if half else contracted(fft_rows(zeta, shape), kernel, n_grid, n, size)


def factorize(phi: DataFrame, points: list[int], shape: tuple[int, int, int], kernel: DataFrame, occupied: int | None = None, size: int = SIZE) -> Factors:
    """The interaction between fitted vectors: full, or half-rotated with the first `occupied` orbitals on the left.

    Fewer independent products than points are no error, since the fit has the least norm, but a warning.
    """
    points = sorted(points)
    at, r, zeta = fit(phi, points, math.prod(shape), occupied, size)
    if r < len(points):
        warnings.warn(f"the products at {len(points)} points have rank {r}: fewer points would do", stacklevel=2)
    return Factors(points, at, r, zeta, interaction(zeta, len(points), shape, kernel, occupied is not None, size))


def luv(m: Tiled) -> Tiled:
    """The lower factor of a full interaction matrix, panel by panel; tiles above the diagonal are there, as zeros."""
    even = tiles.zipped(m, tiles.transposed(m, hermitian=True), lambda x, y: (x + y) / 2)
    return tiles.completed(tiles.cholesky(even), complex_=True).stored()
