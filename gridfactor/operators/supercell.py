"""Supercells of k-meshes: translation vectors, phases, and transforms of k-point matrices."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import conj, pair, phase, times
from . import lanczos, tiles
from .matrix import local
from .order import ranged, with_place
from .solve import generalized_eigh
from .tiles import Tiled


def translation_vectors(spark: SparkSession, mesh: tuple[int, int, int], lattice: DataFrame) -> DataFrame:
    """(r, x, y, z): all combinations of cell indices times lattice(axis, x, y, z)."""
    rows = spark.range(math.prod(mesh)).select(F.col("id").alias("r"))
    steps = [math.prod(mesh[a + 1 :]) for a in range(3)]
    cells = None
    for axis, (n, step) in enumerate(zip(mesh, steps)):
        part = rows.select("r", F.lit(axis).alias("axis"), F.pmod(F.floor(F.col("r") / step), F.lit(n)).alias("n"))
        cells = part if cells is None else cells.unionByName(part)
    return cells.join(lattice, "axis").groupBy("r").agg(*[F.sum(F.col("n") * F.col(a)).alias(a) for a in ("x", "y", "z")])


def phases(vectors: DataFrame, kpoints: DataFrame, n_cells: int) -> DataFrame:
    """(r, k, re, im): exp(i R k) / sqrt(n_cells)."""
    k = kpoints.select("k", F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("z").alias("kz"))
    re, im = phase(F.col("x") * F.col("kx") + F.col("y") * F.col("ky") + F.col("z") * F.col("kz"), math.sqrt(n_cells))
    return vectors.crossJoin(F.broadcast(k)).select("r", "k", re.alias("re"), im.alias("im"))  # a mesh has as many k-points as cells


def translation_map(cells: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """(i, j, t): the translation (j - i) mod n between cells."""
    return cells.crossJoin(F.broadcast(other)).select("i", "j", F.pmod(F.col("j") - F.col("i"), F.lit(n)).alias("t"))


def to_supercell(matrices: DataFrame, phase_table: DataFrame) -> DataFrame:
    """matrices(k, p, q, re, im): sum over k of phase[r, k] A_k[p, q] conj(phase[s, k]): (r, p, s, q, re, im)."""
    left = phase_table.select("r", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    right = phase_table.select(F.col("r").alias("s"), F.col("k").alias("k2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    both = left.join(right, F.col("k") == F.col("k2")).drop("k2")
    re, im = times(times(pair("ar", "ai"), conj(pair("br", "bi"))), pair("re", "im"))
    return matrices.join(both, "k").groupBy("r", "p", "s", "q").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def orbitals_to_supercell(coefficients: DataFrame, phase_table: DataFrame) -> DataFrame:
    """coefficients(k, p, m, e, re, im): (r, p, k, m, e, re, im) with each cell's phase; order them by e, k, m for the energy order."""
    re, im = times(pair("pr", "pi"), pair("re", "im"))
    rows = coefficients.join(phase_table.select("r", "k", F.col("re").alias("pr"), F.col("im").alias("pi")), "k")
    return rows.select("r", "p", "k", "m", "e", re.alias("re"), im.alias("im"))


def orbital_order(orbitals: DataFrame, per_part: int = 1 << 20) -> DataFrame:
    """(k, m, e, j): the place of each orbital in the order of energies, k-points and numbers, of all k-points together."""
    return level_order(orbitals.select("k", "m", "e").distinct(), per_part)


def level_order(levels: DataFrame, per_part: int = 1 << 20) -> DataFrame:
    """The same of levels(k, m, e), a place for each row, also for repeated ones."""
    keys = ["e", "k", "m"]
    return with_place(ranged(levels, keys, per_part), keys, "j").select("k", "m", "e", "j")


def orthonormality(c: Tiled, overlap: Tiled) -> DataFrame:
    """(worst): the largest modulus of C^H S C - 1, by tiles; tiles of the overlap that aren't there are zeros."""
    half = tiles.product(overlap, c, sparse=True).stored()
    rest = tiles.mapped(tiles.completed(tiles.product(c, half, "C", "N"), True), lambda x, i, j: x - np.eye(*x.shape) if i == j else x)
    return tiles.to_entries(rest, True).agg(F.max(F.hypot("re", "im")).alias("worst"))


def gamma_orbitals(orbitals: DataFrame, overlap: np.ndarray, n_ao: int, threshold: float = 1e-3, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Real supercell orbitals from orbitals_to_supercell(): energies in order, and coefficients (ao, orbital).

    Orbitals are ordered by energy, k-point and number.  Those that stand apart from both neighbours are real
    up to a phase, which is turned away; groups of near-degenerate ones are rotated so that they are real,
    by diagonalizing the energy in the space of their real and imaginary parts.  If an orbital that stands
    apart isn't real up to `tolerance`, all orbitals are taken as one group.  overlap is real (ao, ao); all
    coefficients are n_ao x n_ao at most, which the driver's bound on matrices limits.
    """
    places = orbital_order(orbitals)
    order = places.orderBy("j").toPandas()  # a row per orbital
    n, cells = len(order), orbitals.agg((F.max("r") + 1).alias("n")).first().n or 1
    entries = orbitals.drop("e").join(places, ["k", "m"]).select((F.col("r") * (n_ao // cells) + F.col("p")).alias("i"), "j", "re", "im")
    c = local(entries, n_ao, n)
    e = order.e.to_numpy(dtype=np.float64, copy=True)
    groups = np.split(np.arange(n), np.flatnonzero(np.diff(e) >= threshold) + 1) if n else []
    turned = {g[0]: _turned(c[:, g[0]]) for g in groups if len(g) == 1}
    if any(abs(x.imag).max() > tolerance for x in turned.values()):
        groups = [np.arange(n)]
    out = np.zeros((n_ao, n))
    for g in groups:
        if len(g) == 1:
            out[:, g[0]] = turned[g[0]].real
            continue
        block = c[:, g]
        density, energy = block @ block.conj().T, (block * e[g]) @ block.conj().T
        if max(abs(density.imag).max(), abs(energy.imag).max()) > tolerance:
            raise ValueError(f"levels {g[0]} to {g[-1]} can't be made real: the group lacks the partner of one of its orbitals")
        # inside the group's space: eigenvectors of the density that belong to it, then of the energy
        _, v = generalized_eigh(-overlap @ density.real @ overlap, overlap)
        v = v[:, : len(g)]
        e[g], u = np.linalg.eigh(v.T @ overlap @ energy.real @ overlap @ v)
        out[:, g] = v @ u
    return e, out


def lowest_gamma_orbitals(orbitals: DataFrame, overlap: Tiled, n_ao: int, count: int, tolerance: float = 1e-4, **options) -> lanczos.Lowest:
    """The `count` lowest real supercell orbitals from orbitals_to_supercell(), where neither matrix fits the driver.

    The energy operator S C (E - top) C^H S is made by tiles and has to be real up to `tolerance`: all orbitals together,
    so that partners needn't be found.  What orbitals don't span has energy 0 there, above all levels, since top is
    above the highest one.  `options` are lowest_orbitals()'.
    """
    bounds = orbitals.agg(F.min("e").alias("low"), F.max("e").alias("high"), (F.max("r") + 1).alias("cells")).first()
    if bounds.low is None:
        raise ValueError("there are no orbitals")
    top = bounds.high + max(1.0, 0.1 * (bounds.high - bounds.low))
    at = orbitals.join(orbital_order(orbitals), ["k", "m", "e"]).withColumn("i", F.col("r") * (n_ao // bounds.cells) + F.col("p"))
    n = at.agg((F.max("j") + 1).alias("n")).first().n
    if count > n:
        raise ValueError(f"{count} orbitals of {n}")
    forms = [at.select("i", "j", *[(F.col(c) * by).alias(c) for c in ("re", "im")]) for by in (F.lit(1.0), F.col("e") - top)]
    half, weighted = (tiles.product(overlap, tiles.from_entries(f, n_ao, n, overlap.size)).stored() for f in forms)
    energy = tiles.product(weighted, half, "N", "C", hermitian=True).stored()
    worst = tiles.to_entries(energy, True).agg(F.max(F.abs("im"))).first()[0] or 0.0
    if worst > tolerance:
        raise ValueError(f"the orbitals can't be made real: the energy operator has imaginary parts up to {worst:.3g}")
    found = lanczos.lowest_orbitals(tiles.mapped(energy, lambda x, i, j: x.real), overlap, count, **options)
    return replace(found, energies=found.energies + top)


def _turned(x: np.ndarray) -> np.ndarray:
    return x * np.exp(-1j * np.angle(x[abs(x).argmax()]))


def k_to_gamma(orbitals: DataFrame, phase_table: DataFrame, overlaps: DataFrame, gamma: DataFrame) -> DataFrame:
    """How k-point orbitals make up gamma-point orbitals: (k, i, j, re, im) = sum conj(C_k[u, i]) S_k[u, v] conj(phase[r, k]) C_gamma[rv, j].

    orbitals(k, p, m, re, im) and overlaps(k, p, q, re, im) are of the unit cell; gamma(r, q, j, v) is real, of the cells' basis functions.
    Both products that reach the last join are grouped sums: no row is made for each pair of a k-point and an entry of the overlap of cells.
    """
    left = orbitals.select("k", "p", F.col("m").alias("i"), F.col("re").alias("cr"), F.col("im").alias("ci"))
    re, im = times(conj(pair("cr", "ci")), pair("re", "im"))
    half = left.join(overlaps, ["k", "p"]).groupBy("k", "i", "q").agg(F.sum(re).alias("hr"), F.sum(im).alias("hi"))
    folded = phase_table.join(gamma, "r").groupBy("k", "q", "j").agg(F.sum(F.col("re") * F.col("v")).alias("gr"), F.sum(-F.col("im") * F.col("v")).alias("gi"))
    re, im = times(pair("hr", "hi"), pair("gr", "gi"))
    return half.join(folded, ["k", "q"]).groupBy("k", "i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def gamma_of_spins(orbitals: DataFrame, occupations: DataFrame, phase_table: DataFrame, overlap: np.ndarray, n_ao: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(energies, coefficients, occupations) of one or two spins: one if restricted, else spin up and down.

    orbitals(spin, k, p, m, e, re, im), occupations(spin, k, m, occ); spins are 0, or 0 and 1.  Occupations follow the energies' order.
    """
    spins = [r.spin for r in orbitals.select("spin").distinct().orderBy("spin").limit(3).collect()]
    if spins not in ([0], [0, 1]):
        raise ValueError(f"spins are 0, or 0 and 1, but not {spins}")
    out = []
    for spin in spins:
        mine = orbitals.where(F.col("spin") == spin).drop("spin")
        e, c = gamma_orbitals(orbitals_to_supercell(mine, phase_table), overlap, n_ao)
        order = mine.select("k", "m", "e").distinct().join(occupations.where(F.col("spin") == spin), ["k", "m"]).orderBy("e", "k", "m")
        out.append((e, c, order.select("occ").toPandas().occ.to_numpy()))
    return out


def rotated_to(a: Tiled, c: Tiled) -> Tiled:
    """C^T A C of a supercell matrix and real orbitals, by tiles."""
    return tiles.product(c, tiles.product(a, c).stored(), "T")


def in_one_basis(matrix: DataFrame, n_ao: int) -> DataFrame:
    """to_supercell()'s rows as entries (i, j, re, im), i and j being cell * n_ao + basis function."""
    return matrix.select((F.col("r") * n_ao + F.col("p")).alias("i"), (F.col("s") * n_ao + F.col("q")).alias("j"), "re", "im")
