"""Driver queries over the given tables, and DuckDB SQL with the same results.

Relations: X(i, j, v) = the vectors of `embeddings`; phi(i, j, re, im) = pairs of their values as complex
orbitals at points i; grid = their first three values; weights = sums of squares; Q(i, j, v) = quantities
of `lineitem` by supplier and part.  The points' number grows with the table; orbitals and chosen points
don't.  Chosen points are the operator's own sample (its size is the feature).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce as reduce_

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import multi_index, rounded
from .functions.storage import new_folder, stored
from .operators import fourier, jacobi, lanczos, matrix, order, points, reduce, supercell, tall, tiles
from .plans import isdf, job, molecular
from .sources.catalog import Catalog
from .sources.config import JobConfig

CHOSEN, SEED, STEPS = 16, 5, 40
OCC = 8


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def x(s: SparkSession, d: str) -> DataFrame:
    return matrix.from_arrays(_table(s, d, "embeddings"), "vec_id", "embedding")


def phi(s: SparkSession, d: str) -> DataFrame:
    return matrix.complex_from_arrays(_table(s, d, "embeddings"), "vec_id", "embedding")


def phi_rows(s: SparkSession, d: str) -> DataFrame:
    return matrix.complex_rows(_table(s, d, "embeddings"), "vec_id", "embedding")


def grid(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "embeddings").select(F.col("vec_id").alias("g"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def weights(s: SparkSession, d: str) -> DataFrame:
    return reduce.density_of_rows(phi_rows(s, d))


def q(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def chosen(s: SparkSession, d: str) -> DataFrame:
    return reduce.sampled(grid(s, d), CHOSEN, SEED)


def chosen_list(s: SparkSession, d: str) -> list[int]:
    return [r.g for r in chosen(s, d).orderBy("g").collect()]


def centroids(s: SparkSession, d: str) -> DataFrame:
    at = reduce.offsets(chosen(s, d).withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), "g", "one", ["all"])
    return grid(s, d).join(at.select("g", F.col("start").alias("c")), "g").select("c", "x", "y", "z")


def shape(s: SparkSession, d: str) -> tuple[int, int, int]:
    return fourier.near_cubic(_table(s, d, "embeddings").count())


def kernel(s: SparkSession, d: str) -> DataFrame:
    """1 / (1 + |f|^2) with the wrapped frequencies f of each point."""
    n = shape(s, d)
    f2 = F.lit(1.0)
    for k, m in zip(multi_index(F.col("g"), n), n):
        f = F.least(k, F.lit(m) - k)
        f2 = f2 + f * f
    return grid(s, d).select("g", (1.0 / f2).alias("v"))


def out(a: DataFrame, places: int = 6) -> DataFrame:
    """Values rounded, indices as longs."""
    kinds = dict(a.dtypes)
    return a.select(*[(rounded(F.col(c), places) if kinds[c] == "double" else F.col(c).cast("bigint") if kinds[c] in ("int", "bigint") else F.col(c)).alias(c) for c in a.columns])


def long(a: DataFrame, name: str) -> DataFrame:
    """Row-arrays (g, re, im) as entries (name, g, re, im)."""
    return a.select("g", F.posexplode(F.arrays_zip("re", "im")).alias(name, "z")).select(name, "g", "z.re", "z.im")


def small(s: SparkSession, d: str) -> DataFrame:
    """A 64 x 64 matrix: the mean outer product of the vectors."""
    n = _table(s, d, "embeddings").count()
    return matrix.scaled(matrix.gram_of_rows(_table(s, d, "embeddings"), "embedding"), F.lit(1.0 / max(1, n)))


def small_complex(s: SparkSession, d: str) -> DataFrame:
    n = _table(s, d, "embeddings").count()
    return matrix.scaled(matrix.gram_of_complex_rows(phi_rows(s, d)), F.lit(1.0 / max(1, n)))


def zeta(s: SparkSession, d: str, occupied: int | None = None) -> DataFrame:
    """Unfitted vectors: CZ^T rows of the chosen points."""
    return isdf.czt(phi_rows(s, d), isdf.rows_at(phi_rows(s, d), chosen_list(s, d)), occupied)


def muv(s: SparkSession, d: str, occupied: int | None = None) -> tiles.Tiled:
    return isdf.interaction(zeta(s, d, occupied), CHOSEN, shape(s, d), kernel(s, d), occupied is not None)


def three_steps(s: SparkSession, d: str) -> DataFrame:
    rows, c = grid(s, d).join(weights(s, d), "g"), centroids(s, d)
    for _ in range(3):
        c = points.step(rows, c)
    return c


def lstsq(s: SparkSession, d: str) -> DataFrame:
    p, n, at = phi_rows(s, d), n_vectors(s, d), isdf.rows_at(phi_rows(s, d), chosen_list(s, d))
    cct = isdf.products_at(s, at)
    inverse = jacobi.pseudo_inverse(cct)[0].stored()
    fitted = tiles.rows_times(isdf.czt(p, at), n, tiles.transposed(inverse))
    return long(tiles.rows_times(fitted, n, tiles.transposed(cct)), "u")


def lstsq_lines(s: SparkSession, d: str) -> DataFrame:
    """Prices, discounts and taxes of all lineitem rows by a constant and the quantity: (k, constant, slope, residual)."""
    rows = _table(s, d, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity").cast("double")).alias("a"), F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100).cast("array<double>").alias("b"))
    fit = tall.least_squares(rows, "a", "b")
    return s.createDataFrame([(k, *map(float, fit.x[:, k]), float(fit.residuals[k])) for k in range(3)], "k long, constant double, slope double, residual double")


def svd_x(s: SparkSession, d: str) -> jacobi.Tall:
    return jacobi.svd_of_rows(_table(s, d, "embeddings"), "vec_id", "embedding", width=32)


def svd_reconstruct(s: SparkSession, d: str) -> DataFrame:
    """U diag(s) V^T."""
    found = svd_x(s, d)
    return matrix.from_arrays(tall.times(found.u, "g", "v", (found.v * found.s).T), "g", "v")


def moments(s: SparkSession, values: np.ndarray) -> DataFrame:
    """The sums of the singular values' second, fourth and sixth powers."""
    return out(s.createDataFrame([tuple(float((values**k).sum()) for k in (2, 4, 6))], "second double, fourth double, sixth double"), 4)


def phi_named(s: SparkSession, d: str) -> DataFrame:
    return phi_rows(s, d).select("g", F.col("re").alias("p_re"), F.col("im").alias("p_im"))


def nations_rank(s: SparkSession, d: str) -> DataFrame:
    """The rank of customers by flags of their nation and its region: as many as nations have customers."""
    c, n = _table(s, d, "customer"), _table(s, d, "nation")
    flag = lambda c, m: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: (k == F.col(c)).cast("double"))
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.concat(flag("n_nationkey", 25), flag("n_regionkey", 5)).alias("a"))
    r = tall.triangle(rows, "a")
    values = jacobi.right_vectors(s, r, 8)[0]
    return s.createDataFrame([(int((values > 1e-12 * values[0]).sum()), len(values))], "rank long, flags long")


def x_tiles(s: SparkSession, d: str, size: int = 128) -> tiles.Tiled:
    return tiles.from_rows(_table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), n_vectors(s, d), 64, "vec_id", "embedding", None, size)


def xxt(s: SparkSession, d: str) -> tiles.Tiled:
    """The products of all vectors with each other."""
    x_ = x_tiles(s, d).stored()
    return tiles.product(x_, x_, "N", "T", hermitian=True)


def cholesky_of_points(s: SparkSession, d: str) -> DataFrame:
    """L L^T of the products of all vectors, with 1 added on the diagonal."""
    shifted = tiles.mapped(xxt(s, d), lambda v, bi, bj: v + np.eye(len(v)) if bi == bj else v)
    low = tiles.cholesky(shifted)
    return tiles.to_entries(tiles.product(low, low, "N", "T", hermitian=True), False)


def cholesky_of(a: DataFrame, n: int, complex_: bool) -> DataFrame:
    """L L^H of an n x n matrix's factor, in tiles of 16."""
    low = tiles.cholesky(tiles.from_entries(a, n, n, 16))
    return tiles.to_entries(tiles.product(low, low, "N", "C", hermitian=True), complex_)


def pinv_identity(s: SparkSession, d: str) -> DataFrame:
    a = tiles.from_entries(molecular.metric_of_orbitals(_table(s, d, "embeddings"), "embedding"), 64, 64, 32).stored()
    inverse = jacobi.pseudo_inverse(a)[0]
    return tiles.to_entries(tiles.product(tiles.product(a, inverse), a), False)


def df_of_lines(s: SparkSession, d: str) -> DataFrame:
    """df(l, i, k, v): mean quantities of lineitem by line number and pairs of places from its part and supplier."""
    place = lambda c: F.pmod(F.col(c), F.lit(64))
    rows = _table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("l"), place("l_partkey").alias("i"), place("l_suppkey").alias("k"))
    return rows.agg((F.sum("l_quantity") / 1000).alias("v"))


def fitted_integrals(s: SparkSession, d: str) -> np.ndarray:
    """df_of_lines as an array (auxiliary, places, places)."""
    flat = df_of_lines(s, d).select((F.col("l") - 1).alias("i"), (F.col("i") * 64 + F.col("k")).alias("j"), "v")
    return matrix.local(flat, 7, 64 * 64).reshape(7, 64, 64)


def b_of_vectors(s: SparkSession, d: str) -> DataFrame:
    """B[l, u]: the vectors are points u, numbered from 0 without gaps in the table, and their places orbitals."""
    return molecular.fit_b_rows(fitted_integrals(s, d), _table(s, d, "embeddings"), "vec_id", "embedding")


def molecular_smsb(s: SparkSession, d: str) -> DataFrame:
    """S M S of the factorized integrals of all vectors as points, which is B^T B."""
    eta = x_tiles(s, d, 256).stored()
    factor, _ = molecular.factorize_orbitals(eta, b_of_vectors(s, d), 7)
    half = molecular.times_metric(factor, eta).stored()  # M is D^T D, so S M S is (D S)^T D S
    return tiles.to_entries(tiles.product(half, half, "T", "N", hermitian=True), False)


def k_points(s: SparkSession, d: str) -> DataFrame:
    """A k-point for each nation: thirds of its customers' and suppliers' numbers and of its key."""
    n = _table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    count = lambda t, c: _table(s, d, t).groupBy(F.col(c).cast("bigint").alias("k")).agg(F.count("*").alias("n"))
    rows = n.join(count("customer", "c_nationkey").withColumnRenamed("n", "a"), "k", "left").join(count("supplier", "s_nationkey").withColumnRenamed("n", "b"), "k", "left")
    third = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(3)) / 3.0
    return rows.select("k", third(F.col("a")).alias("x"), third(F.col("b")).alias("y"), third(F.col("k")).alias("z"))


def cells(s: SparkSession, d: str) -> DataFrame:
    """Translation vectors of a 5 x 5 x 1 mesh; the lattice vectors are means of the grid's squares."""
    g = grid(s, d)
    mean = g.agg(*[F.avg(F.col(a) * F.col(a)).alias(a) for a in "xyz"])
    axes = s.range(3).select(F.col("id").cast("int").alias("axis"))
    lattice = axes.crossJoin(F.broadcast(mean)).select("axis", *[F.when(F.col("axis") == k, F.lit(1.0) + F.col(a)).otherwise(F.lit(0.0)).alias(a) for k, a in enumerate("xyz")])
    return supercell.translation_vectors(s, (5, 5, 1), lattice)


def phase_table(s: SparkSession, d: str) -> DataFrame:
    return supercell.phases(cells(s, d), k_points(s, d), 25)


def k_matrices(s: SparkSession, d: str) -> DataFrame:
    """(k, p, q, re, im): for each nation, totals of its customers' orders by priority class and status."""
    c, o = _table(s, d, "customer"), _table(s, d, "orders")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy(F.col("c_nationkey").cast("bigint").alias("k"), F.ascii(F.substring("o_orderpriority", 1, 1)).alias("p"), F.ascii("o_orderstatus").alias("q"))
    return rows.agg((F.sum("o_totalprice") / 1e6).alias("re"), (F.count("*") / 1e3).alias("im"))


def levels(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select(F.col("p_partkey").alias("m"), F.col("p_size").cast("bigint").alias("k"), F.col("p_retailprice").alias("e"))


def running_quantities(s: SparkSession, d: str) -> DataFrame:
    """Quantities of all lineitem rows before each, in the order of prices, orders and lines."""
    keys = ["e", "o", "l", "p"]
    rows = _table(s, d, "lineitem").select(F.col("l_extendedprice").alias("e"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("l"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("bigint").alias("n"))
    return order.with_place(order.with_running(order.ranged(rows, keys, 4096), keys, F.col("n")), keys).select("o", "l", "p", "n", "start", "place")


def prime_axis(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The points' densities f(i, g, re, im) on one axis of a prime length, with zeros after them."""
    n = n_vectors(s, d)
    p = next(k for k in range(max(2, n), 2 * n + 3) if all(k % m for m in range(2, int(k**0.5) + 1)))
    rows = s.range(p).select(F.col("id").alias("g")).join(weights(s, d), "g", "left")
    return rows.select(F.lit(0).cast("bigint").alias("i"), "g", F.coalesce("w", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")), p


def dft_prime(s: SparkSession, d: str, backward: bool = False) -> DataFrame:
    f, p = prime_axis(s, d)
    return fourier.dft(f, (p, 1, 1), backward).select("g", "re", "im")


def fft_prime(s: SparkSession, d: str) -> DataFrame:
    """The same by lines of 64 points at most."""
    f, p = prime_axis(s, d)
    return fourier.fft_rows(f.select("g", F.array("re").alias("re"), F.array("im").alias("im")), (p, 1, 1), backward=True, most=64).select("g", F.col("re")[0].alias("re"), F.col("im")[0].alias("im"))


def orthonormality(s: SparkSession, d: str) -> DataFrame:
    """How far the orbitals are from being orthonormal, with the kernel as a diagonal overlap."""
    n = n_vectors(s, d)
    overlap = tiles.from_entries(kernel(s, d).select(F.col("g").alias("i"), F.col("g").alias("j"), "v"), n, n, 64)
    return out(supercell.orthonormality(tiles.from_rows(phi_rows(s, d), n, 32, size=64), overlap))


def orbital_order(s: SparkSession, d: str) -> DataFrame:
    """The order of parts by price, size and number, as if sizes were k-points."""
    return out(supercell.level_order(levels(s, d), 512))


def metric_half(s: SparkSession, d: str) -> DataFrame:
    """The first OCC places of the vectors are occupied, the others virtual."""
    rows, n = _table(s, d, "embeddings"), n_vectors(s, d)
    part = lambda a, m: tiles.from_rows(rows.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), a, m).alias("v")), n, m, "vec_id", "v", None, 128).stored()
    return out(tiles.to_entries(molecular.metric_half(part(1, OCC), part(OCC + 1, 64 - OCC)), False))


def k_to_gamma(s: SparkSession, d: str) -> DataFrame:
    """Orbitals of nations by priority and segment, in terms of orbitals of all nations by status and segment."""
    sales = _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    at = {n: e.cast("long").alias(n) for n, e in {"k": F.col("c_nationkey"), "r": F.col("c_nationkey"), "p": F.ascii("o_orderpriority"), "q": F.ascii("o_orderstatus"), "m": F.ascii("c_mktsegment"), "j": F.ascii("c_mktsegment")}.items()}
    price = F.sum("o_totalprice") / 1e7
    orbitals = sales.groupBy(at["k"], at["p"], at["m"]).agg(price.alias("re"), (F.count("*") / 1e4).alias("im"))
    gamma = sales.groupBy(at["r"], at["q"], at["j"]).agg(price.alias("v"))
    return out(supercell.k_to_gamma(orbitals, phase_table(s, d), k_matrices(s, d), gamma), 4)


def supercell_rotated(s: SparkSession, d: str) -> DataFrame:
    """Matrices of nations by priority and segment as one of 25 cells of five functions, rotated to months."""
    sales = _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    p, q = F.ascii("o_orderpriority") - 49, F.instr(F.lit("ABFHM"), F.substring("c_mktsegment", 1, 1)) - 1
    k, price = F.col("c_nationkey").cast("long"), F.sum("o_totalprice") / 1e7
    matrices = sales.groupBy(k.alias("k"), p.cast("long").alias("p"), q.cast("long").alias("q")).agg(price.alias("re"), (F.count("*") / 1e4).alias("im"))
    c = sales.groupBy((k * 5 + p).cast("long").alias("i"), (F.month("o_orderdate") - 1).cast("long").alias("j")).agg(price.alias("v"))
    a = supercell.in_one_basis(supercell.to_supercell(matrices, phase_table(s, d)), 5)
    turned = supercell.rotated_to(tiles.from_entries(a, 125, 125, 64), tiles.from_entries(c, 125, 12, 64))
    return out(tiles.to_entries(tiles.completed(turned, True), True), 4)


def prepared_densities(s: SparkSession, d: str) -> DataFrame:
    """(g, full, occupied): densities of orbitals that a rotation by the mean outer product makes."""
    c = matrix.local(small_complex(s, d), 32, 32)
    _, full, occ = job.prepare_orbitals(phi_rows(s, d), c, OCC)
    return out(full.withColumnRenamed("w", "total").join(occ.withColumnRenamed("w", "occupied"), "g"))


def molecular_written(s: SparkSession, d: str) -> DataFrame:
    """(name, i, j, v) of what a molecular run with given fitted vectors writes, besides the factors."""
    source, target = (Catalog(s, new_folder(s)) for _ in range(2))
    n = n_vectors(s, d)
    c = small(s, d)
    source.save("etaPm", x(s, d), (n, 64))
    source.save("BxL", b_of_vectors(s, d), (7, n))
    for name in ("hcore", "mo_coeff"):
        source.save(name, c, (64, 64))
    source.save("nelec", matrix.from_local(s, np.array([[5.0, 3.0]])), (1, 2))
    source.save("enuc", matrix.from_local(s, np.array([[1.5, 0.0]])), (1, 2))
    molecular.run_molecular(source, target, density_fitting=False)
    names = ("Hamiltonian/hcore", "Hamiltonian/Energies", "Hamiltonian/dims", "Hamiltonian/THC/dims", "Hamiltonian/THC/Orbitals", "Hamiltonian/THC/HalfTransformedOccOrbitals")
    return out(reduce_(DataFrame.unionByName, [target.load(m).select(F.lit(m.removeprefix("Hamiltonian/")).alias("name"), "i", "j", F.col("v").cast("double").alias("v")) for m in names]))


def class_weights(s: SparkSession, d: str) -> DataFrame:
    """(c, w, weightless): after a step of k-means, the weight of each class and whether it has none to speak of."""
    return points.step(grid(s, d).join(weights(s, d), "g"), centroids(s, d)).select("c", rounded(F.col("w")).alias("w"), (F.col("w") < 1e-8).alias("weightless"))


def zero_matrix(s: SparkSession, d: str) -> DataFrame:
    """Zeros in the shape of the vectors, and their sum with these."""
    both = matrix.zeros(s, n_vectors(s, d), 64).join(x(s, d).withColumnRenamed("v", "w"), ["i", "j"], "left")
    return out(both.select("i", "j", (F.col("v") + F.col("w")).alias("v"), F.col("v").alias("zero")))


def pivot_first(s: SparkSession, d: str) -> DataFrame:
    g, r = points.pivots(phi_rows(s, d), phi_rows(s, d), 1)[0]
    return s.createDataFrame([(g, r)], "g long, r double").select("g", rounded(F.col("r")).alias("r"))


def shifted_rows(s: SparkSession, d: str) -> DataFrame:
    """Each vector and the same with its places moved by one, the last to the front."""
    moved = F.concat(F.slice("embedding", -1, 1), F.slice("embedding", 1, 63))
    return _table(s, d, "embeddings").select("embedding", moved.alias("shifted"))


def asymmetry(s: SparkSession, d: str) -> DataFrame:
    """z: what the entries of X^T X / n differ by from its transpose's."""
    a = small(s, d)
    return a.join(matrix.transpose(a).withColumnRenamed("v", "w"), ["i", "j"]).select((F.col("v") - F.col("w")).alias("z"))


def ordered_quantities(s: SparkSession, d: str) -> DataFrame:
    """(i, j, v long): numbers of lineitem rows by line number and key modulo 8."""
    return _table(s, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("bigint").alias("i"), F.pmod("l_partkey", F.lit(8)).cast("bigint").alias("j")).agg(F.count("*").alias("v"))


def both_vectors(s: SparkSession, d: str) -> DataFrame:
    """v and its neighbour's value w: X beside X with places moved by one."""
    moved = x(s, d).select("i", F.pmod(F.col("j") + 1, F.lit(64)).alias("j"), F.col("v").alias("w"))
    return x(s, d).join(moved, ["i", "j"])


def kmeans_points(s: SparkSession, d: str) -> DataFrame:
    found = points.kmeans(grid(s, d), weights(s, d), CHOSEN, 1e-9, STEPS, SEED)
    return s.createDataFrame(list(enumerate(found)), "pos long, g long")


def pivot_points(s: SparkSession, d: str) -> DataFrame:
    found = points.pivots(phi_rows(s, d), phi_rows(s, d), CHOSEN, block=6)
    return out(s.createDataFrame([(k, g, r) for k, (g, r) in enumerate(found)], "step long, g long, r double"))


def pivot_points_sketch(s: SparkSession, d: str) -> DataFrame:
    """Pivots by sketches of 8 at a time."""
    found = points.pivots_by_sketch(phi_rows(s, d), phi_rows(s, d), CHOSEN, block=8, seed=SEED)
    return out(s.createDataFrame([(k, g, r) for k, (g, r) in enumerate(found)], "step long, g long, r double"))


def pivot_points_half(s: SparkSession, d: str) -> DataFrame:
    left = phi_rows(s, d).select("g", F.slice("re", 1, OCC).alias("re"), F.slice("im", 1, OCC).alias("im"))
    found = points.pivots(left, phi_rows(s, d), CHOSEN)
    return out(s.createDataFrame([(k, g, r) for k, (g, r) in enumerate(found)], "step long, g long, r double"))


def isdf_m(s: SparkSession, d: str, occupied: int | None = None) -> DataFrame:
    """C M C^H of a factorization's M, C the products at the points: the interaction of the unfitted vectors.

    A half-rotated M belongs to conjugated vectors: conj(C) M conj(C)^T.
    """
    f = isdf.factorize(phi_rows(s, d), chosen_list(s, d), shape(s, d), kernel(s, d), occupied)
    c = isdf.products_at(s, f.orbitals, occupied)
    if occupied is not None:
        c = tiles.mapped(c, lambda v, bi, bj: v.conj())
    return tiles.to_entries(tiles.product(tiles.product(c, f.m), c, "N", "C" if occupied is None else "T"), True)


def luv_reconstruct(s: SparkSession, d: str) -> DataFrame:
    """L L^H of the lower factor of the full interaction of the unfitted vectors."""
    low = isdf.luv(muv(s, d))
    return tiles.to_entries(tiles.product(low, low, "N", "C", hermitian=True), True)


def saved(s: SparkSession, a: DataFrame, size: tuple[int, int], rows: tuple[int, int] | None = None, write_transposed: bool = False, transposed: bool = False) -> DataFrame:
    """A matrix after a round trip through a catalog."""
    c = Catalog(s, new_folder(s))
    c.save("group/name", a, size, transposed=write_transposed)
    if c.shape("group/name") != (size[::-1] if write_transposed else size):
        raise ValueError("the catalog has another shape")
    return out(c.load("group/name", rows, transposed))


def customer_levels(s: SparkSession, d: str) -> DataFrame:
    """(i, u, e, w) of each customer: a reflection's vector, an energy that is lower for a lower balance, and a norm."""
    c = _table(s, d, "customer")
    energy = -F.exp(-(F.col("c_acctbal").cast("double") + 1000) / 500)
    rows = order.with_place(order.ranged(c.select("c_custkey", (F.col("c_nationkey") + 1.0).alias("u"), energy.alias("e"), (1 + F.col("c_nationkey") / 50).alias("w")), ["c_custkey"]), ["c_custkey"], "i")
    return rows.select("i", "u", "e", "w")


def reflected(rows: DataFrame, value: str, n: int, size: int) -> lanczos.Updated:
    """Q D Q for the diagonal D of a column and the reflection Q = 1 - 2 u u^T / u^T u, as a diagonal and a product of two tall matrices."""
    sums = rows.agg(F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("u") * F.col("u") * F.col(value)).alias("udu")).first()
    b = 2 / sums.uu
    # D - b (u (Du)^T + (Du) u^T) + b^2 (u^T D u) u u^T = D + [u, Du] [b^2 u^T D u u - b Du, -b u]^T
    left = (F.col("u"), F.col("u") * F.col(value))
    right = (b * b * sums.udu * left[0] - b * left[1], -b * left[0])
    tall_of = lambda columns: tiles.from_rows(rows.select("i", F.array(*columns).alias("v")), n, 2, "i", "v", None, size)
    diagonal = tiles.from_entries(rows.select("i", F.col("i").alias("j"), F.col(value).alias("v")), n, n, size)
    return lanczos.Updated(diagonal, tall_of(left), tall_of(right))


def lowest_levels(s: SparkSession, d: str, count: int = 8) -> DataFrame:
    """The lowest energies of (Q E Q) c = e (Q W Q) c, which are those of E / W."""
    rows = stored(customer_levels(s, d))
    n = rows.count()
    found = lanczos.lowest_orbitals(reflected(rows, "e", n, 256), reflected(rows, "w", n, 256), count, width=32)
    return s.createDataFrame([(j, float(e)) for j, e in enumerate(found.energies)], "j long, e double")


def n_vectors(s: SparkSession, d: str) -> int:
    return _table(s, d, "embeddings").count()


def job_through_catalog(s: SparkSession, d: str) -> Catalog:
    """A whole half-rotated run of a point for each of the 32 orbitals, from a written input and a JSON configuration."""
    source, target = (Catalog(s, new_folder(s)) for _ in range(2))
    job.write_input(source, grid(s, d), shape(s, d), kernel(s, d), phi_rows(s, d), np.eye(32), np.diag(np.arange(1.0, 33.0)), (OCC // 2, 1), -1.25)
    text = {"orbital_file": source.root, "output_file": target.root, "thc_cfac": 1, "half_rotated": True, "interpolating_points": {"qrcp": {}}}
    job.run_config(s, JobConfig.from_json(json.dumps(text)))
    return target


def job_run(s: SparkSession, d: str) -> DataFrame:
    """The points' indices and the sizes that a run wrote: (name, i, v)."""
    c = job_through_catalog(s, d)
    rows = [c.load(f"Hamiltonian/{name}").select(F.lit(name).alias("name"), "i", "v") for name in ("dims", "THC/dims", "occups", "THC/InterpIndx", "THC/HalfTransformedOccInterpIndx")]
    return reduce_(DataFrame.unionByName, rows)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "metric_s": lambda s, d: out(molecular.metric_of_orbitals(_table(s, d, "embeddings"), "embedding")),
    "gram_rows": lambda s, d: out(matrix.gram_of_rows(_table(s, d, "embeddings"), "embedding")),
    "matmul_nn": lambda s, d: out(matrix.product(x(s, d), small(s, d))),
    "matmul_tn": lambda s, d: out(matrix.gram_of_rows(shifted_rows(s, d), "embedding", "shifted")),
    "matmul_nt": lambda s, d: out(matrix.product(x(s, d), small(s, d), "N", "T")),
    "matmul_tt": lambda s, d: out(matrix.product(small(s, d), x(s, d), "T", "T")),
    "sparse_matvec": lambda s, d: out(matrix.product(q(s, d), _table(s, d, "part").select(F.col("p_partkey").alias("i"), F.lit(0).cast("bigint").alias("j"), F.col("p_retailprice").alias("v")))),
    "cmatmul_nn": lambda s, d: out(matrix.product(phi(s, d), small_complex(s, d))),
    "cmatmul_cn": lambda s, d: out(matrix.gram_of_complex_rows(phi_rows(s, d))),
    "cmatmul_tn": lambda s, d: out(matrix.product(small_complex(s, d), small_complex(s, d), "T")),
    "cmatmul_nc": lambda s, d: out(matrix.product(phi(s, d), small_complex(s, d), "N", "C")),
    "cmatmul_nt": lambda s, d: out(matrix.product(phi(s, d), small_complex(s, d), "N", "T")),
    "herk_lower": lambda s, d: out(matrix.gram_of_complex_rows(phi_rows(s, d), triangle=True)),
    "transpose_real": lambda s, d: out(matrix.transpose(q(s, d))),
    "transpose_hermitian": lambda s, d: out(matrix.transpose(phi(s, d), hermitian=True)),
    "hadamard_self": lambda s, d: out(matrix.squared(phi(s, d))),
    "hadamard_pair": lambda s, d: out(matrix.hadamard(phi(s, d), phi(s, d), conjugate_b=True)),
    "add_const": lambda s, d: out(matrix.add_constant(x(s, d), 2.5)),
    "zero_fill": lambda s, d: out(matrix.zeroed(x(s, d))),
    "to_complex": lambda s, d: out(matrix.to_complex(q(s, d))),
    "triangle_mask": lambda s, d: out(matrix.lower(small(s, d))),
    "scale_by_kernel": lambda s, d: out(matrix.scaled(phi(s, d).join(kernel(s, d).select(F.col("g").alias("i"), F.col("v").alias("kernel")), "i"), F.sqrt("kernel")).select("i", "j", "re", "im")),
    "gather_columns": lambda s, d: out(matrix.gathered_columns(matrix.transpose(x(s, d)), chosen(s, d))),
    "gather_with_order": lambda s, d: out(matrix.gathered_in_order(matrix.transpose(x(s, d)), chosen(s, d).select((F.lit(100000) - F.col("g")).alias("pos"), "g"))),
    "rank_one_products": lambda s, d: out(matrix.column_products(matrix.transpose(x(s, d))), 9),
    "orbital_pairs": lambda s, d: out(matrix.orbital_pairs(phi(s, d), phi(s, d)), 9),
    "orbital_pairs_half": lambda s, d: out(matrix.orbital_pairs(phi(s, d).where(F.col("j") < OCC), phi(s, d)), 9),
    "density_full": lambda s, d: out(weights(s, d)),
    "density_occ": lambda s, d: out(reduce.density_of_rows(phi_rows(s, d), OCC)),
    "vector_sum": lambda s, d: out(q(s, d).agg(F.sum("v").alias("total"))),
    "minmax": lambda s, d: out(q(s, d).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), reduce.argmin("j", F.col("v")).alias("at_lo"), reduce.argmax("j", F.col("v")).alias("at_hi"))),
    "norm_diff": lambda s, d: out(reduce.normed_difference(both_vectors(s, d), "v", "w")),
    "is_zero": lambda s, d: reduce.all_zero(asymmetry(s, d), "z", 1e-9),
    "pct_change": lambda s, d: out(reduce.percent_changed(points.classify(grid(s, d), centroids(s, d)).join(points.classify(grid(s, d), points.update(grid(s, d), points.classify(grid(s, d), centroids(s, d)), weights(s, d))).withColumnRenamed("c", "c2"), "g"), "c", "c2")),
    "hermiticity": lambda s, d: out(reduce.hermiticity(small_complex(s, d))),
    "axis_counts": lambda s, d: out(reduce.axis_counts(k_points(s, d), ["x", "y", "z"])),
    "dup_check": lambda s, d: out(reduce.duplicates(_table(s, d, "lineitem").select(F.col("l_partkey").alias("g")))),
    "prefix_offsets": lambda s, d: out(reduce.offsets(_table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n")), "l_linenumber", "n", ["l_suppkey"])),
    "near_degenerate": lambda s, d: reduce.near_degenerate(levels(s, d), "e", ["m"], 0.5, ["k"]).select("m", "k", rounded(F.col("e")).alias("e"), "degenerate"),
    "energy_order": lambda s, d: out(levels(s, d).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.asc_nulls_last("e"), F.asc_nulls_last("m"))) - 1)),
    "sample_points": lambda s, d: out(chosen(s, d)),
    "kmeans_classify": lambda s, d: out(points.classify(grid(s, d), centroids(s, d))),
    "kmeans_update": lambda s, d: out(points.update(grid(s, d), points.classify(grid(s, d), centroids(s, d)), weights(s, d))),
    "kmeans_3steps": lambda s, d: out(three_steps(s, d)),
    "kmeans_snap": lambda s, d: out(points.snap(grid(s, d), points.update(grid(s, d), points.classify(grid(s, d), centroids(s, d)), weights(s, d)))),
    "kmeans_points": kmeans_points,
    "pivot_first": pivot_first,
    "pivot_points": pivot_points,
    "pseudo_dm": lambda s, d: out(long(isdf.pseudo_density(phi_rows(s, d), isdf.rows_at(phi_rows(s, d), chosen_list(s, d))), "u")),
    "czt_full": lambda s, d: out(long(zeta(s, d), "u")),
    "czt_half": lambda s, d: out(long(zeta(s, d, OCC), "u")),
    "cct": lambda s, d: out(long(zeta(s, d).join(chosen(s, d), "g"), "u")),
    "dft_forward": lambda s, d: out(fourier.dft(weights(s, d).select(F.lit(0).cast("bigint").alias("i"), "g", F.col("w").alias("re"), F.lit(0.0).alias("im")), shape(s, d)).select("g", "re", "im")),
    "dft_backward": lambda s, d: out(fourier.dft(phi(s, d).select(F.col("j").alias("i"), F.col("i").alias("g"), "re", "im"), shape(s, d), backward=True)),
    "fft_rows": lambda s, d: out(long(fourier.fft_rows(phi_rows(s, d), shape(s, d)), "i")),
    "m_full": lambda s, d: out(tiles.to_entries(muv(s, d), True), 4),
    "m_half": lambda s, d: out(tiles.to_entries(muv(s, d, OCC), True), 4),
    "lstsq_reconstruct": lambda s, d: out(lstsq(s, d), 4),
    "cholesky_reconstruct": lambda s, d: out(cholesky_of(small(s, d), 64, False)),
    "svd_reconstruct": lambda s, d: out(svd_reconstruct(s, d)),
    "svd_energy": lambda s, d: moments(s, svd_x(s, d).s),
    "pinv_identity": lambda s, d: out(pinv_identity(s, d)),
    "fit_b": lambda s, d: out(b_of_vectors(s, d), 4),
    "mo_rotate": lambda s, d: out(molecular.rotated(matrix.lower(small(s, d)), small(s, d))),
    "mo_orbitals": lambda s, d: out(molecular.rotated_orbitals(x(s, d).select(F.col("i").alias("u"), F.col("j").alias("i"), "v"), small(s, d))),
    "translation_vectors": lambda s, d: out(cells(s, d)),
    "translation_map": lambda s, d: out(supercell.translation_map(_table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i")), _table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("j")), 25)),
    "supercell_phase": lambda s, d: out(phase_table(s, d)),
    "supercell_matrix": lambda s, d: out(supercell.to_supercell(k_matrices(s, d), phase_table(s, d)), 4),
    "isdf_full": lambda s, d: out(isdf_m(s, d), 4),
    "isdf_half": lambda s, d: out(isdf_m(s, d, OCC), 4),
    "molecular_full": lambda s, d: out(molecular_smsb(s, d), 2),
    "pivot_points_half": pivot_points_half,
    "pivot_points_sketch": pivot_points_sketch,
    "luv_reconstruct": lambda s, d: out(luv_reconstruct(s, d), 4),
    "ccholesky_reconstruct": lambda s, d: out(cholesky_of(small_complex(s, d), 32, True)),
    "csvd_energy": lambda s, d: moments(s, jacobi.right_vectors(s, tall.triangle(phi_named(s, d), "p", complex_=True), 16)[0]),
    "catalog_real": lambda s, d: saved(s, x(s, d), (n_vectors(s, d), 64)),
    "catalog_complex": lambda s, d: saved(s, phi(s, d), (n_vectors(s, d), 32)),
    "catalog_integers": lambda s, d: saved(s, ordered_quantities(s, d), (8, 8)),
    "catalog_rows": lambda s, d: saved(s, x(s, d), (n_vectors(s, d), 64), rows=(10, 100)),
    "catalog_write_transposed": lambda s, d: saved(s, x(s, d), (n_vectors(s, d), 64), write_transposed=True),
    "catalog_load_transposed": lambda s, d: saved(s, x(s, d), (n_vectors(s, d), 64), transposed=True),
    "masked_columns": lambda s, d: out(matrix.masked_columns(matrix.transpose(x(s, d)), grid(s, d).select(F.col("g").alias("j"), F.signum("x").cast("int").alias("flag")))),
    "numeric_names": lambda s, d: matrix.by_numeric_name(_table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("name")), "name"),
    "job_run": job_run,
    "global_order": lambda s, d: order.near_degenerate(levels(s, d), "e", ["m"], 0.005, 512).select("m", "k", rounded(F.col("e")).alias("e"), "place", "degenerate"),
    "running_quantities": running_quantities,
    "dft_prime": lambda s, d: out(dft_prime(s, d)),
    "fft_prime": lambda s, d: out(fft_prime(s, d)),
    "orthonormality": orthonormality,
    "orbital_order": orbital_order,
    "metric_half": metric_half,
    "prepared_densities": prepared_densities,
    "supercell_rotated": supercell_rotated,
    "k_to_gamma": k_to_gamma,
    "molecular_written": molecular_written,
    "class_weights": class_weights,
    "zero_matrix": zero_matrix,
    "lowest_orbitals": lambda s, d: out(lowest_levels(s, d)),
    "tiles_xxt": lambda s, d: out(tiles.to_entries(xxt(s, d), False)),
    "tiles_aha": lambda s, d: out(tiles.to_entries(tiles.gram(tiles.from_rows(phi_rows(s, d), n_vectors(s, d), 32, size=16)), True)),
    "cholesky_points": lambda s, d: out(cholesky_of_points(s, d)),
    "lstsq_lines": lambda s, d: out(lstsq_lines(s, d), 4),
    "nations_rank": nations_rank,
}

# ---------------------------------------------------------------- the same in DuckDB SQL
_X = "x AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(unnest(range(0, 64)) AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_PHI = _X + ", phi AS (SELECT i, j // 2 AS j, sum(v) FILTER (j % 2 = 0) AS re, sum(v) FILTER (j % 2 = 1) AS im FROM x GROUP BY 1, 2)"
_SMALL = _X + ", small AS (SELECT a.j AS i, b.j, sum(a.v * b.v) / (SELECT count(*) FROM embeddings) AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2)"
_SMALLC = _PHI + ", sc AS (SELECT a.j AS i, b.j, sum(a.re * b.re + a.im * b.im) / (SELECT count(*) FROM embeddings) AS re, sum(a.re * b.im - a.im * b.re) / (SELECT count(*) FROM embeddings) AS im FROM phi a JOIN phi b ON a.i = b.i GROUP BY 1, 2)"
_GRID = _PHI + ", grid AS (SELECT CAST(vec_id AS BIGINT) AS g, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), w AS (SELECT i AS g, sum(re * re + im * im) AS w FROM phi GROUP BY 1)"
_CHOSEN = _GRID + f", chosen AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS pos FROM (SELECT g FROM grid ORDER BY (g * 7919 + {SEED}) % 100003, g LIMIT {CHOSEN}))"
_C0 = _CHOSEN + ", c0 AS (SELECT pos AS c, x, y, z FROM grid JOIN chosen USING (g))"
_SHAPE = (
    ", sh0 AS (SELECT count(*) AS n FROM embeddings), sh1 AS (SELECT n, max(k) AS c FROM sh0, (SELECT unnest(range(1, 2000)) AS k) WHERE k * k * k <= n AND n % k = 0 GROUP BY n)"
    ", sh AS (SELECT n // (c * max(k)) AS a, max(k) AS b, c FROM sh1, (SELECT unnest(range(1, 20000)) AS k) WHERE k * k <= n // c AND (n // c) % k = 0 GROUP BY n, c)"
    ", gk AS (SELECT g, g // (sh.b * sh.c) AS p, (g // sh.c) % sh.b AS q, g % sh.c AS r, sh.a, sh.b, sh.c FROM grid, sh), kernel AS (SELECT g, 1.0e0 / (1.0e0 + least(p, a - p) ** 2 + least(q, b - q) ** 2 + least(r, c - r) ** 2) AS v FROM gk)"
)


def _class(k: int) -> str:
    return f", k{k} AS (SELECT g, c FROM (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY d, c) AS r FROM (SELECT p.g, q.c, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM grid p, c{k} q)) WHERE r = 1)"


def _step(k: int) -> str:
    return _class(k) + f", c{k + 1} AS (SELECT c, sum(w) AS w, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z FROM grid JOIN k{k} USING (g) JOIN w USING (g) GROUP BY c)"


def _r(c: str, places: int = 6) -> str:
    return f"round({c}, {places}) + 0.0e0 AS {c}"


_P = ", pts AS (SELECT pos AS u, j, re, im FROM phi JOIN chosen ON i = g), p AS (SELECT u, i AS g, sum(pts.re * phi.re + pts.im * phi.im) AS re, sum(pts.re * phi.im - pts.im * phi.re) AS im, sum(CASE WHEN phi.j < %d THEN pts.re * phi.re + pts.im * phi.im END) AS ore, sum(CASE WHEN phi.j < %d THEN pts.re * phi.im - pts.im * phi.re END) AS oim FROM pts JOIN phi USING (j) GROUP BY 1, 2)" % (OCC, OCC)
_CZT = _CHOSEN + _P + ", full_ AS (SELECT u, g, re * re + im * im AS re, 0.0e0 AS im FROM p), half_ AS (SELECT u, g, ore * re + oim * im AS re, oim * re - ore * im AS im FROM p)"


def _dft(src: str, name: str, sign: str, row: str) -> str:
    out_, cur = "", src
    axes = (("a", "g // (sh.b * sh.c)", "g % (sh.b * sh.c)", "sh.b * sh.c"), ("b", "(g // sh.c) % sh.b", "g - sh.c * ((g // sh.c) % sh.b)", "sh.c"), ("c", "g % sh.c", "g - g % sh.c", "1"))
    for axis, (n, at, rest, step) in enumerate(axes):
        angle = f"{sign} 2 * pi() * ((r.k * s.p) % s.n) / s.n"
        nxt = f"{name}{axis}"
        out_ += f", {nxt} AS (SELECT s.{row}, s.rest + r.k * s.step AS g, sum(s.re * cos({angle}) - s.im * sin({angle})) AS re, sum(s.re * sin({angle}) + s.im * cos({angle})) AS im FROM (SELECT {row}, re, im, {at} AS p, {rest} AS rest, sh.{n} AS n, {step} AS step FROM {cur}, sh) s, (SELECT unnest(range(0, (SELECT {n} FROM sh))) AS k) r GROUP BY 1, 2)"
        cur = nxt
    return out_


def _prime(sign: str) -> str:
    p = "p AS (SELECT min(k) AS n FROM (SELECT unnest(range(greatest(2, (SELECT count(*) FROM w)), 2 * (SELECT count(*) FROM w) + 3)) AS k) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 2000)) AS m) d WHERE m * m <= k AND k % m = 0))"
    angle = f"{sign} 2 * pi() * ((w.g * k) % p.n) / p.n"
    return f"WITH {_GRID}, {p} SELECT k AS g, round(sum(w * cos({angle})), 6) + 0.0e0 AS re, round(sum(w * sin({angle})), 6) + 0.0e0 AS im FROM w, p, (SELECT unnest(range(0, (SELECT n FROM p))) AS k) t GROUP BY 1"


def _pivots(steps: int, occupied: int) -> str:
    """Pivoted Cholesky, unrolled: after each step, the residuals d and the entries of all columns so far (real and imaginary parts).

    The kernel is the product of the Gram kernels of the first `occupied` orbitals, conjugated, and of all.
    """
    sql = f", o AS (SELECT i AS g, sum(re * re + im * im) AS w FROM phi WHERE j < {occupied} GROUP BY 1), s0 AS (SELECT g, w.w * o.w AS d FROM w JOIN o USING (g))"
    for k in range(steps):
        sql += f", p{k} AS (SELECT * FROM s{k} ORDER BY d DESC, g LIMIT 1)"
        ab = "sum(a.re * b.re + a.im * b.im)", "sum(a.im * b.re - a.re * b.im)"  # x(g) conj(x(p))
        some = [f"{x} FILTER (a.j < {occupied})" for x in ab]
        sql += f", k{k} AS (SELECT a.i AS g, {some[0]} AS xr, {some[1]} AS xi, {ab[0]} AS yr, -({ab[1]}) AS yi FROM phi a JOIN (SELECT phi.* FROM phi JOIN p{k} ON i = g) b ON a.j = b.j GROUP BY 1)"
        re = " - ".join(["(q.xr * q.yr - q.xi * q.yi)", *[f"(s.r{m} * p.r{m} + s.i{m} * p.i{m})" for m in range(k)]])
        im = " - ".join(["(q.xr * q.yi + q.xi * q.yr)", *[f"(s.i{m} * p.r{m} - s.r{m} * p.i{m})" for m in range(k)]])
        old = "".join(f", s.r{m}, s.i{m}" for m in range(k))
        keep = "".join(f", r{m}, i{m}" for m in range(k + 1))
        sql += f", t{k} AS (SELECT s.g, s.d, p.g AS pg, ({re}) / sqrt(p.d) AS r{k}, ({im}) / sqrt(p.d) AS i{k}{old} FROM s{k} s JOIN k{k} q USING (g), p{k} p)"
        sql += f", s{k + 1} AS (SELECT g, CASE WHEN g = pg THEN -1e0 ELSE d - r{k} * r{k} - i{k} * i{k} END AS d{keep} FROM t{k})"
    return sql


def _pivot_sql(occupied: int) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step, g, round(sqrt(d), 6) + 0.0e0 AS r FROM p{k}" for k in range(CHOSEN))
    return f"WITH {_GRID}{_pivots(CHOSEN, occupied)} {rows}"


def _job_sql() -> str:
    """Pivots of all orbitals, in ascending order, and the sizes."""
    rows = " UNION ALL ".join(f"SELECT g FROM p{k}" for k in range(32))
    sizes = {"dims": (-1, 0, 0, 32, OCC // 2, 1, 0, 0), "THC/dims": (32, 32, 32), "occups": (0,) * (OCC // 2 + 1)}
    values = ", ".join(f"('{name}', CAST({k} AS BIGINT), CAST({v} AS BIGINT))" for name, vs in sizes.items() for k, v in enumerate(vs))
    names = "(VALUES ('THC/InterpIndx'), ('THC/HalfTransformedOccInterpIndx')) n(name)"
    return f"WITH {_GRID}{_pivots(32, 32)} SELECT name, row_number() OVER (PARTITION BY name ORDER BY g) - 1 AS i, g AS v FROM ({rows}), {names} UNION ALL SELECT * FROM (VALUES {values}) t(name, i, v)"


_Q = "q AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_BOTH = _X + ", b AS (SELECT a.i, a.j, a.v, c.v AS w FROM x a JOIN x c ON a.i = c.i AND a.j = (c.j + 1) % 64)"
_K = "kp AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (coalesce(a.n, 0) % 3) / 3.0e0 AS x, (coalesce(b.n, 0) % 3) / 3.0e0 AS y, (n_nationkey % 3) / 3.0e0 AS z FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) a ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON s_nationkey = n_nationkey)"
_CELLS = _GRID + ", m AS (SELECT 1.0e0 + avg(x * x) AS x, 1.0e0 + avg(y * y) AS y FROM grid), cells AS (SELECT r, (r // 5) * m.x AS x, (r % 5) * m.y AS y, 0.0e0 AS z FROM (SELECT unnest(range(0, 25)) AS r) t, m)"
_PHASE = _CELLS + ", " + _K + ", ph AS (SELECT r, k, cos(c.x * kp.x + c.y * kp.y + c.z * kp.z) / 5.0e0 AS re, sin(c.x * kp.x + c.y * kp.y + c.z * kp.z) / 5.0e0 AS im FROM cells c, kp)"
_COMPLEX = f"{_r('re')}, {_r('im')}"
_LEVELS = "l AS (SELECT p_partkey AS m, CAST(p_size AS BIGINT) AS k, p_retailprice AS e FROM part)"
_GRAM = f"WITH {_X} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2"

_M_FULL = "SELECT a.u AS i, b.u AS j, round(sum(v * (a.re * b.re + a.im * b.im)), 4) + 0.0e0 AS re, round(sum(v * (a.re * b.im - a.im * b.re)), 4) + 0.0e0 AS im FROM t2 a JOIN t2 b USING (g) JOIN kernel USING (g) GROUP BY 1, 2"
_B = "df AS (SELECT CAST(l_linenumber AS BIGINT) AS l, l_partkey % 64 AS i, l_suppkey % 64 AS k, sum(l_quantity) / 1000 AS v FROM lineitem GROUP BY 1, 2, 3), h AS (SELECT l, a.i AS u, df.k, sum(df.v * a.v) AS v FROM df JOIN x a ON df.i = a.j GROUP BY 1, 2, 3), bm AS (SELECT l - 1 AS l, u, sum(h.v * b.v) AS v FROM h JOIN x b ON h.u = b.i AND h.k = b.j GROUP BY 1, 2)"

ORACLE_SQL: dict[str, str] = {
    "metric_s": f"WITH {_X} SELECT a.j AS i, b.j, round(sum(a.v * b.v) * sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2",
    "gram_rows": _GRAM,
    "matmul_tn": f"WITH {_X} SELECT a.j AS i, (b.j + 1) % 64 AS j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2",
    "matmul_nn": f"WITH {_SMALL} SELECT a.i, b.j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN small b ON a.j = b.i GROUP BY 1, 2",
    "matmul_nt": f"WITH {_SMALL} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN small b ON a.j = b.j GROUP BY 1, 2",
    "matmul_tt": f"WITH {_SMALL} SELECT b.j AS i, a.i AS j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN small b ON a.j = b.i GROUP BY 1, 2",
    "sparse_matvec": f"WITH {_Q} SELECT i, CAST(0 AS BIGINT) AS j, round(sum(v * p_retailprice), 6) + 0.0e0 AS v FROM q JOIN part ON j = p_partkey GROUP BY 1",
    "cmatmul_nn": f"WITH {_SMALLC} SELECT a.i, b.j, round(sum(a.re * b.re - a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im + a.im * b.re), 6) + 0.0e0 AS im FROM phi a JOIN sc b ON a.j = b.i GROUP BY 1, 2",
    "cmatmul_cn": f"WITH {_PHI} SELECT a.j AS i, b.j, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im - a.im * b.re), 6) + 0.0e0 AS im FROM phi a JOIN phi b ON a.i = b.i GROUP BY 1, 2",
    "herk_lower": f"WITH {_PHI} SELECT a.j AS i, b.j, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im - a.im * b.re), 6) + 0.0e0 AS im FROM phi a JOIN phi b ON a.i = b.i AND a.j >= b.j GROUP BY 1, 2",
    "transpose_real": f"WITH {_Q} SELECT j AS i, i AS j, {_r('v')} FROM q",
    "transpose_hermitian": f"WITH {_PHI} SELECT j AS i, i AS j, {_r('re')}, round(-im, 6) + 0.0e0 AS im FROM phi",
    "hadamard_self": f"WITH {_PHI} SELECT i, j, round(re * re - im * im, 6) + 0.0e0 AS re, round(2 * re * im, 6) + 0.0e0 AS im FROM phi",
    "hadamard_pair": f"WITH {_PHI} SELECT i, j, round(re * re + im * im, 6) + 0.0e0 AS re, 0.0e0 AS im FROM phi",
    "add_const": f"WITH {_X} SELECT i, j, round(v + 2.5e0, 6) + 0.0e0 AS v FROM x",
    "zero_fill": f"WITH {_X} SELECT i, j, 0.0e0 AS v FROM x",
    "to_complex": f"WITH {_Q} SELECT i, j, round(v, 6) + 0.0e0 AS re, 0.0e0 AS im FROM q",
    "triangle_mask": f"WITH {_SMALL} SELECT i, j, round(CASE WHEN j > i THEN 0.0e0 ELSE v END, 6) + 0.0e0 AS v FROM small",
    "scale_by_kernel": f"WITH {_GRID} {_SHAPE} SELECT i, j, round(re * sqrt(v), 6) + 0.0e0 AS re, round(im * sqrt(v), 6) + 0.0e0 AS im FROM phi JOIN kernel ON i = g",
    "gather_columns": f"WITH {_CHOSEN} SELECT x.j AS i, pos AS j, {_r('v')} FROM x JOIN chosen ON i = g",
    "gather_with_order": f"WITH {_CHOSEN} SELECT x.j AS i, 100000 - g AS j, {_r('v')} FROM x JOIN chosen ON i = g",
    "rank_one_products": f"WITH {_X} SELECT a.j AS i, b.j AS k, a.i AS l, round(a.v * b.v, 9) + 0.0e0 AS v FROM x a JOIN x b ON a.i = b.i",
    "orbital_pairs": f"WITH {_PHI} SELECT a.j AS i, b.j AS k, a.i AS g, round(a.re * b.re + a.im * b.im, 9) + 0.0e0 AS re, round(a.re * b.im - a.im * b.re, 9) + 0.0e0 AS im FROM phi a JOIN phi b ON a.i = b.i",
    "orbital_pairs_half": f"WITH {_PHI} SELECT a.j AS i, b.j AS k, a.i AS g, round(a.re * b.re + a.im * b.im, 9) + 0.0e0 AS re, round(a.re * b.im - a.im * b.re, 9) + 0.0e0 AS im FROM phi a JOIN phi b ON a.i = b.i WHERE a.j < {OCC}",
    "density_full": f"WITH {_GRID} SELECT g, {_r('w')} FROM w",
    "density_occ": f"WITH {_PHI} SELECT i AS g, round(sum(re * re + im * im), 6) + 0.0e0 AS w FROM phi WHERE j < {OCC} GROUP BY 1",
    "vector_sum": f"WITH {_Q} SELECT round(sum(v), 6) + 0.0e0 AS total FROM q",
    "minmax": f"WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v, j) AS a, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS b FROM q) SELECT i, round(min(v), 6) + 0.0e0 AS lo, round(max(v), 6) + 0.0e0 AS hi, max(j) FILTER (a = 1) AS at_lo, max(j) FILTER (b = 1) AS at_hi FROM r GROUP BY i",
    "norm_diff": f"WITH {_BOTH} SELECT round(sqrt(sum((v - w) * (v - w))), 6) + 0.0e0 AS norm FROM b",
    "is_zero": f"WITH {_SMALL} SELECT bool_and(abs(a.v - b.v) <= 1e-9) AS is_zero FROM small a JOIN small b ON a.i = b.j AND a.j = b.i",
    "pct_change": f"WITH {_C0}{_step(0)}{_class(1)} SELECT round(100.0e0 * count(*) FILTER (k0.c <> k1.c) / count(*), 6) + 0.0e0 AS percent FROM k0 JOIN k1 USING (g)",
    "hermiticity": f"WITH {_SMALLC} SELECT round(max(sqrt((a.re - b.re) * (a.re - b.re) + (a.im + b.im) * (a.im + b.im))), 6) + 0.0e0 AS worst FROM sc a JOIN sc b ON a.i = b.j AND a.j = b.i",
    "axis_counts": f"WITH {_K} SELECT count(DISTINCT round(x, 8)) AS x, count(DISTINCT round(y, 8)) AS y, count(DISTINCT round(z, 8)) AS z FROM kp",
    "dup_check": "SELECT l_partkey AS g, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "prefix_offsets": "SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, n, CAST(coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "near_degenerate": f"WITH {_LEVELS} SELECT m, k, {_r('e')}, coalesce(abs(lead(l.e) OVER w - l.e) < 0.5e0, false) OR coalesce(abs(lag(l.e) OVER w - l.e) < 0.5e0, false) AS degenerate FROM l WINDOW w AS (PARTITION BY k ORDER BY l.e, m)",
    "sample_points": f"WITH {_CHOSEN} SELECT g FROM chosen",
    "kmeans_classify": f"WITH {_C0}{_class(0)} SELECT g, c FROM k0",
    "kmeans_update": f"WITH {_C0}{_step(0)} SELECT c, {_r('w')}, {_r('x')}, {_r('y')}, {_r('z')} FROM c1",
    "kmeans_3steps": f"WITH {_C0}{_step(0)}{_step(1)}{_step(2)} SELECT c, {_r('w')}, {_r('x')}, {_r('y')}, {_r('z')} FROM c3",
    "kmeans_snap": f"WITH {_C0}{_step(0)} SELECT c, g FROM (SELECT c, g, row_number() OVER (PARTITION BY c ORDER BY d, g) AS r FROM (SELECT q.c, p.g, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM grid p, c1 q)) WHERE r = 1",
    "pivot_first": f"WITH {_GRID} SELECT g, {_r('w').replace(' AS w', ' AS r')} FROM w ORDER BY w.w DESC, g LIMIT 1",
    "pseudo_dm": f"WITH {_CHOSEN}{_P} SELECT u, g, {_COMPLEX} FROM p",
    "czt_full": f"WITH {_CZT} SELECT u, g, {_COMPLEX} FROM full_",
    "czt_half": f"WITH {_CZT} SELECT u, g, {_COMPLEX} FROM half_",
    "cct": f"WITH {_CZT} SELECT u, g, {_COMPLEX} FROM full_ JOIN chosen USING (g)",
    "dft_forward": f"WITH {_GRID}{_SHAPE}, f AS (SELECT 0 AS i, g, w AS re, 0.0e0 AS im FROM w){_dft('f', 't', '-', 'i')} SELECT g, {_COMPLEX} FROM t2",
    "dft_backward": f"WITH {_GRID}{_SHAPE}, f AS (SELECT j AS i, i AS g, re, im FROM phi){_dft('f', 't', '', 'i')} SELECT i, g, {_COMPLEX} FROM t2",
    "fft_rows": f"WITH {_GRID}{_SHAPE}, f AS (SELECT j AS i, i AS g, re, im FROM phi){_dft('f', 't', '-', 'i')} SELECT i, g, {_COMPLEX} FROM t2",
    "m_full": f"WITH {_CZT}{_SHAPE}{_dft('full_', 't', '-', 'u')} {_M_FULL}",
    "m_half": f"WITH {_CZT}{_SHAPE}{_dft('half_', 't', '-', 'u')}{_dft('half_', 's', '', 'u')} SELECT a.u AS i, b.u AS j, round(sum(v * (a.re * b.re - a.im * b.im)), 4) + 0.0e0 AS re, round(sum(v * (a.re * b.im + a.im * b.re)), 4) + 0.0e0 AS im FROM s2 a JOIN t2 b USING (g) JOIN kernel USING (g) GROUP BY 1, 2",
    "lstsq_reconstruct": f"WITH {_CZT} SELECT u, g, {_r('re', 4)}, {_r('im', 4)} FROM full_",
    "cholesky_reconstruct": f"WITH {_SMALL} SELECT i, j, {_r('v')} FROM small",
    "svd_reconstruct": f"WITH {_X} SELECT i, j, {_r('v')} FROM x",
    "pinv_identity": f"WITH {_X} SELECT a.j AS i, b.j, round(sum(a.v * b.v) * sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2",
    "svd_energy": f"WITH {_X}, g AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2) SELECT (SELECT round(sum(v), 4) FROM g WHERE i = j) + 0.0e0 AS second, (SELECT round(sum(v * v), 4) FROM g) + 0.0e0 AS fourth, (SELECT round(sum(a.v * b.v * c.v), 4) FROM g a JOIN g b ON a.j = b.i JOIN g c ON b.j = c.i AND c.j = a.i) + 0.0e0 AS sixth",
    "fit_b": f"WITH {_X}, {_B} SELECT l AS i, u AS j, {_r('v', 4)} FROM bm",
    "molecular_full": f"WITH {_X}, {_B} SELECT a.u AS i, b.u AS j, round(sum(a.v * b.v), 2) + 0.0e0 AS v FROM bm a JOIN bm b USING (l) GROUP BY 1, 2",
    "isdf_full": f"WITH {_CZT}{_SHAPE}{_dft('full_', 't', '-', 'u')} {_M_FULL}",
    "luv_reconstruct": f"WITH {_CZT}{_SHAPE}{_dft('full_', 't', '-', 'u')} {_M_FULL}",
    "isdf_half": f"WITH {_CZT}{_SHAPE}{_dft('half_', 't', '-', 'u')}{_dft('half_', 's', '', 'u')} SELECT b.u AS i, a.u AS j, round(sum(v * (a.re * b.re - a.im * b.im)), 4) + 0.0e0 AS re, round(-sum(v * (a.re * b.im + a.im * b.re)), 4) + 0.0e0 AS im FROM s2 a JOIN t2 b USING (g) JOIN kernel USING (g) GROUP BY 1, 2",
    "kmeans_points": f"WITH {_C0}{''.join(_step(k) for k in range(STEPS))}, near AS (SELECT c, g, row_number() OVER (PARTITION BY c ORDER BY d, g) AS r FROM (SELECT q.c, p.g, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM grid p, c{STEPS} q)) SELECT row_number() OVER (ORDER BY g) - 1 AS pos, g FROM near WHERE r = 1",
    "pivot_points": _pivot_sql(32),
    "pivot_points_half": _pivot_sql(OCC),
    "job_run": _job_sql(),
    "cmatmul_tn": f"WITH {_SMALLC} SELECT a.j AS i, b.j, round(sum(a.re * b.re - a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im + a.im * b.re), 6) + 0.0e0 AS im FROM sc a JOIN sc b ON a.i = b.i GROUP BY 1, 2",
    "cmatmul_nc": f"WITH {_SMALLC} SELECT a.i, b.i AS j, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.im * b.re - a.re * b.im), 6) + 0.0e0 AS im FROM phi a JOIN sc b ON a.j = b.j GROUP BY 1, 2",
    "cmatmul_nt": f"WITH {_SMALLC} SELECT a.i, b.i AS j, round(sum(a.re * b.re - a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im + a.im * b.re), 6) + 0.0e0 AS im FROM phi a JOIN sc b ON a.j = b.j GROUP BY 1, 2",
    "ccholesky_reconstruct": f"WITH {_SMALLC} SELECT i, j, {_COMPLEX} FROM sc",
    "csvd_energy": f"WITH {_PHI}, g AS (SELECT a.j AS i, b.j, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im FROM phi a JOIN phi b ON a.i = b.i GROUP BY 1, 2), h AS (SELECT a.i, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2) SELECT (SELECT round(sum(re), 4) FROM g WHERE i = j) + 0.0e0 AS second, (SELECT round(sum(re), 4) FROM h WHERE i = j) + 0.0e0 AS fourth, (SELECT round(sum(h.re * g.re - h.im * g.im), 4) FROM h JOIN g ON h.i = g.j AND h.j = g.i) + 0.0e0 AS sixth",
    "catalog_real": f"WITH {_X} SELECT i, j, {_r('v')} FROM x",
    "catalog_complex": f"WITH {_PHI} SELECT i, j, {_COMPLEX} FROM phi",
    "catalog_integers": "SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(l_partkey % 8 AS BIGINT) AS j, count(*) AS v FROM lineitem GROUP BY 1, 2",
    "catalog_rows": f"WITH {_X} SELECT i, j, {_r('v')} FROM x WHERE i >= 10 AND i < 100",
    "catalog_write_transposed": f"WITH {_X} SELECT j AS i, i AS j, {_r('v')} FROM x",
    "catalog_load_transposed": f"WITH {_X} SELECT j AS i, i AS j, {_r('v')} FROM x",
    "masked_columns": f"WITH {_GRID} SELECT x.j AS i, x.i AS j, {_r('v')} FROM x JOIN grid ON x.i = g WHERE grid.x > 0",
    "numeric_names": "SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer ORDER BY c_custkey",
    "mo_rotate": f"WITH {_SMALL} SELECT a.j AS i, c.j, round(sum(a.v * h.v * c.v), 6) + 0.0e0 AS v FROM small a JOIN small h ON a.i = h.i AND h.i >= h.j JOIN small c ON h.j = c.i GROUP BY 1, 2",
    "mo_orbitals": f"WITH {_SMALL} SELECT a.i, b.j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN small b ON a.j = b.i GROUP BY 1, 2",
    "translation_vectors": f"WITH {_CELLS} SELECT r, {_r('x')}, {_r('y')}, {_r('z')} FROM cells",
    "translation_map": "SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, CAST((b.n_nationkey - a.n_nationkey + 25) % 25 AS BIGINT) AS t FROM nation a, nation b",
    "supercell_phase": f"WITH {_PHASE} SELECT r, k, {_COMPLEX} FROM ph",
    "energy_order": f"WITH {_LEVELS} SELECT m, k, {_r('e')}, row_number() OVER (PARTITION BY k ORDER BY l.e, m) - 1 AS place FROM l",
    "supercell_matrix": f"WITH {_PHASE}, a AS (SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(ascii(o_orderpriority) AS BIGINT) AS p, CAST(ascii(o_orderstatus) AS BIGINT) AS q, sum(o_totalprice) / 1e6 AS re, count(*) / 1e3 AS im FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3) SELECT s.r AS r, p, t.r AS s, q, round(sum((s.re * t.re + s.im * t.im) * a.re - (s.im * t.re - s.re * t.im) * a.im), 4) + 0.0e0 AS re, round(sum((s.re * t.re + s.im * t.im) * a.im + (s.im * t.re - s.re * t.im) * a.re), 4) + 0.0e0 AS im FROM a JOIN ph s USING (k) JOIN ph t USING (k) GROUP BY 1, 2, 3, 4",
    "lowest_orbitals": """
        SELECT row_number() OVER (ORDER BY e) - 1 AS j, round(e, 6) + 0.0e0 AS e
        FROM (SELECT -exp(-(CAST(c_acctbal AS DOUBLE) + 1000) / 500) / (1 + c_nationkey / 50) AS e FROM customer ORDER BY 1 LIMIT 8)""",
    "tiles_xxt": f"WITH {_X} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.j = b.j GROUP BY 1, 2",
    "tiles_aha": f"WITH {_PHI} SELECT a.j AS i, b.j, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0e0 AS re, round(sum(a.re * b.im - a.im * b.re), 6) + 0.0e0 AS im FROM phi a JOIN phi b ON a.i = b.i GROUP BY 1, 2",
    "cholesky_points": f"WITH {_X} SELECT a.i, b.i AS j, round(sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END, 6) + 0.0e0 AS v FROM x a JOIN x b ON a.j = b.j GROUP BY a.i, b.i",
    "lstsq_lines": "WITH y AS (SELECT CAST(l_quantity AS DOUBLE) AS q, unnest([CAST(0 AS BIGINT), 1, 2]) AS k, unnest([CAST(l_extendedprice AS DOUBLE) / 1000, CAST(l_discount AS DOUBLE) * 100, CAST(l_tax AS DOUBLE) * 100]) AS v FROM lineitem) SELECT k, round(regr_intercept(v, q), 4) + 0.0e0 AS constant, round(regr_slope(v, q), 4) + 0.0e0 AS slope, round(sqrt(regr_syy(v, q) - regr_slope(v, q) * regr_sxy(v, q)), 4) + 0.0e0 AS residual FROM y GROUP BY k",
    "nations_rank": "SELECT count(DISTINCT c_nationkey) AS rank, CAST(30 AS BIGINT) AS flags FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "global_order": f"WITH {_LEVELS} SELECT m, k, {_r('e')}, row_number() OVER w - 1 AS place, coalesce(abs(lead(l.e) OVER w - l.e) < 0.005e0, false) OR coalesce(abs(lag(l.e) OVER w - l.e) < 0.005e0, false) AS degenerate FROM l WINDOW w AS (ORDER BY l.e, m)",
    "running_quantities": "SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_partkey AS p, CAST(l_quantity AS BIGINT) AS n, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, row_number() OVER w - 1 AS place FROM lineitem WINDOW w AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey)",
    "dft_prime": _prime("-"),
    "fft_prime": _prime(""),
    "orthonormality": f"WITH {_GRID} {_SHAPE}, o AS (SELECT a.j AS i, b.j, sum(v * (a.re * b.re + a.im * b.im)) - CASE WHEN a.j = b.j THEN 1 ELSE 0 END AS re, sum(v * (a.re * b.im - a.im * b.re)) AS im FROM phi a JOIN phi b ON a.i = b.i JOIN kernel ON a.i = g GROUP BY a.j, b.j) SELECT round(max(sqrt(re * re + im * im)), 6) + 0.0e0 AS worst FROM o",
    "k_to_gamma": f"WITH {_PHASE}, sales AS (SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(ascii(o_orderpriority) AS BIGINT) AS p, CAST(ascii(o_orderstatus) AS BIGINT) AS q, CAST(ascii(c_mktsegment) AS BIGINT) AS m, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey), c AS (SELECT k, p, m, sum(price) / 1e7 AS re, count(*) / 1e4 AS im FROM sales GROUP BY 1, 2, 3), s AS (SELECT k, p, q, sum(price) / 1e6 AS re, count(*) / 1e3 AS im FROM sales GROUP BY 1, 2, 3), g AS (SELECT k AS r, q, m AS j, sum(price) / 1e7 AS v FROM sales GROUP BY 1, 2, 3), h AS (SELECT k, m AS i, q, sum(c.re * s.re + c.im * s.im) AS re, sum(c.re * s.im - c.im * s.re) AS im FROM c JOIN s USING (k, p) GROUP BY 1, 2, 3), f AS (SELECT k, q, j, sum(ph.re * v) AS re, sum(-ph.im * v) AS im FROM ph JOIN g USING (r) GROUP BY 1, 2, 3) SELECT k, i, j, round(sum(h.re * f.re - h.im * f.im), 4) + 0.0e0 AS re, round(sum(h.re * f.im + h.im * f.re), 4) + 0.0e0 AS im FROM h JOIN f USING (k, q) GROUP BY 1, 2, 3",
    "supercell_rotated": f"WITH {_PHASE}, sales AS (SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(ascii(o_orderpriority) - 49 AS BIGINT) AS p, CAST(instr('ABFHM', c_mktsegment[1]) - 1 AS BIGINT) AS q, CAST(month(o_orderdate) - 1 AS BIGINT) AS m, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey), a AS (SELECT k, p, q, sum(price) / 1e7 AS re, count(*) / 1e4 AS im FROM sales GROUP BY 1, 2, 3), c AS (SELECT k AS r, p, m, sum(price) / 1e7 AS v FROM sales GROUP BY 1, 2, 3), big AS (SELECT s.r AS r, p, t.r AS s, q, sum((s.re * t.re + s.im * t.im) * a.re - (s.im * t.re - s.re * t.im) * a.im) AS re, sum((s.re * t.re + s.im * t.im) * a.im + (s.im * t.re - s.re * t.im) * a.re) AS im FROM a JOIN ph s USING (k) JOIN ph t USING (k) GROUP BY 1, 2, 3, 4), h AS (SELECT big.r, big.p, c.m AS j, sum(big.re * c.v) AS re, sum(big.im * c.v) AS im FROM big JOIN c ON big.s = c.r AND big.q = c.p GROUP BY 1, 2, 3), months AS (SELECT CAST(unnest(range(0, 12)) AS BIGINT) AS m), z AS (SELECT c.m AS i, h.j, sum(c.v * h.re) AS re, sum(c.v * h.im) AS im FROM c JOIN h USING (r, p) GROUP BY 1, 2) SELECT x.m AS i, y.m AS j, round(coalesce(re, 0), 4) + 0.0e0 AS re, round(coalesce(im, 0), 4) + 0.0e0 AS im FROM months x CROSS JOIN months y LEFT JOIN z ON z.i = x.m AND z.j = y.m",
    "orbital_order": f"WITH {_LEVELS} SELECT k, m, {_r('e')}, row_number() OVER (ORDER BY l.e, k, m) - 1 AS j FROM l",
    "metric_half": f"WITH {_X} SELECT a.i, b.i AS j, round(coalesce(sum(a.v * b.v) FILTER (a.j < {OCC}), 0) * sum(a.v * b.v) FILTER (a.j >= {OCC}), 6) + 0.0e0 AS v FROM x a JOIN x b ON a.j = b.j GROUP BY 1, 2",
    "prepared_densities": f"WITH {_SMALLC}, o AS (SELECT a.i AS g, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM phi a JOIN sc b ON a.j = b.i GROUP BY 1, 2) SELECT g, round(sum(re * re + im * im), 6) + 0.0e0 AS total, round(sum(re * re + im * im) FILTER (j < {OCC}), 6) + 0.0e0 AS occupied FROM o GROUP BY 1",
    "molecular_written": f"""WITH {_SMALL}, h AS (SELECT a.j AS i, c.j, sum(a.v * h.v * c.v) AS v FROM small a JOIN small h ON a.i = h.i JOIN small c ON h.j = c.i GROUP BY 1, 2),
 o AS (SELECT b.j AS i, a.i AS j, sum(a.v * b.v) AS v FROM x a JOIN small b ON a.j = b.i GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM embeddings),
 r AS (SELECT 'hcore' AS name, i, j, v FROM h UNION ALL SELECT 'THC/Orbitals', i, j, v FROM o UNION ALL SELECT 'THC/HalfTransformedOccOrbitals', i, j, v FROM o WHERE i < 5 UNION ALL SELECT * FROM (VALUES ('Energies', 0, 0, 1.5e0), ('Energies', 1, 0, 0.0e0))
 UNION ALL SELECT 'dims', k - 1, 0, [0, 0, 0, 64, 5, 3, 0, 0][k] FROM (SELECT unnest(range(1, 9)) AS k) UNION ALL SELECT 'THC/dims', k - 1, 0, [64, n, n][k] FROM n, (SELECT unnest(range(1, 4)) AS k))
 SELECT name, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(CAST(v AS DOUBLE), 6) + 0.0e0 AS v FROM r""",
    "class_weights": f"WITH {_C0}{_step(0)} SELECT c, round(c1.w, 6) + 0.0e0 AS w, c1.w < 1e-8 AS weightless FROM c1",
    "zero_matrix": f"WITH {_X} SELECT i, j, {_r('v')}, 0.0e0 AS zero FROM x",
}
