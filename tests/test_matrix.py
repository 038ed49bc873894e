"""Literal cases of products, transposes and Hadamard products, and identities of the solvers.

Lists are matrices in column-major order.
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfactor.functions.scalars import flat_index, kept_reciprocal, multi_index
from gridfactor.operators import fourier, matrix, points, reduce, solve
from gridfactor.sources.catalog import Catalog
from gridfactor.sources.config import JobConfig

A = [1, 2, 3, 4, 5, 6, 7, 8]  # 4 x 2
B = [1, 7, 9, 4, 5, 6, 7, 8]  # 2 x 4
BT = [1, 9, 5, 7, 7, 4, 6, 8]  # 4 x 2
AB = [36, 44, 52, 60, 29, 42, 55, 68, 35, 46, 57, 68, 47, 62, 77, 92]


def entries(spark, values, nrows):
    return spark.createDataFrame([(t % nrows, t // nrows, float(v)) for t, v in enumerate(values)], "i long, j long, v double")


def column_major(a):
    return [r.v for r in a.orderBy("j", "i").collect()]


def dense(spark, x):
    return matrix.from_local(spark, np.asarray(x))


@pytest.mark.parametrize(
    "a, b, ta, tb, want",
    [((A, 4), (B, 2), "N", "N", AB), ((A, 4), (BT, 4), "N", "T", AB), ((BT, 4), (A, 4), "N", "T", [36, 29, 35, 47, 44, 42, 46, 62, 52, 55, 57, 77, 60, 68, 68, 92]), ((A, 4), (BT, 4), "T", "N", [62, 150, 65, 165])],
)
def test_products(spark, a, b, ta, tb, want):
    got = column_major(matrix.product(entries(spark, *a), entries(spark, *b), ta, tb))
    assert got == want


def test_complex_products(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3)) + 1j * rng.normal(size=(5, 3)), rng.normal(size=(5, 4)) + 1j * rng.normal(size=(5, 4))
    for t, want in (("C", x.conj().T @ y), ("T", x.T @ y)):
        np.testing.assert_allclose(matrix.local(matrix.product(dense(spark, x), dense(spark, y), t), 3, 4), want, atol=1e-12)
    low = matrix.local(matrix.gram(dense(spark, x), triangle=True), 3, 3)
    np.testing.assert_allclose(low, np.tril(x.conj().T @ x), atol=1e-12)


def test_transpose_and_hadamard(spark):
    a = entries(spark, range(1, 9), 4)
    assert column_major(matrix.transpose(a)) == [1, 5, 2, 6, 3, 7, 4, 8]
    assert column_major(matrix.transpose(matrix.transpose(a))) == list(range(1, 9))
    two, four = entries(spark, [2] * 16, 4), entries(spark, [4] * 16, 4)
    assert set(column_major(matrix.squared(two))) == {4.0} and set(column_major(matrix.hadamard(two, four))) == {8.0}
    z = dense(spark, np.array([[1 + 2j]]))
    assert matrix.local(matrix.squared(z), 1, 1)[0, 0] == (1 + 2j) ** 2
    assert matrix.local(matrix.hadamard(z, z, conjugate_b=True), 1, 1)[0, 0] == 5
    assert matrix.local(matrix.transpose(z, hermitian=True), 1, 1)[0, 0] == 1 - 2j


def test_large_product(spark):
    """1400 x 1400, as tall rows times a local matrix, and the same as its Gram form."""
    n = 1400
    rows = spark.range(n).select(F.col("id").alias("g"), F.array_repeat(F.lit(0.0025), n).alias("x"))
    y = np.full((n, n), 0.005)
    y[:, 0] += 1
    got = matrix.times_local(rows, "g", "x", y).groupBy("j").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("j").collect()
    assert got[0].a == pytest.approx(3.5175, abs=1e-12) and all(abs(r.a - 0.0175) < 1e-12 and abs(r.b - 0.0175) < 1e-12 for r in got[1:])


def test_rank_one_tensor(spark):
    p = entries(spark, list(range(4)) * 10, 4)
    t = matrix.column_products(p).where("l = 7").orderBy("i", "k").collect()
    assert [r.v for r in t] == [0, 0, 0, 0, 0, 1, 2, 3, 0, 2, 4, 6, 0, 3, 6, 9]


def test_gather(spark):
    a = entries(spark, range(12), 3)
    index = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "pos long, g long")
    assert column_major(matrix.gathered_in_order(a, index)) == [9, 10, 11, 3, 4, 5, 9, 10, 11]
    assert column_major(matrix.gathered_columns(a, index.select("g").distinct())) == [3, 4, 5, 9, 10, 11]


def test_projections(spark):
    a = entries(spark, range(4), 2)
    assert column_major(matrix.add_constant(a, 1.5)) == [1.5, 2.5, 3.5, 4.5] and column_major(matrix.zeroed(a)) == [0.0] * 4
    assert column_major(matrix.lower(a)) == [0, 1, 0, 3] and column_major(matrix.zeros(spark, 2, 2)) == [0.0] * 4
    s = spark.createDataFrame([(3.0,), (1e-13,), (0.0,)], "s double")
    assert [r[0] for r in s.select(kept_reciprocal(F.col("s"), F.lit(3.0), 1e-12)).collect()] == [1 / 3, 0.0, 0.0]
    g = spark.range(60)
    x, y, z = multi_index(F.col("id"), (4, 3, 5))
    assert g.select(flat_index([x, y, z], (4, 3, 5)).alias("f"), "id").where("f != id").count() == 0


def test_reductions(spark):
    v = spark.createDataFrame([(0, 3.0, 3.0), (1, -4.0, 0.0), (2, -4.0, -4.0)], "k long, a double, b double")
    r = v.agg(reduce.argmin("k", F.col("a")).alias("lo"), reduce.argmax("k", -F.col("a")).alias("hi")).first()
    assert (r.lo, r.hi) == (1, 1)
    assert reduce.normed_difference(v, "a", "b").first().norm == pytest.approx(4.0)
    assert reduce.normed_difference(v.select(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), "a", "b").first().norm == 0
    assert reduce.all_zero(v, "a").first()[0] is False and reduce.all_zero(v.limit(0), "a").first()[0] is True
    assert reduce.percent_changed(v, "a", "b").first().percent == pytest.approx(100 / 3)


def test_solvers():
    rng = np.random.default_rng(1)
    a = np.arange(16.0).reshape(4, 4).T
    np.testing.assert_allclose(np.linalg.svd(a, compute_uv=False)[:2], [35.13996365902, 2.276610208715], atol=1e-11)
    inverse, kept = solve.pseudo_inverse(a)
    assert kept == 2 and np.abs(a @ inverse @ a - a).max() < 1e-12 and solve.rank(np.diag([1.0, 1e-3, 0])) == 2
    m = rng.normal(size=(6, 6)) + 1j * rng.normal(size=(6, 6))
    low = solve.cholesky(m @ m.conj().T)
    np.testing.assert_allclose(low @ low.conj().T, m @ m.conj().T, atol=1e-10)
    assert np.abs(np.triu(low, 1)).max() == 0 and (np.diag(low).real > 0).all()
    with pytest.raises(ValueError, match="order 2"):
        solve.cholesky(np.array([[1.0, 2.0], [2.0, 1.0]]))
    x, r, s = solve.least_squares(m)
    assert r == 6 and (np.diff(s) <= 0).all()
    np.testing.assert_allclose(x @ m, np.eye(6), atol=1e-9)


def test_fourier(spark):
    rng = np.random.default_rng(2)
    shape = (4, 3, 5)
    f = rng.normal(size=(2, 60)) + 1j * rng.normal(size=(2, 60))
    table = dense(spark, f).select("i", F.col("j").alias("g"), "re", "im")
    rows = spark.createDataFrame([(g, f[:, g].real.tolist(), f[:, g].imag.tolist()) for g in range(60)], "g long, re array<double>, im array<double>")
    for backward in (False, True):
        want = np.array([(np.fft.ifftn(x.reshape(shape)) * 60 if backward else np.fft.fftn(x.reshape(shape))).ravel() for x in f])
        got = matrix.local(fourier.dft(table, shape, backward).withColumnRenamed("g", "j"), 2, 60)
        np.testing.assert_allclose(got, want, atol=1e-10)
        for r in fourier.fft_rows(rows, shape, backward).collect():
            np.testing.assert_allclose(np.array(r.re) + 1j * np.array(r.im), want[:, r.g], atol=1e-10)


def test_fourier_needs_whole_grids(spark):
    rows = spark.createDataFrame([(g, [float(g)], [0.0]) for g in range(8)], "g long, re array<double>, im array<double>")
    table = rows.select(F.lit(0).cast("long").alias("i"), "g", F.col("re")[0].alias("re"), F.col("im")[0].alias("im"))
    for bad in ("g != 3", "g != 7"):
        with pytest.raises(Exception, match="a line has"):
            fourier.fft_rows(rows.where(bad), (2, 2, 2)).collect()
        with pytest.raises(Exception, match="a line has"):
            fourier.dft(table.where(bad), (2, 2, 2)).collect()
    with pytest.raises(Exception, match="outside"):
        fourier.fft_rows(rows, (1, 2, 2)).collect()
    with pytest.raises(Exception, match="a line has"):
        fourier.fft_rows(rows.where("g != 3").unionByName(rows.where("g = 2")), (2, 2, 2)).collect()


def test_near_cubic():
    for n in (1, 2, 7, 60, 97, 500, 2000, 10**6, 29**3):
        a, b, c = fourier.near_cubic(n)
        assert a * b * c == n and a >= b
    assert fourier.near_cubic(2000) == (20, 10, 10) and fourier.near_cubic(29**3) == (29, 29, 29)


def test_tall_forms(spark):
    """Row forms are the products of entries; the complex Gram has one triangle if asked; nothing is joined."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 3))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    np.testing.assert_allclose(matrix.local(matrix.gram_of_rows(rows, "x", "y"), 4, 3), x.T @ y, atol=1e-12)
    z = x + 1j * x[:, ::-1]
    rows = spark.createDataFrame([(a.real.tolist(), a.imag.tolist()) for a in z], "re array<double>, im array<double>")
    np.testing.assert_allclose(matrix.local(matrix.gram_of_complex_rows(rows), 4, 4), z.conj().T @ z, atol=1e-12)
    np.testing.assert_allclose(matrix.local(matrix.gram_of_complex_rows(rows, triangle=True), 4, 4), np.tril(z.conj().T @ z), atol=1e-12)
    assert "Join" not in matrix.gram_of_complex_rows(rows)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="more than the driver holds"):
        matrix.local(matrix.gram_of_complex_rows(rows), 1 << 14, 1 << 13)


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0]])
    x = np.concatenate([c + rng.normal(size=(40, 3)) for c in centers])
    grid = spark.createDataFrame([(g, *map(float, p)) for g, p in enumerate(x)], "g long, x double, y double, z double")
    weights = grid.select("g", F.lit(1.0).alias("w"))
    got = points.kmeans(grid, weights, 3, initial=[0, 40, 80])
    want = [int(((x - x[40 * k : 40 * k + 40].mean(0)) ** 2).sum(1).argmin()) for k in range(3)]
    assert got == want
    with pytest.raises(ValueError, match="without weight"):
        points.kmeans(grid, grid.select("g", F.when(F.col("g") < 40, 0.0).otherwise(1.0).alias("w")), 3, initial=[0, 40, 80])
    with pytest.raises(ValueError):
        points.kmeans(grid, weights, 500)


def pivoted_qr(z, n):
    z, out = z.copy(), []
    for _ in range(n):
        d = (abs(z) ** 2).sum(0)
        k = int(d.argmax())
        out.append((k, d[k] ** 0.5))
        q = z[:, k] / d[k] ** 0.5
        z -= np.outer(q, q.conj() @ z)
    return out


@pytest.mark.parametrize("occupied", [None, 2])
def test_pivots(spark, occupied):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(60, 3)) + 1j * rng.normal(size=(60, 3))
    o = f[:, :occupied]
    rows = lambda x: spark.createDataFrame([(g, x[g].real.tolist(), x[g].imag.tolist()) for g in range(60)], "g long, re array<double>, im array<double>")
    z = np.array([o[:, i].conj() * f[:, k] for i in range(o.shape[1]) for k in range(3)])
    n = len(z)
    got, want = points.pivots(rows(o), rows(f), n, block=2 if occupied else 16), pivoted_qr(z, n)
    assert [g for g, _ in got] == [g for g, _ in want]
    np.testing.assert_allclose([r for _, r in got], [r for _, r in want], atol=1e-10)
    with pytest.raises(ValueError, match="rank"):
        points.pivots(rows(o), rows(f), n + 1)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/m")
    a = entries(spark, range(16), 4)
    c.save("Hamiltonian/THC/Luv", a, (4, 4))
    c.save("real", entries(spark, range(8), 4), (4, 2), transposed=True)
    assert column_major(c.load("Hamiltonian/THC/Luv")) == list(range(16)) and c.shape("Hamiltonian/THC/Luv") == (4, 4) and c.kind("real") == "double"
    assert column_major(c.load("Hamiltonian/THC/Luv", rows=(2, 3))) == [2, 6, 10, 14] and c.shape("real") == (2, 4)
    assert {r.name for r in c.names().collect()} == {"Hamiltonian/THC/Luv", "real"}
    assert "PushedFilters: [IsNotNull(i), GreaterThanOrEqual(i,2)" in c.load("real", rows=(2, 3))._jdf.queryExecution().toString()


def test_config():
    text = '{"orbital_file": "o", "output_file": "h", "thc_cfac": 15, "half_rotated": true, "thc_half_cfac": 10, "interpolating_points": {"kmeans": {"max_it": 1000, "threshold": 1e-5}, "qrcp": {}}}'
    c = JobConfig.from_json(text)
    assert (c.solver, c.thc_cfac, c.thc_half_cfac, c.max_it, c.density) == ("kmeans", 15, 10, 1000, "density")
    assert JobConfig.from_json('{"orbital_file": "o", "thc_cfac": 3, "find_interp_vec": false, "interpolating_points": {"qrcp": {}}}').solver == "qrcp"
    for bad in ('{"orbital_file": "o", "thc_cfac": 3, "output_file": "h"}', '{"orbital_file": "o", "thc_cfac": 3, "interpolating_points": {"qrcp": {}}}'):
        with pytest.raises(ValueError):
            JobConfig.from_json(bad)


@pytest.mark.parametrize("block", [4, 7, 40])
def test_pivots_by_sketch(spark, block, monkeypatch):
    """What is left after n points is at most twice that of exact pivots, with a pass for each block; the diagonals are those of the points' QR."""
    rng = np.random.default_rng(11)
    n, decay = 14, np.logspace(0, -2, 6)
    o, f = (rng.normal(size=(120, 6)) + 1j * rng.normal(size=(120, 6)) for _ in range(2))
    o, f = o * decay, f * decay
    rows = lambda a: spark.createDataFrame([(g, a[g].real.tolist(), a[g].imag.tolist()) for g in range(len(a))], "g long, re array<double>, im array<double>").repartition(11)
    z = np.array([o[:, i].conj() * f[:, k] for i in range(6) for k in range(6)])
    passes = []
    extended = points._extended
    monkeypatch.setattr(points, "_extended", lambda *a: passes.append(1) or extended(*a))
    got = points.pivots_by_sketch(rows(o), rows(f), n, block=block)
    assert len(passes) == -(-n // block) - 1 and len({g for g, _ in got}) == n
    rest = lambda chosen: np.linalg.norm(z - (q := np.linalg.qr(z[:, [g for g, _ in chosen]])[0]) @ (q.conj().T @ z))
    assert rest(got) <= 2 * rest(points.pivots(rows(o), rows(f), n))
    np.testing.assert_allclose([r for _, r in got], abs(np.diagonal(np.linalg.qr(z[:, [g for g, _ in got]], mode="r"))), rtol=1e-6)
    with pytest.raises(ValueError, match="rank 36"):
        points.pivots_by_sketch(rows(o), rows(f), 37, block=block)


@pytest.mark.parametrize("shape, most", [((37, 1, 1), 8), ((2, 74, 1), 8), ((60, 1, 1), 4), ((3, 4, 17), 5), ((1, 128, 2), 2)])
def test_long_axes(spark, shape, most):
    """Axes beyond what is transformed at once: by stages, and by a chirp where a prime is left."""
    rng = np.random.default_rng(12)
    n = int(np.prod(shape))
    x = rng.normal(size=(n, 2)) + 1j * rng.normal(size=(n, 2))
    want = {b: np.stack([(np.fft.ifftn(c.reshape(shape)) * n if b else np.fft.fftn(c.reshape(shape))).ravel() for c in x.T], 1) for b in (False, True)}
    rows = spark.createDataFrame([(g, x[g].real.tolist(), x[g].imag.tolist()) for g in range(n)], "g long, re array<double>, im array<double>")
    entries_ = spark.createDataFrame([(i, g, float(x[g, i].real), float(x[g, i].imag)) for g in range(n) for i in range(2)], "i long, g long, re double, im double")
    for b in (False, True):
        got = fourier.fft_rows(rows, shape, b, most).orderBy("g").collect()
        np.testing.assert_allclose(np.array([r.re for r in got]) + 1j * np.array([r.im for r in got]), want[b], atol=1e-9)
    got = fourier.dft(entries_, shape, True, most).orderBy("g", "i").collect()
    np.testing.assert_allclose(np.array([complex(r.re, r.im) for r in got]).reshape(n, 2), want[True], atol=1e-9)
    for broken in (rows.where("g <> 1"), rows.where("g <> 1").unionAll(rows.where("g = 0"))):
        with pytest.raises(Exception, match="points"):
            fourier.fft_rows(broken, shape, False, most).collect()


def test_a_chirp_before_another_axis(spark):
    """The points of the chirp's padding are none of the grid's, also while the next axis looks for points outside."""
    shape = (17, 1, 2)
    x = np.random.default_rng(13).normal(size=34)
    table = spark.createDataFrame([(0, g, float(v), 0.0) for g, v in enumerate(x)], "i long, g long, re double, im double")
    for backward in (False, True):
        got = fourier.dft(table, shape, backward, most=5).orderBy("g").collect()
        want = np.fft.ifftn(x.reshape(shape)) * 34 if backward else np.fft.fftn(x.reshape(shape))
        np.testing.assert_allclose([complex(r.re, r.im) for r in got], want.ravel(), atol=1e-10)
    for bad in (-1, 34):
        more = table.unionByName(table.limit(1).withColumn("g", F.lit(bad).cast("long")))
        with pytest.raises(Exception, match="outside"):
            fourier.dft(more, (2, 1, 17)).collect()
        with pytest.raises(Exception, match="outside|a line has"):
            fourier.dft(more, shape, most=5).collect()
