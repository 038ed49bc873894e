"""Choice of interpolation points: density-weighted k-means, and pivoted selection.

Grid points are a table and stay one.  What the driver holds is bounded by the number of chosen points:
centroids for k-means, one row of orbitals for each pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.arrays import dense_complex, lists
from ..functions.storage import stored
from .reduce import argmin, sampled

AXES = ("x", "y", "z")


class Cells:
    """Places in space by the cell of a regular grid that they are in, about PER_CELL of them in each.

    A search goes from the cell of a point outward, a shell of cells at a time, until no place outside what was
    seen can be as near as the best: with n places it computes some tens of distances in place of n, and the
    memory of a batch doesn't grow with n.
    """

    PER_CELL, MOST_CELLS = 2, 1 << 10

    def __init__(self, places: np.ndarray):
        self.places = places
        n, (self.low, high) = len(places), (places.min(0), places.max(0))
        extent = high - self.low
        wide = extent > 0
        side = np.exp((np.log(extent[wide]).sum() + np.log(self.PER_CELL / n)) / wide.sum()) if wide.any() else 1.0
        self.n = np.where(wide, np.clip(np.ceil(extent / side), 1, self.MOST_CELLS), 1).astype(np.int64)
        self.side = np.where(wide, extent / self.n, 1.0)
        flat = self._flat(self._cell(places))
        self.order = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[self.order], np.arange(int(np.prod(self.n)) + 1))

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.side), 0, self.n - 1).astype(np.int64)

    def _flat(self, cell: np.ndarray) -> np.ndarray:
        return (cell[..., 0] * self.n[1] + cell[..., 1]) * self.n[2] + cell[..., 2]

    def _reach(self, x: np.ndarray, cell: np.ndarray, r: int) -> np.ndarray:
        """How far from each point the nearest place outside of its cell's r shells is at least."""
        out = np.full(len(x), np.inf)
        for a in range(3):
            below, above = cell[:, a] - r, cell[:, a] + r + 1
            left = x[:, a] - (self.low[a] + below * self.side[a])
            right = self.low[a] + above * self.side[a] - x[:, a]
            out = np.minimum(out, np.where(below > 0, left, np.inf))
            out = np.minimum(out, np.where(above < self.n[a], right, np.inf))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest place of each point (the lower number of several), the squared distance, and how many distances were computed."""
        best, where, computed = np.full(len(x), np.inf), np.zeros(len(x), np.int64), 0
        cell, rows, r = self._cell(x), np.arange(len(x)), 0
        while len(rows):
            reach = range(-r, r + 1)
            for off in [(i, j, k) for i in reach for j in reach for k in reach if max(abs(i), abs(j), abs(k)) == r]:
                at = cell[rows] + np.array(off)
                of = rows[((at >= 0) & (at < self.n)).all(1)]
                flat = self._flat(cell[of] + np.array(off))
                first, count = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
                for k in range(int(count.max(initial=0))):
                    has = count > k
                    of, first, count = of[has], first[has], count[has]
                    number = self.order[first + k]
                    d = x[of] - self.places[number]
                    d = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                    take = (d < best[of]) | ((d == best[of]) & (number < where[of]))
                    best[of[take]], where[of[take]] = d[take], number[take]
                    computed += len(of)
            outside = self._reach(x[rows], cell[rows], r)
            rows = rows[(outside < np.inf) & ~(best[rows] < (outside * (1 - 1e-12)) ** 2 * (outside > 0))]
            r += 1
        return where, best, computed


def _xyz(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[a].to_numpy(zero_copy_only=False).astype(np.float64) for a in AXES], 1)


def with_class(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points(g, x, y, z, ...) with `c`, the nearest of centroids(c, x, y, z), the least number of several.

    The centroids, as many as chosen points, are in every task, with an index of their cells.
    """
    rows = sorted(tuple(r) for r in centroids.select("c", *AXES).collect())
    if not rows:
        raise ValueError("there are no centroids")
    numbers, cells = np.array([r[0] for r in rows], np.int64), Cells(np.array([r[1:] for r in rows], np.float64))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = numbers[cells.nearest(_xyz(batch))[0]] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c)], [*batch.schema.names, "c"])

    return points.mapInArrow(classify, StructType([*points.schema.fields, StructField("c", LongType())]))


def classify(grid: DataFrame, centroids: DataFrame) -> DataFrame:
    """grid(g, x, y, z) and centroids(c, x, y, z): (g, c), the nearest centroid, the least number of several."""
    return with_class(grid, centroids).select("g", "c")


def means(classified: DataFrame) -> DataFrame:
    """Weighted means (c, w, x, y, z) of points(x, y, z, w, c), by class."""
    return classified.groupBy("c").agg(F.sum("w").alias("w"), *[F.try_divide(F.sum(F.col("w") * F.col(a)), F.sum("w")).alias(a) for a in AXES])


def update(grid: DataFrame, classes: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means: (c, w, x, y, z) of the points of each class; weights(g, w)."""
    return means(grid.join(classes, "g").join(weights, "g"))


def step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """One step of k-means: points(x, y, z, w) are read once, and only sums are shuffled."""
    return means(with_class(points.select(*AXES, "w"), centroids.select("c", *AXES)))


def snap(grid: DataFrame, centroids: DataFrame) -> DataFrame:
    """(c, g): the grid point nearest to each centroid, the least of several; centroids are as many as chosen points."""
    rows = sorted(centroids.select("c", *AXES).collect())
    place = centroids.sparkSession.createDataFrame([(k, r.c) for k, r in enumerate(rows)], "k long, number long")
    found = _snap_rows(grid, np.array([r[1:] for r in rows], np.float64).reshape(-1, 3)).withColumnRenamed("c", "k")
    return found.join(F.broadcast(place), "k").select(F.col("number").alias("c"), "g")


def _cluster_sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points(x, y, z, w): each task's weighted sums by nearest centroid, added up: (c, w, x, y, z)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cells = np.zeros((len(centroids), 4)), Cells(centroids)
        for batch in batches:
            x, w = _xyz(batch), batch["w"].to_numpy()
            c = cells.nearest(x)[0]
            for k, v in enumerate((w, *(w[:, None] * x).T)):
                total[:, k] += np.bincount(c, v, len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids)))] + [pa.array(t) for t in total.T.copy()], ["c", "w", *AXES])

    return points.mapInArrow(sums, "c long, w double, x double, y double, z double").groupBy("c").agg(*[F.sum(a).alias(a) for a in ("w", *AXES)])


def kmeans(grid: DataFrame, weights: DataFrame, n: int, threshold: float = 1e-5, max_it: int = 1000, seed: int = 0, initial: list[int] | None = None) -> list[int]:
    """Grid points nearest to the centroids of weighted k-means, ascending; duplicates are kept.

    A step reads the points once; centroids go to the tasks and sums come back.  An empty class, or one
    without weight, is an error.
    """
    points = grid.join(weights, "g").select("g", *AXES, "w").persist()
    start = initial if initial is not None else [r.g for r in sampled(points, n, seed).collect()]
    at = {r.g: [r[a] for a in AXES] for r in points.where(F.col("g").isin(start)).collect()}
    if len(set(start)) < n or len(at) < n:
        raise ValueError(f"{n} points to start from are asked for, {len(at)} were found")
    centroids = np.array([at[g] for g in start], np.float64)
    for _ in range(max_it):
        new = np.zeros((n, 4))
        for r in _cluster_sums(points.drop("g"), centroids).collect():  # n rows
            new[r.c] = (r.w, r.x, r.y, r.z)
        if (new[:, 0] < 1e-8).any():
            raise ValueError(f"classes without weight: {np.flatnonzero(new[:, 0] < 1e-8).tolist()}")
        moved = new[:, 1:] / new[:, :1]
        change = float(np.sqrt(((moved - centroids) ** 2).sum()))
        centroids = moved
        if change < threshold:
            break
    found = _snap_rows(points, centroids).collect()
    points.unpersist()
    return sorted(r.g for r in found)


def _snap_rows(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full(len(centroids), np.inf), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, g = _xyz(batch), batch["g"].to_numpy()
                by_g = np.argsort(g, kind="stable")
                k, low, _ = Cells(x[by_g]).nearest(centroids)
                at = g[by_g][k]
                take = (low < best) | ((low == best) & (at < where))
                best[take], where[take] = low[take], at[take]
        keep = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids))[keep]), pa.array(where[keep]), pa.array(best[keep])], ["c", "g", "d"])

    return points.mapInArrow(nearest, "c long, g long, d double").groupBy("c").agg(argmin("g", F.col("d")).alias("g"))


Pivot = tuple[np.ndarray, np.ndarray, np.ndarray, float]  # both orbitals, the entries of all earlier columns, the diagonal
KINDS = "lr array<double>, li array<double>, rr array<double>, ri array<double>, cr array<double>, ci array<double>"


def _state(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both orbitals of each point, with the entries of its columns (cr, ci) and its residual d, of which there are none yet."""
    a = left.select("g", F.col("re").alias("lr"), F.col("im").alias("li"))
    rows = a.join(right.select("g", F.col("re").alias("rr"), F.col("im").alias("ri")), "g")
    none = F.array().cast("array<double>")
    return stored(rows.withColumns({"cr": none, "ci": none, "d": F.lit(None).cast("double")}))


def _formed(batch: pa.RecordBatch, fresh: list[Pivot], chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The residuals, -1 at pivots, and the entries of all columns of this batch's points: those it has, and those of fresh pivots."""
    x, y = dense_complex(batch, "lr", "li"), dense_complex(batch, "rr", "ri")
    had = dense_complex(batch, "cr", "ci").reshape(len(x), -1)
    d = batch["d"].to_numpy(zero_copy_only=False) if batch["d"].null_count == 0 else (abs(x) ** 2).sum(1) * (abs(y) ** 2).sum(1)
    cols = np.concatenate([had, np.zeros((len(x), len(fresh)), np.complex128)], 1)
    k = had.shape[1]
    for px, py, before, r in fresh:
        z = (x @ px.conj()) * (y.conj() @ py)
        cols[:, k] = (z - cols[:, :k] @ before.conj()) / r
        d = d - abs(cols[:, k]) ** 2
        k += 1
    d = d.copy()
    d[np.isin(batch["g"].to_numpy(), chosen)] = -1.0
    return d, cols


def _extended(rows: DataFrame, fresh: list[Pivot], chosen: list[int]) -> DataFrame:
    """The points with the columns of fresh pivots, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d, cols = _formed(batch, fresh, chosen)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("g", "lr", "li", "rr", "ri")], lists(cols.real), lists(cols.imag), pa.array(d)], ["g", "lr", "li", "rr", "ri", "cr", "ci", "d"])

    return stored(rows.mapInArrow(run, f"g long, {KINDS}, d double"))


def _complex(re: list[float], im: list[float]) -> np.ndarray:
    return np.array(re, np.float64) + 1j * np.array(im, np.float64)


def pivots(left: DataFrame, right: DataFrame, n: int, tolerance: float = 1e-7, block: int = 16) -> list[tuple[int, float]]:
    """Points and |R| diagonals of a column-pivoted QR of Z[ik, g] = conj(left_i(g)) right_k(g), without Z.

    left and right are row-arrays (g, re, im).  Z^H Z is the product of two small Gram kernels, entry by
    entry, so a step of pivoted Cholesky needs its columns at the pivots alone.  Each step is one pass over
    the points that returns each batch's point with the largest residual.  After every `block` pivots the
    points' entries of these columns and their residuals are written next to them, so that a pass forms at
    most a block of columns: with N points and n pivots, N n block work a pass and N n^2 block in all.
    Below `tolerance` of the first diagonal the rest is noise: asking for points there is an error.
    """
    rows = _state(left, right)
    chosen: list[tuple[int, float]] = []
    fresh: list[Pivot] = []  # since the last write

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d, cols = _formed(batch, fresh, [g for g, _ in chosen])
                k = int(np.lexsort((batch["g"].to_numpy(), -d))[0])
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one["g"], pa.array([float(d[k])]), *[one[c] for c in ("lr", "li", "rr", "ri")], lists(cols[k : k + 1].real), lists(cols[k : k + 1].imag)], ["g", "d", "lr", "li", "rr", "ri", "cr", "ci"])

    for _ in range(n):
        if len(fresh) == block:
            rows = _extended(rows, fresh, [g for g, _ in chosen])
            fresh.clear()
        best = rows.mapInArrow(best_of, f"g long, d double, {KINDS}").orderBy(F.desc("d"), "g").first()
        if best is None or best.d <= 0 or (chosen and best.d**0.5 < tolerance * chosen[0][1]):
            raise ValueError(f"{n} points are asked for, but the products have rank {len(chosen)}")
        chosen.append((best.g, best.d**0.5))
        fresh.append((_complex(best.lr, best.li), _complex(best.rr, best.ri), _complex(best.cr, best.ci), best.d**0.5))
    return chosen


def pivoted(x: np.ndarray, g: np.ndarray, n: int) -> list[int]:
    """Up to n columns in the order of a column-pivoted QR, the least g of equal norms; fewer if the rest are zeros."""
    x, out = x.copy(), []
    for _ in range(min(n, x.shape[1])):
        norms = (abs(x) ** 2).sum(0)
        norms[out] = -1.0
        k = int(np.lexsort((g, -norms))[0])
        if norms[k] <= 0:
            break
        out.append(k)
        q = x[:, k] / norms[k] ** 0.5
        for _ in range(2):
            x -= np.outer(q, q.conj() @ x)
    return out


def pivots_by_sketch(left: DataFrame, right: DataFrame, n: int, tolerance: float = 1e-7, block: int = 16, over: int = 10, seed: int = 0) -> list[tuple[int, float]]:
    """As pivots(), with two passes over the points for each `block` of them in place of one for each.

    A row of the sketch is a product of two Gaussian combinations, of left and of right orbitals, which is a random
    combination of Z's rows that needs no Z.  A point has block + over such values, less the part that chosen
    columns explain.  Each task takes a block of its points by a pivoted QR of their values, and blocks of tasks
    meet in a tree of such QRs; so which points are found depends a little on the partitions and the seed.  The
    diagonals of R are those of the points found, in their order.
    """
    rows = _state(left, right)
    widths = rows.select(F.size("lr").alias("a"), F.size("rr").alias("b")).first()
    if widths is None:
        raise ValueError("there are no points")
    rng, height = np.random.default_rng(seed), block + over
    a, b = (rng.normal(size=(height, w)) + 1j * rng.normal(size=(height, w)) for w in (widths.a, widths.b))
    sketched: list[np.ndarray] = []  # of each column found so far: its sketch
    chosen: list[tuple[int, float]] = []
    schema = f"place long, g long, {KINDS}, sr array<double>, si array<double>"
    names = ["g", "lr", "li", "rr", "ri", "cr", "ci", "sr", "si"]

    def sketch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x.conj() @ a.T) * (y @ b.T)

    def best(table: pa.Table) -> pa.Table:
        x = dense_complex(table, "sr", "si").T
        return table.take(pa.array(pivoted(x, table["g"].to_numpy(), block), pa.int64()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, place = None, 0
        for batch in batches:
            if batch.num_rows:
                d, cols = _formed(batch, [], [g for g, _ in chosen])
                y = sketch(dense_complex(batch, "lr", "li"), dense_complex(batch, "rr", "ri"))
                if sketched:
                    y = y - cols.conj() @ np.array(sketched)
                y[d < 0] = 0
                part = pa.table([*[batch[c] for c in names[:5]], lists(cols.real), lists(cols.imag), lists(y.real), lists(y.imag)], names)
                found, place = best(part if found is None else pa.concat_tables([found, part])), batch["place"][0].as_py()
        if found is not None:
            yield from found.add_column(0, "place", pa.array([place] * found.num_rows, pa.int64())).to_batches()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        found = best(table)
        return found.select(["g", *names[1:]]).add_column(0, "place", pa.array([key[0].as_py()] * found.num_rows, pa.int64()))

    while len(chosen) < n:
        found = rows.withColumn("place", F.spark_partition_id().cast("long"))
        last = rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
        found = found.mapInArrow(task, schema)
        while last > 0:
            found = found.withColumn("to", F.floor(F.col("place") / 8)).groupBy("to").applyInArrow(lambda key, table: merge(key, table), schema)
            last //= 8
        table = found.toArrow()  # a block of points
        table = table.take(pa.array(pivoted(dense_complex(table, "sr", "si").T, table["g"].to_numpy(), block), pa.int64()))
        fresh: list[Pivot] = []
        x, y, had = dense_complex(table, "lr", "li"), dense_complex(table, "rr", "ri"), dense_complex(table, "cr", "ci").reshape(table.num_rows, -1)
        plain = sketch(x, y)
        for k in range(min(table.num_rows, n - len(chosen))):
            own = had[k]
            for px, py, before, r in fresh:  # its entries of the block's columns
                own = np.append(own, ((x[k] @ px.conj()) * (y[k].conj() @ py) - own @ before.conj()) / r)
            d = (abs(x[k]) ** 2).sum() * (abs(y[k]) ** 2).sum() - (abs(own) ** 2).sum()
            if d <= 0 or (chosen and d**0.5 < tolerance * chosen[0][1]):
                break
            r = float(d**0.5)
            rest = plain[k] - own.conj() @ np.array(sketched) if sketched else plain[k]
            sketched.append(rest / r)
            fresh.append((x[k], y[k], own, r))
            chosen.append((table["g"][k].as_py(), r))
        if not fresh:
            raise ValueError(f"{n} points are asked for, but the products have rank {len(chosen)}")
        if len(chosen) < n:
            rows = _extended(rows, fresh, [g for g, _ in chosen])
    return chosen
