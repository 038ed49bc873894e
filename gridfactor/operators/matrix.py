"""Matrices as tables of entries.

A real matrix is (i, j, v), a complex one (i, j, re, im), with every entry present: explicit zeros are
entries.  Indices are longs.  A product is a join on the contracted index and a grouped sum, which Spark
aggregates before it shuffles; tall matrices (many rows, few columns) have forms that read each row once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dense, dense_complex
from ..functions.scalars import conj, pair, times
from .order import ranged, with_place

#: The most entries that a matrix may have which the driver holds (factorizations of point by point size): at most 2 GB as Arrow columns.
LOCAL_ENTRIES = 1 << 26


def zeros(spark, nrows: int, ncols: int) -> DataFrame:
    return spark.range(nrows).select(F.col("id").alias("i")).join(spark.range(ncols).select(F.col("id").alias("j"))).withColumn("v", F.lit(0.0))


def from_arrays(rows: DataFrame, index: str, values: str) -> DataFrame:
    """Entries from a table with a row's index and its array of values."""
    return rows.select(F.col(index).cast("bigint").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def complex_from_arrays(rows: DataFrame, index: str, values: str) -> DataFrame:
    """Complex entries from arrays in which real and imaginary parts alternate."""
    z = complex_rows(rows, index, values).select(F.col("g").alias("i"), F.posexplode(F.arrays_zip("re", "im")).alias("j", "z"))
    return z.select("i", F.col("j").cast("bigint").alias("j"), "z.re", "z.im")


def complex_rows(rows: DataFrame, index: str, values: str) -> DataFrame:
    """(g, re, im): the same, a row of the matrix in a row of the table."""
    part = lambda k: F.transform(F.filter(values, lambda _, p: p % 2 == k), lambda x: x.cast("double"))
    return rows.select(F.col(index).cast("bigint").alias("g"), part(0).alias("re"), part(1).alias("im"))


def is_complex(a: DataFrame) -> bool:
    return "re" in a.columns


def values_of(a: DataFrame) -> list[str]:
    return ["re", "im"] if is_complex(a) else ["v"]


def transpose(a: DataFrame, hermitian: bool = False) -> DataFrame:
    swapped = a.select(F.col("j").alias("i"), F.col("i").alias("j"), *values_of(a))
    return swapped.withColumn("im", -F.col("im")) if hermitian and is_complex(a) else swapped


def to_complex(a: DataFrame) -> DataFrame:
    return a.select("i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))


def add_constant(a: DataFrame, x: float) -> DataFrame:
    return a.withColumn("v", F.col("v") + F.lit(x))


def zeroed(a: DataFrame) -> DataFrame:
    return a.withColumns({c: F.lit(0.0) for c in values_of(a)})


def scaled(a: DataFrame, factor: Column) -> DataFrame:
    return a.withColumns({c: F.col(c) * factor for c in values_of(a)})


def squared(a: DataFrame) -> DataFrame:
    """Entry times itself; for complex entries z * z, not the square of the modulus."""
    if not is_complex(a):
        return a.withColumn("v", F.col("v") * F.col("v"))
    z = pair("re", "im")
    re, im = times(z, z)
    return a.select("i", "j", re.alias("re"), im.alias("im"))


def hadamard(a: DataFrame, b: DataFrame, conjugate_b: bool = False) -> DataFrame:
    """The product entry by entry."""
    other = b.select(F.col("i").alias("i2"), F.col("j").alias("j2"), *[F.col(c).alias(f"{c}2") for c in values_of(b)])
    both = a.join(other, (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")))
    if not is_complex(a):
        return both.select("i", "j", (F.col("v") * F.col("v2")).alias("v"))
    y = pair("re2", "im2")
    re, im = times(pair("re", "im"), conj(y) if conjugate_b else y)
    return both.select("i", "j", re.alias("re"), im.alias("im"))


def lower(a: DataFrame) -> DataFrame:
    """Zeros above the diagonal."""
    return a.withColumns({c: F.when(F.col("j") > F.col("i"), F.lit(0.0)).otherwise(F.col(c)) for c in values_of(a)})


def product(a: DataFrame, b: DataFrame, trans_a: str = "N", trans_b: str = "N") -> DataFrame:
    """op(A) op(B) with op N (as is), T (transposed) or C (conjugate transposed)."""
    left = a if trans_a == "N" else transpose(a, trans_a == "C")
    right = b if trans_b == "N" else transpose(b, trans_b == "C")
    left = left.select("i", F.col("j").alias("k"), *values_of(a))
    right = right.select(F.col("i").alias("k"), "j", *[F.col(c).alias(f"{c}2") for c in values_of(b)])
    both = left.join(right, "k").groupBy("i", "j")
    if not is_complex(a):
        return both.agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
    re, im = times(pair("re", "im"), pair("re2", "im2"))
    return both.agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def gram(a: DataFrame, triangle: bool = False) -> DataFrame:
    """A^T A, or A^H A; with triangle, only where i >= j."""
    left = a.select(F.col("i").alias("k"), F.col("j").alias("i"), *values_of(a))
    right = a.select(F.col("i").alias("k"), "j", *[F.col(c).alias(f"{c}2") for c in values_of(a)])
    both = left.join(right, "k")
    both = (both.where("i >= j") if triangle else both).groupBy("i", "j")
    if not is_complex(a):
        return both.agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
    re, im = times(conj(pair("re", "im")), pair("re2", "im2"))
    return both.agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def gram_of_rows(rows: DataFrame, values: str, right: str | None = None) -> DataFrame:
    """X^T X of a tall matrix whose rows are arrays, or X^T Y with Y's rows in another column: a task sums its rows' outer products, then tasks' sums are added."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = dense(batch[values])
            if len(x):
                part = x.T @ (x if right is None else dense(batch[right]))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    columns = [values] if right is None else [values, right]
    return rows.select(*columns).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_of_complex_rows(rows: DataFrame, triangle: bool = False) -> DataFrame:
    """A^H A of row-arrays (g, re, im), by tasks' sums; with triangle, only where i >= j."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = dense_complex(batch)
                part = x.conj().T @ x
                total = part if total is None else total + part
        if total is not None:
            i, j = np.tril_indices(len(total)) if triangle else np.divmod(np.arange(total.size), total.shape[1])
            z = total[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(z.real.copy()), pa.array(z.imag.copy())], ["i", "j", "re", "im"])

    return rows.select("re", "im").mapInArrow(partial, "i long, j long, re double, im double").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def times_local(rows: DataFrame, index: str, values: str, right: np.ndarray) -> DataFrame:
    """X R of a tall matrix and a small one that every task holds: entries (i, j, v)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = dense(batch[values]) @ right
                i = np.repeat(batch[index].to_numpy(zero_copy_only=False).astype(np.int64), y.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.arange(y.shape[1]), len(y))), pa.array(y.ravel())], ["i", "j", "v"])

    return rows.select(index, values).mapInArrow(multiply, "i long, j long, v double")


def gathered_columns(a: DataFrame, indices: DataFrame) -> DataFrame:
    """The columns whose index is in indices(g), in ascending order, numbered from 0."""
    place = with_place(ranged(indices.select(F.col("g").alias("j")), ["j"]), ["j"], "pos").select("j", "pos")
    return a.join(place, "j").select("i", F.col("pos").alias("j"), *values_of(a))


def gathered_in_order(a: DataFrame, indices: DataFrame) -> DataFrame:
    """The columns listed in indices(pos, g), in that order; a column may be listed twice."""
    return a.join(indices, a["j"] == indices["g"]).select("i", F.col("pos").alias("j"), *values_of(a))


def masked_columns(a: DataFrame, flags: DataFrame) -> DataFrame:
    """The columns whose flag in flags(j, flag) is positive, under their own index."""
    return a.join(flags.where("flag > 0").select("j"), "j", "left_semi").select("i", "j", *values_of(a))


def by_numeric_name(a: DataFrame, name: str) -> DataFrame:
    """Rows in the numeric order of a text key; keys that aren't numbers come last."""
    return a.orderBy(F.col(name).try_cast("bigint").asc_nulls_last(), name)


def column_products(p: DataFrame) -> DataFrame:
    """(i, k, l, v): P[i, l] * P[k, l], each column's outer product with itself."""
    left = p.select(F.col("j").alias("l"), "i", "v")
    right = p.select(F.col("j").alias("l"), F.col("i").alias("k"), F.col("v").alias("w"))
    return left.join(right, "l").select("i", "k", "l", (F.col("v") * F.col("w")).alias("v"))


def orbital_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, k, g, re, im): conj(left_i(g)) * right_k(g), of (i, j) = (point g, orbital)."""
    a = left.select(F.col("i").alias("g"), F.col("j").alias("i"), "re", "im")
    b = right.select(F.col("i").alias("g"), F.col("j").alias("k"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    re, im = times(conj(pair("re", "im")), pair("re2", "im2"))
    return a.join(b, "g").select("i", "k", "g", re.alias("re"), im.alias("im"))


def local(a: DataFrame, nrows: int, ncols: int) -> np.ndarray:
    """A small matrix as an array of the driver; LOCAL_ENTRIES is the bound."""
    if nrows * ncols > LOCAL_ENTRIES:
        raise ValueError(f"{nrows} x {ncols} entries are more than the driver holds")
    found = a.select("i", "j", *values_of(a)).toArrow()
    column = lambda c: found[c].to_numpy()
    out = np.zeros((nrows, ncols), np.complex128 if is_complex(a) else np.float64)
    out[column("i"), column("j")] = column("re") + 1j * column("im") if is_complex(a) else column("v")
    return out


def from_local(spark, a: np.ndarray) -> DataFrame:
    i, j = np.divmod(np.arange(a.size), a.shape[1])
    flat = a.ravel()
    if np.iscomplexobj(a):
        return spark.createDataFrame(pa.table({"i": i, "j": j, "re": flat.real.copy(), "im": flat.imag.copy()}))
    return spark.createDataFrame(pa.table({"i": i, "j": j, "v": flat}))
