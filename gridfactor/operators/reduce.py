"""Reductions: sums, extremes with ties, norms, weighted means, checks, and windows over neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmin(key: str, value: Column) -> Column:
    """The key with the least value, the least key of several."""
    return F.min(F.struct(value.alias("x"), F.col(key).alias("k")))["k"]


def argmax(key: str, value: Column) -> Column:
    """The key with the largest value, the least key of several."""
    return -F.max(F.struct(value.alias("x"), (-F.col(key)).alias("k")))["k"]


def normed_difference(both: DataFrame, a: str, b: str) -> DataFrame:
    """The Euclidean norm of a - b, scaled by their largest moduli against overflow; 0 if all are 0."""
    scale = both.agg((F.max(F.abs(a)) + F.max(F.abs(b))).alias("scale"))
    rows = both.join(F.broadcast(scale))  # one row
    return rows.agg(F.coalesce(F.max("scale") * F.sqrt(F.sum(F.pow(F.try_divide(F.col(a) - F.col(b), F.col("scale")), 2))), F.lit(0.0)).alias("norm"))


def all_zero(a: DataFrame, value: str, threshold: float = 1e-12) -> DataFrame:
    return a.agg(F.coalesce(F.bool_and(F.abs(value) <= threshold), F.lit(True)).alias("is_zero"))


def percent_changed(both: DataFrame, a: str, b: str) -> DataFrame:
    return both.agg((100.0 * F.count_if(F.col(a) != F.col(b)) / F.count("*")).alias("percent"))


def density(phi: DataFrame, occupied: int | None = None) -> DataFrame:
    """(g, w): the sum of the orbitals' square moduli at each point, of all or the first so many orbitals."""
    rows = phi if occupied is None else phi.where(F.col("j") < occupied)
    return rows.groupBy(F.col("i").alias("g")).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("w"))


def density_of_rows(rows: DataFrame, occupied: int | None = None) -> DataFrame:
    """(g, w): the same of row-arrays (g, re, im), without a shuffle."""
    squares = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    squares = squares if occupied is None else F.slice(squares, 1, occupied)
    return rows.select("g", F.aggregate(squares, F.lit(0.0), lambda a, b: a + b).alias("w"))


def hermiticity(h: DataFrame) -> DataFrame:
    """The largest modulus of H - H^H."""
    other = h.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    return h.join(other, ["i", "j"]).agg(F.max(F.hypot(F.col("re") - F.col("re2"), F.col("im") + F.col("im2"))).alias("worst"))


def axis_counts(points: DataFrame, axes: list[str], places: int = 8) -> DataFrame:
    """The number of distinct coordinates along each axis."""
    return points.agg(*[F.count_distinct(F.round(a, places) + F.lit(0.0)).alias(a) for a in axes])


def duplicates(indices: DataFrame) -> DataFrame:
    """Indices that occur more than once."""
    return indices.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")


def near_degenerate(levels: DataFrame, energy: str, ties: list[str], threshold: float, group: list[str]) -> DataFrame:
    """Marks levels that are nearer than the threshold to the next or the one before, in order of energy inside each group."""
    w = Window.partitionBy(*group).orderBy(energy, *ties)
    e = F.col(energy)
    near = lambda x: F.coalesce(F.abs(x - e) < threshold, F.lit(False))
    return levels.withColumn("degenerate", near(F.lead(energy).over(w)) | near(F.lag(energy).over(w)))


def offsets(counts: DataFrame, by: str, n: str, group: list[str]) -> DataFrame:
    """Exclusive prefix sums: where each part begins."""
    w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(w), F.lit(0)))


def sampled(points: DataFrame, n: int, seed: int) -> DataFrame:
    """n points without replacement, the same for the same seed, in ascending order (g)."""
    key = F.pmod(F.col("g") * 7919 + seed, F.lit(100003))
    return points.select("g", key.alias("key")).orderBy("key", "g").limit(n).select("g")
