"""Product quantization on exact integers, with equal-average search of the codebooks.

A vector is cut into equal parts, each with a codebook of its own.  Entries are sorted by the sum of their
components.  If sums of a part and an entry differ by s, their squared distance is at least s * s / dimension; so
a search starts at the part's own sum and goes outward on either side, and a side ends where this bound
strictly exceeds the best distance so far (an entry at the bound itself may tie).  Parts are searched in runs of
neighbouring sums, and entries some at a time, of which each part of the run takes those that its own bound allows.

Each pass reads the table, with the codebooks (parts x entries x dimension, the only thing the driver holds) in the
tasks; what is shuffled are each task's sums by entry.

Nulls, odd rows: a vector that is null, or holds a null or a non-finite component, is left out.  The vectors'
length is that of the smallest id whose length is a positive multiple of the parts; rows of another length keep
their place in the result, with a null code and a null error.  Null ids come last; rows that share an id are rows
of their own.  Fewer rows than entries give smaller codebooks, and an empty table an empty result.
Components that don't fit 27 bits after scaling are an error: a squared distance wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, finite, integers, spread_join, squared_distances, stored

#: Parts of a run, and entries that are compared at a time.
RUN, STRIDE = 1024, 8


class Codebook:
    """Entries of one part position, in the order of their sums."""

    def __init__(self, entries: np.ndarray):
        self.order = np.argsort(entries.sum(1), kind="stable")
        self.entries = entries[self.order]
        self.sums = self.entries.sum(1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part (the lower index of several), its squared distance, and how many distances were computed."""
        sums = parts.sum(1)
        by_sum = np.argsort(sums, kind="stable")
        code, best, computed = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for a in range(0, len(parts), RUN):
            rows = by_sum[a : a + RUN]
            code[rows], best[rows], n = self._run(parts[rows], sums[rows])
            computed += n
        return code, best, computed

    def _run(self, x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(self.sums)
        code, best = np.full(len(x), n, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        start = int(np.searchsorted(self.sums, sums[len(sums) // 2]))
        low, high, computed = start, start, 0
        below = above = np.arange(len(x))  # parts whose side is still open
        while len(below) or len(above):
            if len(above):
                above, high, m = self._side(x, sums, code, best, above, high, min(n, high + STRIDE), up=True)
                computed += m
            if len(below):
                below, low, m = self._side(x, sums, code, best, below, max(0, low - STRIDE), low, up=False)
                computed += m
        return code, best, computed

    def _side(self, x, sums, code, best, open_, a: int, b: int, up: bool):
        """Compares the open parts with entries a..b-1, outward to the right (up) or left; the parts that stay open, the new end, and the number of distances."""
        if a >= b:
            return open_[:0], b if up else a, 0
        gap, dim = self.sums[a if up else b - 1] - sums[open_], x.shape[1]
        outward = gap > 0 if up else gap < 0  # entries that a run's start has on the wrong side of a part are no end of it
        open_ = open_[~(outward & (gap.astype(np.float64) ** 2 > dim * best[open_].astype(np.float64) * (1 + 1e-12)))]
        if len(open_):
            d = squared_distances(x[open_], self.entries[a:b])
            index = self.order[a:b]
            least = d.min(1)
            which = np.where(d == least[:, None], index, len(self.sums)).min(1)
            take = (least < best[open_]) | ((least == best[open_]) & (which < code[open_]))
            best[open_[take]], code[open_[take]] = least[take], which[take]
        return open_, b if up else a, len(open_) * (b - a)


def assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances (rows x parts)."""
    width = x.shape[1] // len(books)
    found = [book.nearest(x[:, p * width : (p + 1) * width])[:2] for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


@dataclass
class Codes:
    rows: DataFrame  # id, label, code, error
    codebooks: np.ndarray  # parts x entries x dimension


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of floor(scale * component), by codebooks that start as the parts of the smallest ids and are moved to floor(sum / count) `rounds` times."""
    if entries > 256:
        raise ValueError("an index has two hex digits: 256 entries at most")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite("v"))
    kinds = dict(kept.dtypes)
    by_id = (F.col("id").asc_nulls_last(), "v")
    one = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*by_id).select(F.size("v").alias("n")).first()
    dims = one.n if one else 0
    whole = kept.where(F.size("v") == dims) if one else kept.limit(0)
    odd = (kept.where(F.size("v") != dims) if one else kept).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not one:
        return Codes(odd, np.zeros((parts, 0, 0), np.int64))
    start = integers(whole.orderBy(*by_id).limit(entries).select("v").toArrow()["v"], dims, scale)
    width = dims // parts
    codebooks = start.reshape(len(start), parts, width).transpose(1, 0, 2)

    def summed(codebooks: np.ndarray) -> np.ndarray:
        """Counts and sums (parts x entries x (1 + width)) of the assignment to these entries."""
        k = codebooks.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, total = [Codebook(b) for b in codebooks], np.zeros((parts * k, 1 + width), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = integers(batch["v"], dims, scale)
                    flat = (assigned(x, books)[0] + np.arange(parts) * k).ravel()
                    with_one = np.concatenate([np.ones((len(flat), 1), np.int64), x.reshape(-1, width)], 1)
                    order = np.argsort(flat, kind="stable")
                    cut = np.flatnonzero(np.diff(flat[order], prepend=-1))
                    total[flat[order][cut]] += np.add.reduceat(with_one[order], cut)
            flat = total.ravel()
            place = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], ["place", "n"])

        out = np.zeros(parts * k * (1 + width), np.int64)
        sums = whole.select("v").mapInArrow(partial, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        found = sums.toArrow()  # at most parts x entries x (1 + width) rows
        out[found["place"].to_numpy()] = found["n"].to_numpy()
        return out.reshape(parts, k, 1 + width)

    for _ in range(rounds):
        total = summed(codebooks)
        counts = total[..., :1]
        codebooks = np.where(counts > 0, total[..., 1:] // np.maximum(counts, 1), codebooks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        for batch in batches:
            if batch.num_rows:
                code, far = assigned(integers(batch["v"], dims, scale), books)
                text = code.astype(np.uint8).tobytes().hex()
                rows = pa.array([text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], rows, pa.array(far.sum(1))], ["id", "label", "code", "error"])

    rows = whole.select("id", "label", "v").mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return Codes(rows.unionByName(odd), codebooks)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows(id, label, code, error) with `label_error`, the errors of equal labels (nulls together) added up."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"))
    sums = checkpointed(rows.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error")))
    return spread_join(rows.withColumn("key", key), sums, "key").drop("key")


def op12_equal_average(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found = vector_codes(embeddings)
    digest = hashlib.sha256(",".join(map(str, found.codebooks.ravel().tolist())).encode()).hexdigest()
    rows = with_label_errors(stored(found.rows))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
