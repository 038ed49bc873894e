"""Helpers that several operators share: tables, checkpoints, hashing of words and bytes with NumPy."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import erased, new_folder, scratch, shared_root, stored  # noqa: F401

shared_dir = new_folder

#: Odd multipliers of the polynomial hashes (64 bits, wrapping), and of the finalizer.
BASE_1 = 0x9E3779B97F4A7C15
BASE_2 = 0xD6E8FEB86659FD93
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the files are in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one to three longs that a join may broadcast, if they were counted.
BROADCAST_ROWS = 1 << 20


def counted(df: DataFrame) -> DataFrame:
    """Computed once; marked for a broadcast join if it has no more than BROADCAST_ROWS rows, else joined by shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows joined with `few`, which counted() has marked or not; where it isn't broadcast, each of its rows is sent `salts` times, so that rows of one key are in as many tasks."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


#: Beyond ASCII, a character that F.lower() would change: none other does.
CHANGED_BY_LOWER = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the slower translate() only where lower() would change more."""
    return F.when(text.rlike(CHANGED_BY_LOWER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of separators (a pattern that matches a whole run)."""
    return F.array_remove(F.split(text, separators), "")


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * u64(MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * u64(MIX_2)
    return x ^ (x >> np.uint64(33))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket in 0..buckets-1 for each 64-bit hash.  Up to 2**32 buckets get like shares, though the hashes be the least of several, as anchors and prefixes are."""
    return ((mix(hashes) >> np.uint64(32)) * u64(buckets) >> np.uint64(32)).astype(np.int64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse; kept for the process."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = u64(pow(base, -1, 1 << 64) if inverse else base)
        full = np.full(1 << max(16, int(n - 1).bit_length()), b, np.uint64)
        full[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(full)
    return have[:n]


class SpanHash:
    """Hashes of any spans of a byte array, from one prefix sum of c[i] * base**i."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])
        self.inverse = powers(base, n + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def binary_values(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array, and its n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = column.type in (pa.large_string(), pa.large_binary())
    column = column.cast(pa.large_binary() if large else pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together, a longer text alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1] and so on."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def n_cells(df: DataFrame, text_col: str, cell_mb: int = 4, least: int = 4) -> int:
    """Cells of about cell_mb MB of text each: their number grows with the table, a cell doesn't."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    return max(least, -(-size // (cell_mb << 20)))


def in_cells(df: DataFrame, cells: int, *keys: str) -> DataFrame:
    """Add a column `cell` in 0..cells-1 that depends on the keys' values."""
    return df.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int"))


def finite(vector: str) -> Column:
    """Whether an array is there and all its values are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Integers of vectors stay below this, so that squared distances of up to 128 components fit a long.
LARGEST = 1 << 27


def integers(column, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of lists of `dims` finite values, as longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), dims)
    if x.size and abs(x).max() >= LARGEST:
        raise ValueError(f"a component of {abs(x).max() / scale} is too large for distances in longs")
    return x.astype(np.int64)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and y: as a product of doubles where these are exact, else in longs."""
    largest = max(abs(x).max(initial=0), abs(y).max(initial=0))
    if int(largest) ** 2 * x.shape[1] * 4 < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


class Routes:
    """Messages (kind, bucket, cell, data) between cells and buckets, as many of either as the table has cells.

    A message from each cell to each bucket would be cells * cells rows: with up to `most_rows` they are sent
    so.  Beyond that a sender packs the messages to `width` neighbours, about the root of the number, into one
    row; a task takes such rows of `width` senders and deals them to their targets, one row each.  So there
    are cells * width rows twice, whatever the cells are, and no message is lost.
    """

    COLUMNS = ("kind", "bucket", "cell", "data")
    SCHEMA = "kind int, bucket int, cell int, data binary"

    def __init__(self, cells: int, most_rows: int = 1 << 26):
        self.width = 0 if cells * cells <= most_rows else math.isqrt(cells) + 1

    @staticmethod
    def table(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], list(Routes.COLUMNS))

    def sent(self, messages: pa.Table, to: str) -> pa.Table:
        """A sender's messages, packed by neighbouring targets."""
        if not self.width:
            return messages
        return self._packed(messages, to, [x // self.width for x in messages[to].to_pylist()])

    def routed(self, df: DataFrame, to: str) -> DataFrame:
        """Packed messages dealt to their targets."""
        if not self.width:
            return df
        by = "cell" if to == "bucket" else "bucket"
        deal = lambda t: self._dealt(t, to, by)
        return df.withColumn("part", F.floor(F.col(by) / self.width).cast("int")).groupBy(to, "part").applyInArrow(lambda key, t: deal(t), self.SCHEMA)

    def received(self, messages: pa.Table) -> pa.Table:
        """The messages in a target's rows."""
        return self._unpacked(messages) if self.width else messages

    def _dealt(self, packed: pa.Table, to: str, by: str) -> pa.Table:
        messages = self._unpacked(packed)
        out = self._packed(messages, to, messages[to].to_pylist())
        sender = pa.array([x // self.width for x in packed[by].to_pylist()[:1]] * out.num_rows, pa.int32())
        return out.set_column(out.column_names.index(by), by, sender)

    def _packed(self, messages: pa.Table, to: str, groups: list[int]) -> pa.Table:
        numbers = np.array([messages[c].to_pylist() for c in self.COLUMNS[:3]], np.int64).reshape(3, -1).T
        data, by, place = messages["data"].to_pylist(), defaultdict(list), self.COLUMNS.index(to)
        for k, g in enumerate(groups):
            by[g].append(k)
        rows = []
        for g, of in by.items():
            head = np.concatenate([numbers[of], np.array([[len(data[k])] for k in of], np.int64)], 1)
            row = [0, int(numbers[of[0]][1]), int(numbers[of[0]][2]), np.int64(len(of)).tobytes() + head.tobytes() + b"".join(data[k] for k in of)]
            row[place] = g
            rows.append(tuple(row))
        return self.table(rows)

    def _unpacked(self, messages: pa.Table) -> pa.Table:
        rows = []
        for blob in messages["data"].to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            at = 8 + 32 * n
            for kind, bucket, cell, size in np.frombuffer(blob, np.int64, 4 * n, 8).reshape(n, 4).tolist():
                rows.append((kind, bucket, cell, blob[at : at + size]))
                at += size
        return self.table(rows)
