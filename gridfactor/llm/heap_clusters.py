"""Lloyd's clustering with heap-ordered bounds, on exact integers.

Vectors are written once as blocks of a few thousand, in a table bucketed by block.  Beside it goes a small
state for each block: per cluster a heap of gaps.  A vector's gap is a lower bound of the distance to the
second-nearest centroid less an upper bound of that to its own; when centroids move, the gap of all vectors of
cluster c falls by at most c's drift and the largest drift of another.  So a gap is kept with the drift
accumulated up to then added to it, and a heap needs no change until its top is at most the accumulated
drift: only such vectors are popped, compared with all centroids again, and pushed with their new gap.  Sums
of clusters change only by vectors that change cluster, so a round returns differences.

A round joins the blocks with their states (the table's buckets are kept, so only the states are shuffled), and
the driver holds centroids and sums, k x components each.  Gaps are rounded down and drifts up, and a tie has
the gap 0, so results are those of comparing all vectors with all centroids in each round.

Nulls, odd rows: vectors that are null, of another length, or hold a null or a non-finite component are left
out.  A null id hashes last; rows that share an id are rows of their own, in the order of their vectors.
Fewer rows than centroids give as many centroids as rows, and an empty table an empty result.  Components
that don't fit 27 bits after scaling are an error: a squared distance wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import erased, finite, integers, shared_dir, squared_distances

#: Vectors of a block at most, and the bytes of vectors that a bucket has about.
BLOCK, BUCKET_BYTES = 4096, 64 << 20
#: Relative errors of square roots and of their few sums stay below this.
SLACK = 1e-12


@dataclass
class Clusters:
    rows: DataFrame  # id, cluster, distance
    centroids: np.ndarray
    inertia: list[int]  # by cluster
    scanned: list[int]  # vectors compared with all centroids, by round


class Heaps:
    """A block's heaps as flat arrays: keys and members, cluster after cluster, each in heap order."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, sizes: np.ndarray):
        self.keys, self.members, self.sizes = keys, members, sizes
        self.ends = np.cumsum(sizes)

    @staticmethod
    def empty(k: int) -> Heaps:
        return Heaps(np.zeros(0), np.zeros(0, np.int32), np.zeros(k, np.int32))

    def of(self, c: int) -> list[tuple[float, int]]:
        a, b = self.ends[c] - self.sizes[c], self.ends[c]
        return list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist()))

    def top(self, c: int) -> float:
        return self.keys[self.ends[c] - self.sizes[c]] if self.sizes[c] else np.inf

    def clusters(self) -> np.ndarray:
        """Each member's cluster."""
        out = np.zeros(len(self.members), np.int32)
        out[self.members] = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        return out

    @staticmethod
    def joined(heaps: list[list[tuple[float, int]]]) -> Heaps:
        every = [x for h in heaps for x in h]
        return Heaps(np.array([x[0] for x in every], np.float64), np.array([x[1] for x in every], np.int32), np.array([len(h) for h in heaps], np.int32))


def gaps(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller number of several), and how much farther the second is, rounded down."""
    near = distances.argmin(1)
    if distances.shape[1] == 1:
        return near, np.full(len(near), np.inf)
    two = np.sqrt(np.partition(distances, 1, axis=1)[:, :2].astype(np.float64))
    return near, (two[:, 1] - two[:, 0]) - SLACK * (two[:, 1] + two[:, 0])


def popped(heaps: Heaps, drift: np.ndarray) -> tuple[list[list[tuple[float, int]] | None], list[int], list[int]]:
    """Pops from each heap what is at most the cluster's accumulated drift: the heaps that were opened, the members, and their clusters."""
    opened: list[list[tuple[float, int]] | None] = [None] * len(drift)
    members, before = [], []
    for c, limit in enumerate(drift.tolist()):
        if heaps.top(c) <= limit:
            h = opened[c] = heaps.of(c)
            while h and h[0][0] <= limit:
                members.append(heapq.heappop(h)[1])
                before.append(c)
    return opened, members, before


def rescanned(x: np.ndarray, heaps: Heaps | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, int]:
    """One block's round: the new heaps, the changes of the clusters' counts and sums, and the number of vectors compared."""
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    if heaps is None:
        opened: list = [[] for _ in range(k)]
        heaps, members, before = Heaps.empty(k), list(range(len(x))), []
    else:
        opened, members, before = popped(heaps, drift)
    if not members:
        return heaps, counts, sums, 0
    near, gap = gaps(squared_distances(x[members], centroids))
    for c, m, key in zip(near.tolist(), members, (gap + drift[near]).tolist()):
        if opened[c] is None:
            opened[c] = heaps.of(c)
        heapq.heappush(opened[c], (key, m))
    at = np.array(members)
    old = np.array(before, np.int64)
    moved = near != old if len(old) else np.ones(len(at), bool)
    np.add.at(counts, near[moved], 1)
    np.add.at(sums, near[moved], x[at[moved]])
    if len(old):
        np.subtract.at(counts, old[moved], 1)
        np.subtract.at(sums, old[moved], x[at[moved]])
    return Heaps.joined([heaps.of(c) if h is None else h for c, h in enumerate(opened)]), counts, sums, len(members)


def accumulated(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each cluster's drift so far and the last step's: its own and the largest of another, rounded up."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    order = np.sort(step)
    other = np.where(step == order[-1], order[-2] if len(order) > 1 else 0.0, order[-1])
    return (drift + step + other) * (1 + SLACK)


def _blocks(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = integers(part["v"], dims, scale)
                kind = np.int16 if abs(x).max() < 1 << 15 else np.int32
                block = (part["part"][0].as_py() << 33) + number
                number += 1
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part["id"])
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([x.astype(kind).tobytes()])], ["block", "ids", "data"])

    return run


def _vectors(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dims else np.int32).reshape(n, dims).astype(np.int64)


def heap_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Clusters of floor(scale * component): the k vectors least in sha256 of salt and id start, `rounds` times all are assigned and centroids become floor(sum / count), then all are assigned once more."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite("v") & (F.size("v") == dims))
    least = sha(F.concat(F.lit(salt), F.col("id").cast("string")))
    first = kept.orderBy(least.asc_nulls_last(), F.col("id").asc_nulls_last(), "v").limit(k).toArrow()
    size = kept.count()
    schema = f"id {dict(kept.dtypes)['id']}, cluster int, distance long"
    if not size:
        return Clusters(spark.createDataFrame([], schema), np.zeros((0, dims), np.int64), [], [])
    centroids = integers(first["v"], dims, scale)
    k = len(centroids)

    folder, name = shared_dir(spark), f"blocks_{uuid.uuid4().hex}"
    buckets = max(spark.sparkContext.defaultParallelism, -(-size * dims * 2 // BUCKET_BYTES))
    blocks = kept.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_blocks(dims, scale), f"block long, ids array<{dict(kept.dtypes)['id']}>, data binary")
    blocks.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", f"{folder}/blocks").option("compression", "zstd").saveAsTable(name)
    table, state = spark.table(name), None
    drift, counts, sums, scanned = np.zeros(k), np.zeros(k, np.int64), np.zeros((k, dims), np.int64), []

    def turn(last: bool):
        at, moved, first_turn = centroids, drift, state is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    cell = lambda c: batch[c][r].as_py()  # noqa: B023, E731
                    x = _vectors(cell("data"), cell("n"), dims)
                    heaps = None if first_turn else Heaps(np.frombuffer(cell("keys")), np.frombuffer(cell("members"), np.int32), np.frombuffer(cell("sizes"), np.int32))
                    heaps, n, s, seen = rescanned(x, heaps, at, moved)
                    if last:
                        c = heaps.clusters()
                        d = ((x - at[c]) ** 2).sum(1)
                        yield pa.RecordBatch.from_arrays([batch["ids"].slice(r, 1).flatten(), pa.array(c), pa.array(d)], ["id", "cluster", "distance"])
                    else:
                        change = np.concatenate([n, s.ravel(), [seen]]).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (cell("block"), heaps.keys.tobytes(), heaps.members.tobytes(), heaps.sizes.tobytes(), change)], ["block", "keys", "members", "sizes", "change"])

        columns = ["block", "data", F.size("ids").alias("n"), *(["ids"] if last else [])]
        rows = table.select(*columns)
        if state is not None:
            rows = rows.join(state.select("block", "keys", "members", "sizes").hint("shuffle_hash"), "block")
        return rows.mapInArrow(run, schema if last else "block long, keys binary, members binary, sizes binary, change binary")

    try:
        for step in range(rounds):
            path = f"{folder}/state{step}"
            new = turn(False)
            new.write.option("compression", "zstd").parquet(path)
            state = spark.read.schema(new.schema).parquet(path)
            change = added(state.select("change"), k * (dims + 1) + 1)
            counts, sums = counts + change[:k], sums + change[k:-1].reshape(k, dims)
            scanned.append(int(change[-1]))
            erased(spark, f"{folder}/state{step - 1}")
            moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            drift, centroids = accumulated(drift, centroids, moved), moved
        path = shared_dir(spark)
        turn(True).write.option("compression", "zstd").parquet(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        erased(spark, folder)
    rows = spark.read.schema(schema).parquet(path)
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    return Clusters(rows, centroids, [inertia.get(c, 0) for c in range(k)], scanned)


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def added(changes: DataFrame, width: int) -> np.ndarray:
    """The sum of all rows' arrays of longs (binary, `width` each): each task adds its own, Spark adds the tasks'."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for blob in batch[0]:
                total += np.frombuffer(blob.as_py(), np.int64)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    out = np.zeros(width, np.int64)
    for r in changes.mapInArrow(partial, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most `width` rows
        out[r.place] = r.n
    return out


def op11_heap_bounds(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = heap_clusters(embeddings)
    each = [(c, n, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, (n, row) in enumerate(zip(found.inertia, found.centroids.tolist()))]
    about = embeddings.sparkSession.createDataFrame(each, "c int, cluster_inertia long, centroid_sha256 string")
    rows = found.rows.join(F.broadcast(about), F.col("cluster") == F.col("c"))  # a row for each cluster
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(found.inertia)).cast("long").alias("inertia"), "centroid_sha256")
