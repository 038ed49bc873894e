"""Clustering and codes of vectors against plain code, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest

from gridfactor.llm import heap_clusters, vector_codes
from gridfactor.llm.common import squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, distance string, id int"


def table_of(spark, rows):
    """Columns named as the operators' own are there too."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1) for i, v, label in rows], SCHEMA)


def odd_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims)) / 4
    rows = [(int(k), (centres[k % 5] + rng.normal(size=dims) / 40).astype(np.float32).tolist(), int(k % 3) if k % 7 else None) for k in range(n)]
    bad = [0.0] * dims
    rows += [(1000, None, 1), (1001, [*bad[:-1], None], 1), (1002, [*bad[:-1], math.nan], 1), (1003, [*bad[:-1], math.inf], None), (1004, [], 2), (1005, [1.0] * (dims + 16), 2)]
    rows += [(None, rows[3][1], 1), (5, rows[5][1], rows[5][2]), (7, rows[9][1], 2), *[(2000 + k, rows[0][1], 0) for k in range(40)]]
    return rows


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_clusters(rows, dims, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if finite(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:8]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        new = []
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c[k])
        c = new
    out = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    inertia = [sum(d for _, k, d in out if k == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, k, d, inertia[k], sum(inertia), digest[k]) for i, k, d in out), key=str)


@pytest.mark.parametrize("n", [300, 3])
def test_heap_clusters_are_exact(spark, n):
    rows = odd_rows(n, 64, n) if n > 10 else odd_rows(300, 64, 1)[:n]
    got = heap_clusters.op11_heap_bounds(table_of(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, 64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_heap_clusters_empty(spark):
    assert heap_clusters.op11_heap_bounds(table_of(spark, [(1, None, 0), (2, [1.0], 0)])).collect() == []


def test_heaps_spare_most_vectors(spark):
    """Well separated clusters: after the first rounds, hardly a gap expires; with heaps that never hold a gap, the result is the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    rows = [(k, (centres[k % 8] + rng.normal(size=64) / 50).astype(np.float32).tolist(), 0) for k in range(2000)]
    found = heap_clusters.heap_clusters(table_of(spark, rows))
    assert found.scanned[0] == 2000 and sum(found.scanned[5:]) < 2000
    assert sorted((r.id, r.cluster, r.distance) for r in found.rows.collect()) == [x[:3] for x in sorted(brute_clusters(rows, 64))]


def test_gaps_expire_by_accumulated_drift():
    """A popped vector is one that could have a new nearest centroid: none other changes, whatever the centroids do."""
    rng = np.random.default_rng(4)
    x, c = rng.integers(-99, 99, (500, 6)), rng.integers(-99, 99, (4, 6))
    heaps, _, _, _ = heap_clusters.rescanned(x, None, c, np.zeros(4))
    drift = np.zeros(4)
    for _ in range(12):
        new = c + rng.integers(-3, 4, c.shape) * rng.integers(0, 2, (4, 1))
        drift, c = heap_clusters.accumulated(drift, c, new), new
        heaps, n, s, seen = heap_clusters.rescanned(x, heaps, c, drift)
        assert (heaps.clusters() == squared_distances(x, c).argmin(1)).all() and seen < 500
        for k in range(4):  # each heap is one
            h = heaps.of(k)
            assert all(h[(j - 1) // 2][0] <= h[j][0] for j in range(1, len(h)))


def test_large_integers_stay_exact():
    rng = np.random.default_rng(5)
    x, y = rng.integers(-(1 << 27), 1 << 27, (20, 9)), rng.integers(-(1 << 27), 1 << 27, (3, 9))
    assert squared_distances(x, y).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in y] for v in x]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        heap_clusters.op11_heap_bounds(table_of(spark, [(1, [1e30] * 64, 0)])).collect()


def brute_codes(rows, dims, rounds=2):
    every = [(i, v, label) for i, v, label in rows if finite(v)]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in every if len(v) == dims]
    w, order = dims // 16, sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda v, u: sum((a - b) ** 2 for a, b in zip(v, u))
    books = [[part(v, p) for _, v, _ in order[:64]] for p in range(16)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(16)] for _, v, _ in kept]
        for p in range(16):
            moved = []
            for e, old in enumerate(books[p]):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == e]
                moved.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
            books[p] = moved
    out = []
    for i, v, label in kept:
        code = [near(v, p) for p in range(16)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][c]) for p, c in enumerate(code)), label))
    out += [(i, None, None, label) for i, v, label in every if len(v) != dims]
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + (error or 0)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize("n", [200, 4])
def test_codes_are_exact(spark, n):
    rows = odd_rows(200, 32, 7)
    rows = rows if n > 10 else rows[:n]
    got = vector_codes.op12_equal_average(table_of(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 32)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_by_salted_join(spark, monkeypatch):
    monkeypatch.setattr("gridfactor.llm.common.BROADCAST_ROWS", 0)
    rows = odd_rows(200, 32, 8)
    assert sorted((tuple(r) for r in vector_codes.op12_equal_average(table_of(spark, rows)).collect()), key=str) == brute_codes(rows, 32)


def test_codes_without_vectors(spark):
    assert vector_codes.op12_equal_average(table_of(spark, [(1, None, 0)])).collect() == []
    assert [tuple(r)[:4] for r in vector_codes.op12_equal_average(table_of(spark, [(1, [1.0] * 5, 0)])).collect()] == [(1, None, None, None)]


@pytest.mark.parametrize("spread", [3, 50, 2000])
def test_equal_average_search(spread):
    """The lower index of equal distances, and fewer distances than all."""
    rng = np.random.default_rng(spread)
    entries, parts = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (1500, 4))
    entries[10], entries[50] = entries[40], entries[3]
    code, best, computed = vector_codes.Codebook(entries).nearest(parts)
    d = squared_distances(parts, entries)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and (computed < d.size * 0.8 or spread == 3)
