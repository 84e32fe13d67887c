"""Nearest vectors against brute force, with copies, dirt and crowded cells."""

import numpy as np
import pytest

from rankloom.llm import nearest as nn


def brute(ids, x, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order}
    return out


def clusters(n, per, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dim))
    return np.concatenate([c + 0.5 * rng.normal(size=(per, dim)) for c in centres]).astype(np.float32) * rng.uniform(0.1, 20, size=(n * per, 1)).astype(np.float32)


def pairs(df):
    return {(r["id"], r["neighbour"]) for r in df.collect()}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "a int, v array<float>")


def test_recall(spark):
    x = clusters(150, 6, 64, 0)
    ids = list(range(len(x)))
    want = brute(ids, x, 5, 0.6)
    got = pairs(nn.nearest(table(spark, ids, x), "a", "v", 64, 5, 0.6, window=60))
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_many_ranges_and_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(nn, "RANGE_RECORDS", 100)
    x = clusters(150, 6, 64, 1)
    ids = list(range(len(x)))
    want = brute(ids, x, 5, 0.6)
    got = pairs(nn.nearest(table(spark, ids, x), "a", "v", 64, 5, 0.6, window=40))
    assert len(got & want) / len(want) > 0.9


def test_dirt(spark):
    good = clusters(4, 3, 8, 2)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(good)]
    dirt = [(100, None), (101, []), (102, [1.0] * 7), (103, [1.0] * 9), (104, [0.0] * 8), (105, [float("nan")] + [1.0] * 7), (106, [float("inf")] + [1.0] * 7), (107, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(data + data[:4] + dirt, "a int, v array<float>")
    assert pairs(nn.nearest(df, "a", "v", 8, 5, 0.5)) == brute(list(range(12)), good, 5, 0.5)


def test_copies(spark):
    """A third of all rows are one vector: every copy has the smallest other ids, found without comparing copies."""
    x = clusters(30, 2, 32, 3)
    same = np.repeat(x[:1], 30, axis=0)
    every = np.concatenate([x, same])
    ids = [int(i) for i in np.random.default_rng(0).permutation(len(every))]
    want = brute(ids, every, 5, 0.6)
    got = pairs(nn.nearest(table(spark, ids, every), "a", "v", 32, 5, 0.6))
    copies = {ids[0], *ids[len(x) :]}
    assert {p for p in got if p[0] in copies} == {p for p in want if p[0] in copies}
    assert len(got & want) / len(want) > 0.97


@pytest.mark.parametrize("n", [0, 1])
def test_few(spark, n):
    assert pairs(nn.nearest(table(spark, [1][:n], np.ones((n, 4))), "a", "v", 4)) == set()


def test_without_broadcast(spark, monkeypatch):
    x = clusters(20, 3, 16, 4)
    want = pairs(nn.nearest(table(spark, range(60), x), "a", "v", 16, 3, 0.5))
    monkeypatch.setattr(nn, "BROADCAST_IDS", 0)
    assert pairs(nn.nearest(table(spark, range(60), x), "a", "v", 16, 3, 0.5)) == want


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (16, 1), (5, 2)])
def test_hilbert_curve(d, bits):
    """Every cell has its own key, and cells with neighbouring keys share a face."""
    n = 1 << (d * bits)
    grid = np.stack(np.unravel_index(np.arange(n), (1 << bits,) * d), axis=1)
    keys = nn.hilbert_keys(grid, bits)
    path = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(n)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packed_vectors_lose_nothing():
    import pyarrow as pa

    x = np.concatenate([np.random.default_rng(0).normal(size=(3, 6)).astype(np.float32), np.random.default_rng(1).normal(size=(3, 6)).astype(np.float16).astype(np.float32)])
    assert (nn._unpack_vectors(pa.array(nn._pack_vectors(x), pa.binary()), 6) == x).all()


def test_packed_records_lose_nothing():
    rng = np.random.default_rng(2)
    r = np.empty(50, nn.RECORD)
    r["key"], r["id"], r["s"] = rng.integers(0, 2**32, 50), rng.integers(-(2**62), 2**62, 50), rng.integers(0, 2**63, (50, nn.WORDS))
    got = nn._unpack_records(nn._pack_records(r))
    assert (np.sort(got, order=["id"]) == np.sort(r, order=["id"])).all() and len(nn._unpack_records(b"")) == 0


def test_exact(spark):
    x = clusters(10, 4, 16, 5)
    want = brute(list(range(40)), x, 3, 0.5)
    assert pairs(nn.nearest_exact(table(spark, range(40), x), "a", "v", 16, 3, 0.5)) == want


def test_ranges_are_placed_by_more_keys(spark, monkeypatch):
    monkeypatch.setattr(nn, "RANGE_RECORDS", 10)
    monkeypatch.setattr(nn, "SAMPLE", 200)
    x = clusters(100, 6, 32, 6)
    want = brute(list(range(600)), x, 5, 0.6)
    got = pairs(nn.nearest(table(spark, range(600), x), "a", "v", 32, 5, 0.6))
    assert len(got & want) / len(want) > 0.8
