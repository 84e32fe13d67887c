"""Ranks, the first principal component and reciprocal worths against NumPy."""

import random

import numpy as np
import pytest

from rankloom.llm import rank_fusion as rf

SCORES = ("a", "b", "c")


def made(spark, seed=0, groups=6):
    r = random.Random(seed)
    data = []
    for g in range(groups):
        for p in range(r.randrange(1, 14)):
            q = r.random()
            data.append((g, p, r.choice([q, round(q, 1), None, float("nan")]), 1000 * q + r.random(), r.choice([-1, int(50 * q), None])))
    data += data[:5] + [(None, 1, 1.0, 1.0, 1), (1, None, 1.0, 1.0, 1)]
    return spark.createDataFrame(data, "g int, p int, a double, b double, c bigint"), data


def ok(name, v):
    return v is not None and v == v and not (name == "c" and v == -1)


def test_ranks(spark):
    df, data = made(spark)
    seen = {(g, p): row for g, p, *row in data if g is not None and p is not None}
    for hot in ([], [0, 3]):
        got = rf.rank_scores(df, "g", "p", SCORES, {"c": -1}, hot=hot, tasks=3).collect()
        assert len(got) == len(seen)
        for r in got:
            for i, s in enumerate(SCORES):
                v = seen[r["grp"], r["pos"]][i]
                peers = [(w[i], p) for (g, p), w in seen.items() if g == r["grp"] and ok(s, w[i])]
                want = 1 + sum(x > v or (x == v and p < r["pos"]) for x, p in peers) if ok(s, v) else None
                assert r[f"rank_{s}"] == want and r[f"have_{s}"] == len(peers)


def test_reciprocal(spark):
    df, _ = made(spark, 1)
    ranks = rf.rank_scores(df, "g", "p", SCORES, {"c": -1}, hot=[])
    by = {(r["grp"], r["pos"]): r for r in ranks.collect()}
    got = rf.fuse_reciprocal(ranks, SCORES).collect()
    for r in got:
        assert r["worth"] == pytest.approx(sum(1 / (60 + x) for s in SCORES if (x := by[r["grp"], r["pos"]][f"rank_{s}"])), abs=1e-10)
    for g in {r["grp"] for r in got}:
        order = sorted((r for r in got if r["grp"] == g), key=lambda r: (-r["worth"], r["pos"]))
        assert [r["place"] for r in order] == list(range(1, len(order) + 1))


def test_first_component(spark):
    df, _ = made(spark, 2, 40)
    rows = rf.percentiles(rf.rank_scores(df, "g", "p", SCORES, {"c": -1}, hot=[]), SCORES)
    fit = rf.principal_direction(rows, [f"u_{s}" for s in SCORES])
    x = np.array([[r[f"u_{s}"] for s in SCORES] for r in rows.collect()])
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    want = vectors[:, -1] * np.sign(vectors[:, -1].sum())
    assert np.allclose(fit["loading"], want, atol=1e-6) and fit["share"] == pytest.approx(values[-1] / 3)
    turned = rf.principal_direction(rows, [f"u_{s}" for s in SCORES], [-1, -1, -1])
    assert np.allclose(turned["loading"], -want, atol=1e-6)
    fused = rf.fuse_principal(rf.rank_scores(df, "g", "p", SCORES, {"c": -1}, hot=[]), SCORES).collect()
    z = {(r["grp"], r["pos"]): float(((np.array([r[f"u_{s}"] for s in SCORES]) - x.mean(0)) / x.std(0)) @ want) for r in rows.collect()}
    assert all(r["projection"] == pytest.approx(z[r["grp"], r["pos"]], abs=1e-6) for r in fused)


def test_no_rows_and_no_spread(spark):
    df, _ = made(spark)
    none = rf.rank_scores(df.limit(0), "g", "p", SCORES)
    assert rf.fuse_principal(none, SCORES).count() == 0 and rf.fuse_reciprocal(none, SCORES).count() == 0
    flat = spark.createDataFrame([(g, 0, 1.0, 1.0, 1) for g in range(3)], "g int, p int, a double, b double, c bigint")
    assert [r["place"] for r in rf.fuse_principal(rf.rank_scores(flat, "g", "p", SCORES), SCORES).collect()] == [1, 1, 1]


def test_lower_is_better(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, 2.0)], "g int, p int, a double")
    assert {r["pos"]: r["rank_a"] for r in rf.rank_scores(df, "g", "p", ["a"], lower_is_better=["a"]).collect()} == {0: 2, 1: 1}
