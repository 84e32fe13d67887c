"""Vector operators against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.vectors import dot, norm, normalised
from rankloom.operators import ranker, vectors


def units(spark, x):
    return vectors.unit_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "a int, v array<float>"), "a", "v", x.shape[1])


def test_expressions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "x array<float>, z array<float>").select(normalised(F.col("x")), normalised(F.col("z")), norm(F.col("x")), dot(F.col("x"), F.col("z"))).first()
    assert (r[0], r[1], r[2], r[3]) == ([0.6, 0.8], [0.0, 0.0], 5.0, 0.0)


def test_unusable_vectors(spark):
    data = [(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, []), (None, [1.0, 1.0]), (8, [float("inf"), 0.0])]
    got = vectors.unit_vectors(spark.createDataFrame(data, "a int, v array<float>"), "a", "v", 2).collect()
    assert [(r["id"], r["v"]) for r in got] == [(1, [0.6, 0.8])]


@pytest.mark.parametrize("block", [100_000, 7])
@pytest.mark.parametrize("tau", [None, 1.0])
def test_pooled(spark, tau, block, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5)).astype(np.float32)
    lists = {u: [int(i) for i in rng.integers(0, 35, rng.integers(0, 9))] for u in range(12)}
    h = spark.createDataFrame([(u, a) for u, a in lists.items()] + [(99, None)], "u int, article_ids array<int>")
    got = {r["u"]: np.array(r["v"]) for r in vectors.pooled(h, units(spark, x), "u", 5, tau).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for u, a in lists.items():
        known = [i for i in a if i < 30]
        s = sum((np.exp(-(len(known) - 1 - p) / tau) if tau else 1.0) * unit[i] for p, i in enumerate(known))
        assert (u in got) == any(i < 30 for i in a)
        if u in got:
            assert np.allclose(got[u], s / np.linalg.norm(s), atol=1e-6)


def test_unknown_articles_do_not_age_the_others(spark):
    x = np.eye(3, dtype=np.float32)
    h = spark.createDataFrame([(1, [0, 77, 77, None, 1])], "u int, article_ids array<int>")
    r = vectors.pooled(h, units(spark, x), "u", 3, 1.0).first()
    assert r["n"] == 2 and r["v"][0] / r["v"][1] == pytest.approx(np.exp(-1))


def test_coverage(spark):
    x = np.eye(3, dtype=np.float32)
    corpus = spark.createDataFrame([(0,), (0,), (2,), (9,), (None,)], "article_id int")
    kept, figures = vectors.covered(units(spark, x), corpus)
    assert sorted(r["id"] for r in kept.collect()) == [0, 2] and tuple(figures.first()) == (3, 2, pytest.approx(2 / 3))
    assert vectors.covered(units(spark, x), corpus.limit(0))[1].first()["coverage"] == 0


@pytest.mark.parametrize("block", [100_000, 30])
def test_searches(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", block)
    monkeypatch.setattr(vectors, "LIST_BLOCK", block)
    x = np.random.default_rng(0).normal(size=(200, 16)).astype(np.float32)
    u = units(spark, x)
    asked = u.where("id < 20").select(F.col("id").alias("query"), "v")
    flat = vectors.flat_search(asked.unionByName(spark.createDataFrame([(777, None)], "query int, v array<double>")), u, 16, 3).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(unit[:20] @ unit.T), axis=1, kind="stable")[:, :3]
    assert {(r["query"], r["place"]): r["id"] for r in flat} == {(q, p + 1): int(best[q, p]) for q in range(20) for p in range(3)}
    lists, centres = vectors.ivf_lists(u)
    every = {(r["query"], r["place"]): r["id"] for r in vectors.ivf_search(asked, lists, centres, 3, nprobe=99).collect()}
    assert every == {(r["query"], r["place"]): r["id"] for r in flat}  # all lists probed: exact
    few = {(r["query"], r["id"]) for r in vectors.ivf_search(asked, lists, centres, 3, nprobe=3).collect()}
    assert len(few & {(r["query"], r["id"]) for r in flat}) >= 40
    assert vectors.flat_search(asked, u.limit(0), 16, 3).count() == 0


@pytest.mark.parametrize("block", [100_000, 7])
def test_slate_cosine(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", block)
    x = np.random.default_rng(1).normal(size=(20, 4)).astype(np.float32)
    u = units(spark, x)
    readers = u.where("id < 3").select(F.col("id").alias("u"), "v")
    pairs = spark.createDataFrame([(a, b) for a in (0, 1, 2, 9) for b in (0, 5, 19, 77)] * 2 + [(None, 1)], "u int, article_id int")
    got = {(r["u"], r["article_id"]): r["cosine"] for r in vectors.slate_cosine(pairs, readers, u, "u", 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 16
    for (a, b), c in got.items():
        assert c == pytest.approx(float(unit[a] @ unit[b]) if a < 3 and b < 20 else 0.0, abs=1e-6)


def test_latent_vectors(spark):
    texts = ["football match goal striker", "goal striker football league", "election vote parliament law", "parliament law vote minister", "guitar concert song stage", "song stage guitar album", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got, explained = vectors.latent_vectors(df, "id", F.col("text"), components=3)
    v = {r["id"]: np.array(r["v"]) for r in got.collect()}
    assert 0 < explained <= 1 + 1e-9 and np.linalg.norm(v[6]) == 0
    assert v[0] @ v[1] > v[0] @ v[2] and v[2] @ v[3] > v[2] @ v[4] and v[4] @ v[5] > v[4] @ v[0]


def test_ranker(spark):
    rng = np.random.default_rng(0)
    a, noise = rng.random(400), rng.random(400)
    df = spark.createDataFrame([(i // 8, i % 8, float(x), float(z), int(x > 0.6)) for i, (x, z) in enumerate(zip(a, noise))], "id int, pos int, a double, noise double, label int")
    model = ranker.fit(df, ["a", "noise"], iterations=20)
    scored = ranker.score(model, df, ["a", "noise"])
    assert ranker.area(scored, "gbt") > 0.95 and scored.columns == [*df.columns, "gbt"]
    loss = {r["feature"]: r["importance"] for r in ranker.permutation_importance(model, df, ["a", "noise"]).collect()}
    assert loss["a"] > 0.2 > abs(loss["noise"])
    first, rest = ranker.file_order_split(df, ["id", "pos"])
    assert first.count() == 280 and rest.agg(F.min("id")).first()[0] == 35
    both = ranker.compare_features({"a": (df, df, ["a"]), "noise": (df, df, ["noise"]), "same": (df, df, ["a"])}, ["id"], iterations=20)
    assert {r["variant"]: r["keep"] for r in ranker.kept_features(both, "a").collect()} == {"a": True, "noise": False, "same": True}
    again = ranker.fit(df.repartition(3), ["a", "noise"], iterations=20)
    assert all((x.cut == y.cut).all() for x, y in zip(model.trees, again.trees))  # the order of rows does not matter
    few = ranker.fit(df, ["a"], iterations=3, most_rows=100)
    assert 0 < len(few.trees) <= 3
    assert ranker.score(ranker.fit(df.limit(0), ["a"]), df, ["a"]).where("gbt < 0.001").count() == 400


def test_trees_against_plain_splits():
    """One tree of two leaves cuts where an exhaustive search over all cuts gains most; log-loss falls with more trees."""
    from rankloom.operators import boosting

    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 1] > 0.3) ^ (rng.random(150) < 0.1)).astype(float)
    p = y.mean()
    g, h = p - y, np.full(150, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / h[m].sum()
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(3) for c in np.sort(x[:, j])[boosting.LEAST_ROWS - 1 : -boosting.LEAST_ROWS])
    tree = boosting.fit(x, y, "abc", iterations=1, leaves=2).trees[0]
    assert tree.feature[0] == best[1] and (x[:, best[1]] <= tree.cut[0]).sum() == (x[:, best[1]] <= best[2]).sum()
    low = x[:, best[1]] <= best[2]
    assert tree.predict(x)[low][0] == pytest.approx(-boosting.RATE * g[low].sum() / h[low].sum())
    loss = [-np.mean(np.log(np.where(y > 0, q, 1 - q))) for q in (boosting.fit(x, y, "abc", iterations=i).predict(x) for i in (0, 1, 10, 60))]
    assert loss == sorted(loss, reverse=True)
    flat = boosting.fit(np.zeros((50, 2)), (np.arange(50) % 2).astype(float), "ab", iterations=2)
    assert np.allclose(flat.predict(np.ones((3, 2))), 0.5)


def never(*_, **__):
    raise AssertionError("vectors are shipped")


def packed(spark, x):
    return vectors.packed_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "a int, v array<float>"), "a", "v", x.shape[1])


def shuffled_vectors(df):
    """Exchanges of the plan whose rows hold a vector."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "v#" in line]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_repeated_ids(spark, most, monkeypatch):
    monkeypatch.setattr(vectors, "REPEATED", most)
    data = [(1, [3.0, 4.0]), (2, [0.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0]), (3, [3.0, 4.0]), (4, [1.0, 0.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, "a int, v array<float>")
    assert sorted(tuple(r) for r in vectors.packed_vectors(df, "a", "v", 2).collect()) == [(1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0]), (4, [1.0, 0.0])]
    assert sorted(tuple(r) for r in vectors.unit_vectors(df, "a", "v", 2).collect()) == [(1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [1.0, 0.0])]


def test_vectors_without_repeated_ids_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "a int, v array<float>")
    assert not shuffled_vectors(vectors.unit_vectors(df, "a", "v", 2)) and not shuffled_vectors(vectors.packed_vectors(df, "a", "v", 2))


def test_flat_search_leaves_the_collection_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 30)
    x = np.random.default_rng(2).normal(size=(200, 16)).astype(np.float32)
    u = packed(spark, x)
    few, many = (u.where(f"id < {n}").select(F.col("id").alias("query"), "v") for n in (20, 50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    found = lambda df: {(r["query"], r["place"]): r["id"] for r in df.collect()}
    want = lambda n: {(q, p + 1): int(best[q, p]) for q in range(n) for p in range(3)}
    assert found(vectors.flat_search(many, u, 16, 3)) == want(50)  # more queries than are broadcast
    monkeypatch.setattr(vectors, "meet", never)
    assert found(vectors.flat_search(few, u, 16, 3)) == want(20)


def test_lists_are_searched_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 30)
    monkeypatch.setattr(vectors, "LIST_BLOCK", 30)
    x = np.random.default_rng(3).normal(size=(200, 16)).astype(np.float32)
    u = packed(spark, x)
    few, many = (u.where(f"id < {n}").select(F.col("id").alias("query"), "v") for n in (20, 50))
    lists, centres = vectors.ivf_lists(u, nlist=8)
    found = lambda df: {(r["query"], r["place"]): r["id"] for r in df.collect()}
    exact, shipped = found(vectors.flat_search(few, u, 16, 3)), found(vectors.ivf_search(many, lists, centres, 3, nprobe=2))
    monkeypatch.setattr(vectors, "meet", never)
    assert found(vectors.ivf_search(few, lists, centres, 3, nprobe=99)) == exact
    assert found(vectors.ivf_search(few, lists, centres, 3, nprobe=2)) == {k: v for k, v in shipped.items() if k[0] < 20}


@pytest.mark.parametrize("tau", [None, 1.0])
def test_readers_are_pooled_where_they_lie(spark, tau, monkeypatch):
    x = np.random.default_rng(5).normal(size=(30, 5)).astype(np.float32)
    rng = np.random.default_rng(6)
    h = spark.createDataFrame([(u, [int(i) for i in rng.integers(0, 35, rng.integers(0, 40))]) for u in range(40)] + [(99, None), (98, [77])], "u int, article_ids array<int>")
    found = lambda: {r["u"]: (r["n"], *np.round(r["v"], 9)) for r in vectors.pooled(h, packed(spark, x), "u", 5, tau).collect()}
    want = found()
    assert 30 < len(want) <= 40
    monkeypatch.setattr(vectors, "meet", never)
    for rows, ids in ((7, 2_000_000), (20, 25)):  # rows and ids of a batch; single lists are longer than 25
        monkeypatch.setattr(vectors, "HELD", rows)
        monkeypatch.setattr(vectors, "HELD_IDS", ids)
        assert found() == want


def test_cosines_with_histories(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(30, 5)).astype(np.float32)
    rng = np.random.default_rng(8)
    h = spark.createDataFrame([(u, [int(i) for i in rng.integers(0, 35, 6)]) for u in range(20)] + [(20, None), (21, [77])], "u int, article_ids array<int>")
    slates = [(u, [int(i) for i in rng.integers(0, 35, 9)] + [None]) for u in range(24)] * 2
    lists = spark.createDataFrame([*slates, (None, [1]), (3, None), (4, [])], "u long, candidates array<int>")
    pairs = lists.select("u", F.explode("candidates").alias("article_id"))
    u = units(spark, x)
    want = {(r["u"], r["article_id"]): r["cosine"] for r in vectors.slate_cosine(pairs, vectors.pooled(h, u, "u", 5), u, "u", 5).collect()}
    monkeypatch.setattr(vectors, "meet", never)
    for rows, ids in ((25_000, 2_000_000), (3, 25)):
        monkeypatch.setattr(vectors, "HELD", rows)
        monkeypatch.setattr(vectors, "HELD_IDS", ids)
        got = [tuple(r) for r in vectors.history_cosine(lists, h, packed(spark, x), "u", 5).collect()]
        assert len(got) == len(want) and {r[:2]: pytest.approx(r[2], abs=1e-12) for r in got} == want


def test_features_pool_only_the_readers_of_the_slates(spark, monkeypatch):
    from rankloom.plans import ranking

    monkeypatch.setattr(vectors, "HELD", 100)
    monkeypatch.setattr(vectors, "meet", never)
    got = ranking.features(spark, "/root/testdata/sf0.001", vectors_for="pooled").select("semantic").collect()
    assert len(got) > 100 and any(r[0] != 0 for r in got) and all(abs(r[0]) <= 1 + 1e-9 for r in got)
