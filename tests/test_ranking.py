"""Ranks, metrics, fusion, slices and lists against hand-computed values."""

import math
import random

import pytest
from conftest import rows

from rankloom.operators import beyond_accuracy, ranking

KEY = ("id",)


def slate(spark, *slates):
    data = [(i, p, l, float(s)) for i, (labels, scores) in enumerate(slates) for p, (l, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(data, "id int, pos int, label int, score double")


def metrics(spark, *slates, at=(5, 10, 2)):
    return {r["id"]: r for r in ranking.slate_metrics(slate(spark, *slates), KEY, "score", at=at).collect()}


def test_hand_values(spark):
    m = metrics(
        spark, ([2, 0, 1, 0, 2], [5, 4, 3, 2, 1]), ([1, 0, 0], [9, 1, 0]), ([1, 0, 0], [0, 1, 2]), ([0, 0, 1], [3, 2, 1]), ([0, 0, 0], [1, 2, 3]), ([0, 1, 0], [3, 2, 1]),
        ([1, 0, 1], [3, 2, 1]), ([1, 0], [0.5, 0.5]), ([1, 0, 1, 0, 1, 0], [1, 1, 1, 0, 0, 0]), ([1, 1, 1], [1, 2, 3]),
    )
    assert m[0]["ndcg5"] == pytest.approx(4.66054 / 5.39279, abs=1e-4)
    assert m[1]["ndcg5"] == 1 and m[2]["ndcg5"] == pytest.approx(0.5) and m[3]["ndcg2"] == 0 and m[4]["ndcg5"] == 0
    assert m[5]["mrr"] == 0.5 and m[6]["mrr"] == pytest.approx(2 / 3) and m[6]["mrr_first"] == 1
    assert m[1]["auc"] == 1 and m[2]["auc"] == 0 and m[7]["auc"] == 0.5 and m[8]["auc"] == pytest.approx(2 / 3)
    assert m[9]["auc"] is None and m[4]["auc"] is None and m[4]["mrr_first"] == 0


def test_auc_against_pairs(spark):
    r = random.Random(0)
    slates = [([r.randrange(2) for _ in range(n)], [r.randrange(4) for _ in range(n)]) for n in [r.randrange(2, 12) for _ in range(60)]]
    m = metrics(spark, *slates)
    for i, (labels, scores) in enumerate(slates):
        p, n = [s for l, s in zip(labels, scores) if l], [s for l, s in zip(labels, scores) if not l]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None
        assert m[i]["auc"] == (pytest.approx(want) if want is not None else None)


def test_means_count_both_denominators(spark):
    got = ranking.metric_means(ranking.slate_metrics(slate(spark, ([1, 0], [1, 0]), ([1, 1], [1, 2])), KEY, "score")).first()
    assert (got["n_impressions"], got["n_auc_defined"], got["auc"]) == (2, 1, 1.0)
    assert ranking.metric_means(ranking.slate_metrics(slate(spark), KEY, "score")).first()["auc"] is None


def test_ranks_and_ties(spark):
    df = slate(spark, ([0, 0, 0], [0.5, 0.9, 0.1]), ([0, 0, 0], [1, 1, 1]), ([0, 0, 0, 0], [1, 5, 1, 5]))
    got = {}
    for i, p, r in rows(df.select("id", "pos", ranking.rank(KEY, "score"))):
        got.setdefault(i, []).append((p, r))
    assert [[r for _, r in sorted(got[i])] for i in range(3)] == [[2, 1, 3], [1, 2, 3], [3, 1, 4, 2]]
    assert [(p) for _, p, *_ in rows(ranking.top_k(df.where("id = 1"), KEY, "score", 2))] == [0, 1]


def test_fusion(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 10.0), (0, 1, 3.0, 10.0), (0, 2, 2.0, 30.0)], "id int, pos int, a double, b double")
    got = {p: v for _, p, *_, v in rows(ranking.reciprocal_rank_fusion(df, KEY, ["a", "b"]))}
    assert got[1] == pytest.approx(1 / 61 + 1 / 63) and got[2] == pytest.approx(1 / 62 + 1 / 61)
    assert [r[-1] for r in rows(ranking.weighted_sum(df, KEY, ["a", "b"], [0.7, 0.3]))] == [0.0, 0.7, pytest.approx(0.65)]
    flat = df.selectExpr("id", "pos", "1.0 a", "b")
    assert {r[-1] for r in rows(ranking.weighted_sum(flat, KEY, ["a"], [1.0]))} == {0.0}
    with pytest.raises(ValueError, match="weights"):
        ranking.weighted_sum(df, KEY, ["a"], [1, 2])


@pytest.mark.parametrize("n", [0, 1, 4, 5, 23])
def test_head_items(spark, n):
    r = random.Random(n)
    data = [(i, r.randrange(1, 5)) for i in range(n)]
    got = sorted(x[0] for x in ranking.head_items(spark.createDataFrame(data, "article_id int, click_count long")).collect())
    want = sorted(a for a, _ in sorted(data, key=lambda x: (-x[1], x[0]))[: max(1, n // 5)])
    assert got == want


def test_diversity_novelty_coverage(spark):
    lists = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, None), (3, "?")], "id int, category string")
    got = {r["id"]: r["diversity"] for r in beyond_accuracy.diversity(lists, KEY).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: pytest.approx(4 / 6), 2: 0.0, 3: 0.0}
    counts = spark.createDataFrame([("a", 75), ("b", 25)], "article_id string, click_count long")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "article_id string")
    got = {r["article_id"]: r["novelty"] for r in beyond_accuracy.novelty(items, counts).collect()}
    assert got == {"a": pytest.approx(-math.log2(0.75)), "b": pytest.approx(2), "c": pytest.approx(math.log2(100))}
    assert beyond_accuracy.novelty(items, counts.limit(0)).first()["novelty"] == 0
    shown = spark.createDataFrame([("a",)] * 99 + [("b",)], "article_id string")
    got = beyond_accuracy.coverage_and_gini(shown, 10).first()
    assert got["coverage"] == 0.2 and got["gini"] == pytest.approx(0.49)
    assert beyond_accuracy.coverage_and_gini(items, 3).first()["gini"] == pytest.approx(0)
    assert beyond_accuracy.coverage_and_gini(items.limit(0), 0).first()["gini"] == 0
    assert beyond_accuracy.candidate_coverage(items, counts).first()["coverage"] == pytest.approx(2 / 3)
    assert beyond_accuracy.candidate_coverage(items.limit(0), counts).first()["coverage"] == 0
