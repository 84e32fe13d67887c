"""The registered model queries run at the full sizes of their operators."""

import inspect

from rankloom.operators import boosting, bootstrap, ranker
from rankloom.plans import ranking


def spied(monkeypatch, owner, name, instead):
    """Notes the arguments of every call of a function and calls ``instead``."""
    shape, seen = inspect.signature(getattr(owner, name)), []

    def call(*args, **named):
        given = shape.bind(*args, **named)
        given.apply_defaults()
        seen.append(given.arguments)
        return instead(given.arguments)

    monkeypatch.setattr(owner, name, call)
    return seen


def test_trees_and_repeats(spark, monkeypatch):
    every = list(dict.fromkeys((*ranker.WITH_CATEGORY, *ranker.WITH_AGE)))
    values = [f"cast((id * {i + 3}) % 7 as double) {f}" for i, f in enumerate(every)]
    few = spark.range(60).selectExpr("id div 6 impression_id", "id % 6 pos", "cast(id % 3 = 0 as int) label", *values)
    monkeypatch.setattr(ranking, "_fit_and_test", lambda *_, **__: (few, few))
    fits = spied(monkeypatch, boosting, "fit", lambda a: boosting.Model(a["features"], 0.0))
    shuffles = spied(monkeypatch, ranker, "permutation_importance", lambda a: few.selectExpr("'a' feature", "0.0 importance"))
    for query in (ranking.gbt_scores, ranking.importance, ranking.feature_ablation, ranking.count_ablation, ranking.gap_aware):
        query(spark, "").collect()
    assert [a["iterations"] for a in fits] == [300] * 12 and {a["leaves"] for a in fits} == {31} and {a["rate"] for a in fits} == {0.08}
    assert [a["repeats"] for a in shuffles] == [3]
    assert {a["features"] for a in fits if len(a["features"]) == 10} == {ranker.WITH_CATEGORY, ranker.WITH_AGE}


def test_replicates(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_models", lambda *_: spark.createDataFrame([("a", i, i / 9) for i in range(9)], "model string, impression_id long, auc double"))
    seen = spied(monkeypatch, bootstrap, "poisson_intervals", lambda a: a["values"].groupBy("model").agg({"value": "avg"}).selectExpr("model", "`avg(value)` mean", "0.0 lo", "1.0 hi", "9L n"))
    ranking.poisson_ci(spark, "")
    assert [a["iterations"] for a in seen] == [1000]


def test_trees_are_fitted_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "fit", lambda x, y, features, *_, **__: (x, y))
    n = 600_000
    x, y = ranker.fit(spark.range(n).selectExpr("cast(id as double) a", "cast(id % 3 as double) b", "cast(id % 5 = 0 as int) label"), ["a", "b"])
    assert x.shape == (n, 2) and y.sum() == n / 5 and (x[:, 0] % 3 == x[:, 1]).all() and ((x[:, 0] % 5 == 0) == (y > 0)).all()
