"""Results per key must not depend on which keys are treated as heavy."""

import pytest
from conftest import rows, t

from rankloom.operators import heavy

SCHEMA = "article int, user bigint, at timestamp_ntz, k string, m string"


def clicks(spark):
    data = [(1, u % 9, t(f"2025-03-01 00:{u:02d}:00"), "x", None) for u in range(40)]
    data += [(2, 5, t("2025-03-01 00:00:00"), "x", "y"), (2, 3, t("2025-03-01 00:00:00"), "x", "y"), (2, 3, t("2025-03-01 00:00:00"), "x", "y")]
    data += [(3, None, t("2025-03-01 00:00:00"), "x", "y"), (None, 3, t("2025-03-01 00:00:00"), "x", "y"), (3, 8, None, "x", "y")]
    return spark.createDataFrame(data, SCHEMA)


def test_first_members(spark):
    df = clicks(spark)
    plain = rows(heavy.first_members(df, "article", "user", "at", 5, keys=[]))
    assert plain == rows(heavy.first_members(df, "article", "user", "at", 5, keys=[1, 2]))
    assert plain == rows(heavy.first_members(df, "article", "user", "at", 5))
    assert [(r[0], r[1]) for r in sorted(plain, key=lambda r: (r[0], r[3]))] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 5)]


def test_key_totals(spark):
    df = clicks(spark)
    plain = rows(heavy.key_totals(df, "article", "user", "at", keys=[]))
    assert plain == rows(heavy.key_totals(df, "article", "user", "at", keys=[1]))
    assert {r[0]: r[1:3] for r in plain} == {1: (40, 9), 2: (3, 2), 3: (2, 1)}


def test_empty(spark):
    none = clicks(spark).limit(0)
    assert heavy.heavy_keys(none, "article") == []
    assert heavy.first_members(none, "article", "user", "at").count() == 0
    assert heavy.key_totals(none, "article", "user", "at").count() == 0


def test_heavy_keys_are_found_and_bounded(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS key")
    assert heavy.heavy_keys(df, "key") == [7]
    assert len(heavy.heavy_keys(spark.range(1000).selectExpr("id % 100 AS key"), "key", 0.01)) <= 100


def test_join_on_skewed_key(spark):
    left = spark.createDataFrame([(1, "a")] * 5 + [(2, "b"), (3, "c"), (None, "d")], "key int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "key int, w int")
    want = rows(left.join(right, "key", "left"))
    assert rows(heavy.join_on_skewed_key(left, right, "key", [1])) == want
    assert rows(heavy.join_on_skewed_key(left, right, "key", [])) == want
    assert rows(heavy.join_on_skewed_key(left, right, "key", [1], "inner")) == rows(left.join(right, "key"))


def test_both_sides_are_split_by_one_list(spark, monkeypatch):
    """Another list at a second look would lose rows; the keys are looked for once."""
    lists = iter([[1], [2]])
    monkeypatch.setattr(heavy, "heavy_keys", lambda *_, **__: next(lists))
    left = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 9), (3, 9), (None, 9)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    got = rows(heavy.join_on_skewed_key(left, right, "k"))
    assert got == rows(left.join(right, "k", "left")) and next(lists) == [2]


def test_share_follows_the_partitions(spark):
    assert heavy.heavy_share(spark) == heavy.HEAVY_SHARE
    spark.conf.set("spark.sql.shuffle.partitions", 2000)
    try:
        assert heavy.heavy_share(spark) == 0.5 / 2000
        df = spark.range(10_000).selectExpr("CASE WHEN id < 100 THEN 7 ELSE id END k")
        assert heavy.heavy_keys(df.coalesce(1), "k") == [7]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    counts = spark.createDataFrame([("a", 500), ("b", 1), (None, 900)], "k string, n long")
    assert heavy.heaviest(counts, "k", "n", 0.3) == ["a"] and heavy.heaviest(counts.limit(0), "k", "n") == []


def test_no_machine_local_checkpoints_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from rankloom.operators import lineage

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="all executors share"):
        lineage.shared_folder(far)
