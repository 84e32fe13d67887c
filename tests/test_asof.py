"""As-of matches and counts against brute force, with and without heavy entities."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows, t

from rankloom.operators import counts
from rankloom.operators.asof_attributes import as_known

START = t("2025-03-01 00:00:00")
VERSIONS = "article int, version_no int, valid_from timestamp_ntz, recorded_time timestamp_ntz, category_str string, premium boolean"


def made(seed):
    r = random.Random(seed)
    at = lambda: START + timedelta(hours=r.randrange(72))
    versions = [(r.randrange(1, 4), r.randrange(1, 6), at(), r.choice([at(), None]), r.choice(["x", "y", None]), r.choice([True, False, None])) for _ in range(40)]
    versions += versions[:5] + [(None, 1, START, START, "x", True), (1, 9, None, START, "x", True)]
    events = [(i, r.choice([1, 2, 3, 4, None]), r.choice([at(), at(), None]), "taken") for i in range(80)]
    return versions, events


def key(v):
    return (v[2], v[3], v[1])


@pytest.mark.parametrize("keys", [[], [1], [1, 2, 3, 4]])
def test_as_known(spark, keys):
    versions, events = made(4)
    v = spark.createDataFrame(versions, VERSIONS)
    e = spark.createDataFrame(events, "id int, article int, at timestamp_ntz, version_no string")
    got = {r["id"]: r for r in as_known(e, v, "article", "at", ["version_no", "premium"], keys=keys).collect()}
    assert len(got) == len(events)
    for i, a, when, _ in events:
        fit = [x for x in versions if a is not None and when is not None and x[0] == a and x[2] and x[3] and x[2] <= when and x[3] <= when]
        best = max(fit, key=key) if fit else None
        assert got[i]["version_no"] == "taken"
        assert got[i]["has_version_no"] == bool(best)
        assert got[i]["known_version_no"] == (best[1] if best else None)
        if best and len({x[5] for x in fit if key(x) == key(best)}) == 1:
            assert got[i]["known_premium"] == best[5]


def test_as_known_without_rows(spark):
    versions, events = made(5)
    v = spark.createDataFrame(versions, VERSIONS)
    e = spark.createDataFrame(events, "id int, article int, at timestamp_ntz, version_no string")
    assert as_known(e.limit(0), v, "article", "at", ["premium"]).count() == 0
    none = as_known(e, v.limit(0), "article", "at", ["premium"])
    assert none.count() == len(events) and none.where("has_premium").count() == 0


@pytest.mark.parametrize("keys", [[], [1, 2]])
def test_asof_counts(spark, keys):
    r = random.Random(6)
    at = lambda: START + timedelta(minutes=10 * r.randrange(700))
    events = [(r.choice([1, 2, None]), r.choice([at(), None]), r.randrange(2)) for _ in range(300)]
    asked = [(i, r.choice([1, 2, 3, None]), at(), r.randrange(2)) for i in range(150)]
    e = spark.createDataFrame(events, "a int, ts timestamp_ntz, label int")
    q = spark.createDataFrame(asked, "id int, a int, ts timestamp_ntz, label int")
    windows = {"all": None, "day": 86_400, "hour": 3_600}
    got = {x["id"]: x for x in counts.asof_counts(e, q, "a", "ts", windows, {"c_": "label", "v_": ""}, keys=keys).collect()}
    assert len(got) == len(asked)
    for i, a, when, _ in asked:
        for name, w in windows.items():
            hit = [x for x in events if a is not None and x[0] == a and x[1] and x[1] < when and (w is None or x[1] >= when - timedelta(seconds=w))]
            assert got[i][f"v_{name}"] == len(hit) and got[i][f"c_{name}"] == sum(x[2] for x in hit), (i, name)


def test_asof_counts_fixture(spark):
    """An article clicked at 0, 1, 2, 30 and 50 hours."""
    noon = t("2024-06-10 12:00:00")
    e = spark.createDataFrame([("A", noon + timedelta(hours=h)) for h in (0, 1, 2, 30, 50)] + [("B", noon + timedelta(hours=5))], "a string, ts timestamp_ntz")
    asked = [(1, "A", noon + timedelta(hours=2.5)), (2, "A", noon), (3, "A", noon + timedelta(microseconds=1)), (4, "A", noon + timedelta(days=365)), (5, "none", noon), (6, "A", noon + timedelta(hours=31))]
    q = spark.createDataFrame(asked, "id int, a string, ts timestamp_ntz")
    got = {r["id"]: r for r in counts.asof_counts(e, q, "a", "ts", {"all": None, "24h": 86_400}).collect()}
    assert [got[i]["n_all"] for i in range(1, 7)] == [3, 0, 1, 5, 0, 4] and got[6]["n_24h"] == 1



def test_rate(spark):
    df = spark.createDataFrame([(500, 2000), (1, 1), (0, 0)], "c int, v int").withColumn("r", counts.rate("c", "v"))
    got = [r["r"] for r in df.collect()]
    assert got[0] > got[1] and got[2] == 0.0


def test_cutoff_is_strict(spark):
    cut = t("2024-06-14 00:00:00")
    data = [("NA", t("2024-06-12 00:00:00"), 1), ("NB", t("2024-06-12 00:00:00"), 0), ("NC", t("2024-06-13 00:00:00"), 1), ("NA", cut, 1), ("ND", t("2024-06-20 00:00:00"), 1)]
    df = spark.createDataFrame(data, "article_id string, ts timestamp_ntz, label int")
    assert rows(counts.popularity(df, cut).select("article_id", "click_count")) == [("NA", 1), ("NC", 1)]
    assert counts.latest_source(df, cut).first()[0] == t("2024-06-13 00:00:00")
    assert counts.latest_source(df.limit(0), cut).first()[0] is None
    counts.assert_no_leak(df, cut)


@pytest.mark.parametrize("keys", [[], ["a", "b"]])
def test_windows_of_any_length(spark, keys):
    r = random.Random(5)
    start = t("2025-03-01 00:00:00")
    at = lambda: start + timedelta(hours=r.randrange(24 * 60))
    events = [(r.choice("abc"), at(), r.randrange(3)) for _ in range(200)]
    asked = [(i, r.choice("abcd"), at()) for i in range(80)]
    windows = {"30d": 30 * 86_400, "36h": 36 * 3600, "1h": 3600, "all": None}
    e = spark.createDataFrame(events, "k string, ts timestamp_ntz, n int")
    got = counts.asof_counts(e, spark.createDataFrame(asked, "id int, k string, ts timestamp_ntz"), "k", "ts", windows, {"sum_": "n", "rows_": ""}, keys).collect()
    assert len(got) == 80
    for row in got:
        for name, seconds in windows.items():
            lo = row["ts"] - timedelta(seconds=seconds) if seconds else datetime.min
            mine = [n for k, x, n in events if k == row["k"] and lo <= x < row["ts"]]
            assert (row[f"sum_{name}"], row[f"rows_{name}"]) == (sum(mine), len(mine))
