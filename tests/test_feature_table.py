"""Feature rows, with and without readers treated as heavy."""

import pytest
from conftest import rows, t

from rankloom.operators import feature_table as ft

LOG = "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>"


def log(spark):
    at = [t(f"2025-03-0{d} 10:00:00") for d in range(1, 8)]
    data = [(1, 7, at[0], [1, 2, 2, 9], [2, 5]), (1, 7, at[0], [1, 2, 2, 9], [2, 5]), (0, 7, at[1], [1], None), (2, 7, None, [3], [3]), (3, 8, at[2], [1, None], [1]), (4, 0, at[3], [1], [1]), (5, None, at[3], [1], [1]), (6, 8, at[3], None, [1]), (7, 8, at[4], [], [])]
    return spark.createDataFrame(data, LOG)


def lookup(spark):
    return ft.article_types(spark.createDataFrame([(1, " Sport "), (1, " Sport "), (2, "bil"), (3, " "), (None, "x")], "article_id int, category_str string"))


def test_events(spark):
    got = rows(ft.entity_events(log(spark), lookup(spark), [])[0])
    assert got == rows(ft.entity_events(log(spark), lookup(spark), [7, 8])[0])
    assert {(u, e): n for u, e, n, _ in got} == {(7, "view:sport"): 2, (7, "view:bil"): 1, (7, "view:none"): 2, (7, "click:bil"): 1, (7, "click:none"): 1, (8, "view:sport"): 1, (8, "click:sport"): 1}
    assert {(u, e): x for u, e, _, x in got}[(7, "view:sport")] == t("2025-03-02 10:00:00")


def test_lookup_too_large_to_broadcast(spark, monkeypatch):
    want = rows(ft.entity_events(log(spark), lookup(spark), [])[0])
    monkeypatch.setattr(ft, "BROADCAST_ROWS", 0)
    assert rows(ft.entity_events(log(spark), lookup(spark), [])[0]) == want


def test_wide(spark):
    wide = {r["user_id"]: r for r in ft.wide_rows(ft.entity_events(log(spark), lookup(spark), [])[0], ["view:sport", "click:bil", "view:never"], "2025-03-08 10:00:00").collect()}
    assert wide[7]["view_sport_n"] == 2 and wide[7]["view_sport_days"] == 6.0 and wide[7]["n_all"] == 7 and wide[8]["click_bil_n"] == 0 and wide[8]["view_never_days"] is None


def test_rows_hold_every_type(spark):
    for keys in ([], [7, 8]):
        events = ft.entity_events(log(spark), lookup(spark), keys)[0]
        got = {r["user_id"]: r for r in ft.type_rows(events).collect()}
        assert got[7]["event_types"] == ["click:bil", "click:none", "view:bil", "view:none", "view:sport"] and got[7]["counts"] == [1, 1, 1, 2, 2]
        assert got[7]["last_times"][4] == t("2025-03-02 10:00:00") and got[7]["n_all"] == 7 and got[8]["event_types"] == ["click:sport", "view:sport"]
        flat = [(r["user_id"], *x) for r in got.values() for x in zip(r["event_types"], r["counts"], r["last_times"])]
        assert sorted(flat, key=repr) == rows(events)


def test_empty(spark):
    assert ft.entity_events(log(spark).limit(0), lookup(spark))[0].count() == 0


def test_every_type_has_a_column(spark, monkeypatch):
    types = ft.event_types(lookup(spark))
    assert types == ["click:bil", "click:none", "click:sport", "view:bil", "view:none", "view:sport"]
    assert ft.event_types(lookup(spark).limit(0)) == ["click:none", "view:none"]
    monkeypatch.setattr(ft, "MAX_TYPES", 4)
    with pytest.raises(ValueError, match="type_rows"):
        ft.event_types(lookup(spark))
    monkeypatch.setattr(ft, "WIDE_BLOCK", 1)
    many = [(i, u, t("2025-03-01 00:00:00"), [1, 2], [1]) for u in range(10, 30) for i in range(u)]
    wide = ft.wide_rows(ft.entity_events(spark.createDataFrame(many, LOG), lookup(spark), [12])[0], types, "2025-03-02 00:00:00").collect()
    assert {r["user_id"]: (r["view_sport_n"], r["click_sport_n"], r["click_bil_n"], r["view_bil_days"]) for r in wide} == {u: (u, u, 0, 1.0) for u in range(10, 30)}
