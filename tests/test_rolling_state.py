"""Stored daily states, blocks of days and corrections must all give the totals of brute force."""

import random
from datetime import date, timedelta

import pytest
from conftest import rows

from rankloom.operators import rolling_state as rs

DAY = date(2025, 3, 1)
DAYS = [DAY + timedelta(i) for i in range(40)]
SCHEMA = "key string, day date, amount long"


def brute(amounts, w, days=DAYS):
    return {(k, d): sum(a for k2, e, a in amounts if k2 == k and d - timedelta(w) < e <= d) for k in {k for k, *_ in amounts} for d in days}


def made(seed=1):
    r = random.Random(seed)
    return [(r.choice("abc"), DAY + timedelta(r.randrange(40)), r.randrange(1, 5)) for _ in range(60)]


def store_of(spark, tmp_path, data, before=DAY - timedelta(1)):
    store = rs.StateStore(spark, str(tmp_path / "store"), "string")
    store.begin(spark.createDataFrame(data, SCHEMA), before)
    return store


def held(store):
    return {(r["key"], r["day"]): (r["c7"], r["c30"]) for r in store.states().where(f"day >= '{DAY}'").collect()}


def totals(data, days=DAYS):
    c7, c30 = brute(data, 7, days), brute(data, 30, days)
    return {k: (c7[k], c30[k]) for k in c7}


@pytest.mark.parametrize("block", [7, 40])
def test_blocks_against_brute_force(spark, tmp_path, block):
    data = made()
    store = store_of(spark, tmp_path, data)
    store.backfill(DAYS[-1], block)
    assert held(store) == totals(data)


def test_daily_jobs_bring_their_arrivals(spark, tmp_path):
    data = made(2)
    store = store_of(spark, tmp_path, [x for x in data if x[1] <= DAYS[33]])
    store.backfill(DAYS[33])
    for d in DAYS[34:37]:
        store.advance(d, arrivals=spark.createDataFrame([x for x in data if x[1] == d], SCHEMA))
    got, want = held(store), totals(data)
    assert {k: v for k, v in got.items() if k[1] > DAYS[33]} == {k: v for k, v in want.items() if DAYS[33] < k[1] <= DAYS[36]}
    with pytest.raises(ValueError, match="does not follow"):
        store.advance(DAYS[39])


def test_a_day_reads_itself_and_the_days_that_leave(spark):
    data = [("a", DAY - timedelta(d), 2**d) for d in range(40)]
    got = {(k, d): (a, b) for k, d, a, b in rows(rs.moves(spark.createDataFrame(data, SCHEMA), DAY, DAY))}
    assert got == {("a", DAY): (1 - 2**7, 1 - 2**30)}
    plan = rs.moves(spark.createDataFrame(data, SCHEMA), DAY, DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan


def test_amounts_before_the_first_day_count_and_nulls_do_not(spark, tmp_path):
    data = [("a", date(2025, 2, 27), 2), (None, DAY, 1), ("b", None, 1), ("a", DAY, None)]
    store = store_of(spark, tmp_path, data)
    store.backfill("2025-03-31")
    got = {k[1]: v for k, v in held(store).items()}
    assert got[DAY] == (2, 2) and got[date(2025, 3, 6)] == (0, 2) and got[date(2025, 3, 29)] == (0, 0) and len(got) == 31


def test_empty(spark, tmp_path):
    store = store_of(spark, tmp_path, [])
    store.backfill(DAYS[3])
    assert held(store) == {}


def test_corrections_reach_only_their_dates(spark, tmp_path):
    data, late = made(3), [("a", DAYS[2], 5), ("a", DAYS[2], 1), ("new", DAYS[20], 4), ("a", None, 9), (None, DAY, 9)]
    store = store_of(spark, tmp_path, data)
    store.backfill(DAYS[35])
    before = held(store)
    store.correct(spark.createDataFrame(late, SCHEMA))
    every = [*data, *[x for x in late if None not in x]]
    want = totals(every, DAYS[:36])
    got = held(store)
    assert {k: v for k, v in got.items() if k[0] != "new"} == {k: v for k, v in want.items() if k[0] != "new"}
    assert {k[1] for k in got if k[0] == "new"} == set(DAYS[20:36]) and got["new", DAYS[27]] == (0, 4)
    versions = {(r["key"], r["day"]): r["version"] for r in store.states().collect()}
    assert {k for k, v in versions.items() if v == 2} == {("a", d) for d in DAYS[2:32]}
    old = {(r["key"], r["day"]): (r["c7"], r["c30"]) for r in store.versions().where(f"version = 1 AND day >= '{DAY}' AND key <> 'new'").collect()}
    assert old == before  # earlier versions stay readable
    store.correct(spark.createDataFrame([("a", DAYS[30], 1)], SCHEMA), "later")
    assert store.states().where("version = 3").count() == 2
    # what came late leaves the periods later on
    store.advance(DAYS[36], DAYS[39])
    last = totals([*every, ("a", DAYS[30], 1)])
    assert {k: v for k, v in held(store).items() if k[1] > DAYS[35]} == {k: v for k, v in last.items() if k[1] > DAYS[35]}
