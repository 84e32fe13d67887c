"""Mixes reach what can be reached, never repeat too often, and say what they reached."""

import numpy as np
import pandas as pd
import pytest
from compare import differences
from pyspark.sql import functions as F

from rankloom.llm import mixing, plans


def data(spark):
    docs = [(i, [" Big", "big ", "BIG"][i % 3], ["en", "eng", "da", None][i % 4], 100 + i % 7) for i in range(900)]
    docs += [(1000 + i, "small", "en", 50) for i in range(20)] + [(2000 + i, "mid", "da", 80 + i) for i in range(200)] + [(3000, "other", "en", 500), (3001, None, "en", 9), (3002, "mid", "en", None), (3003, "mid", "en", 0)]
    targets = [("Big", 5.0, 1), ("Small", 2.0, 3), ("mid", 3.0, 4), ("mid", 3.0, 4), ("never", 1.0, 2), (None, 9.0, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n bigint"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")


def test_mix(spark):
    docs, targets = data(spark)
    sizes = mixing.source_sizes(docs, targets, F.col("n"))
    mixed = mixing.mix(docs, targets, F.col("n"), F.lit(None).cast("string"), sizes)
    got = mixed.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and not {r["doc_id"] for r in got} & {3000, 3001, 3002, 3003}
    cap = {"Big": 1, "Small": 3, "mid": 4}
    assert all(1 <= r["uses"] <= cap[r["source"]] for r in got)
    report = {r["source"]: r for r in mixing.mix_report(sizes, mixed).collect()}
    assert set(report) == {"Big", "Small", "mid", "never"} and report["never"]["size"] == 0
    total = sum(r["size"] for r in report.values())
    for name, r in report.items():
        wanted = total * {"Big": 5, "Small": 2, "mid": 3, "never": 1}[name] / 11
        assert r["reachable"] == (r["size"] * r["max_repeats"] >= wanted)
        reach = min(wanted, r["size"] * r["max_repeats"])
        assert r["drawn"] == pytest.approx(reach, rel=0.01)
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix(docs, targets, F.col("n"), F.lit(None).cast("string"), sizes).collect())


def test_rake_meets_margins():
    cells = pd.DataFrame([("a", "en", "x", 100.0), ("a", "da", "y", 300.0), ("b", "en", "y", 200.0), ("b", "da", "x", 400.0)], columns=["source", "lang", "topic", "tokens"])
    uses = mixing.rake(cells, {"a": 600.0, "b": 400.0}, {"a": 3.0, "b": 3.0})
    t = cells["tokens"] * uses
    assert t[:2].sum() == pytest.approx(600) and t[2:].sum() == pytest.approx(400)
    assert t[[0, 2]].sum() == pytest.approx(300, rel=0.02) and t[[0, 3]].sum() == pytest.approx(500, rel=0.02)
    capped = mixing.rake(cells, {"a": 1200.0, "b": 100.0}, {"a": 3.0, "b": 3.0})
    assert (capped <= 3 + 1e-12).all() and np.allclose(capped[:2], 3)


def test_empty(spark):
    docs, targets = data(spark)
    sizes = mixing.source_sizes(docs.limit(0), targets, F.col("n"))
    assert sizes.count() == 4
    assert mixing.mix(docs.limit(0), targets, F.col("n"), F.lit("t")).count() == 0
    assert mixing.mix(docs, targets.limit(0), F.col("n"), F.lit("t")).count() == 0


def test_languages(spark):
    df = spark.createDataFrame([("DAN",), ("en-GB",), (" Fr ",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(mixing.same_language(F.col("l"))).collect()] == ["da", "en", "fr", "unknown", "unknown"]


def test_many_cells_are_raked_as_a_table(spark, monkeypatch):
    cells = pd.DataFrame([(s, l, t, 100.0 + 37 * ((i * j + k) % 5)) for i, s in enumerate("abc") for j, l in enumerate(("da", "en")) for k, t in enumerate(("x", "y", "z"))], columns=["source", "lang", "topic", "tokens"])
    wanted, most = {"a": 900.0, "b": 500.0, "c": 1800.0}, {"a": 2.0, "b": 1.0, "c": 3.0}
    want = mixing.rake(cells, wanted, most, 200)
    got = mixing.rake_table(spark.createDataFrame(cells), wanted, most, rounds=12, refits=3).toPandas().set_index(["source", "lang", "topic"])["uses"]
    for row, uses in zip(cells.itertuples(), want):
        assert got[row.source, row.lang, row.topic] == pytest.approx(uses, rel=0.02) and got[row.source, row.lang, row.topic] <= most[row.source] + 1e-9
    docs, targets = data(spark)
    plain = mixing.mix(docs, targets, F.col("n"), F.lit(None).cast("string")).agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0]
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    table = mixing.mix(docs, targets, F.col("n"), F.lit(None).cast("string")).agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0]
    assert table == pytest.approx(plain, rel=0.05)


def odd_tables(spark, folder, targets):
    """Three languages and two topics; a spelled in two ways, b small, c without tokens, d without a target."""
    docs = [(i, "x" * (40 + i % 9), ["da", "eng", None][i % 3], [" A", "a"][i % 2], i % 4 or None) for i in range(60)]
    docs += [(100 + i, "æ" * 25, "da", "b", i) for i in range(4)] + [(200, None, "da", "c", 1), (201, "", "da", "c", 1), (300, "y" * 500, "sv", "d", 2), (301, "z", "da", None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, article_id int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Nyheder_x"), (1, "Nyheder_x"), (2, "sport"), (3, None)], "article_id int, category_str string").write.parquet(f"{folder}/articles.parquet")
    spark.createDataFrame(targets, "source string, target_weight double, max_repeats int").write.parquet(f"{folder}/mix_targets.parquet")
    return str(folder)


TARGETS = {
    "plain": [("A", 5.0, 1), ("B", 3.0, 4), ("C", 0.5, 9), ("never", 1.0, 2), (None, 9.0, 1)],
    "one source twice": [("A", 1.0, 1), ("a ", 30.0, 1), ("A", 1.0, 3), ("b", 1.0, 1), ("b", 1.0, 1)],
    "nulls": [("A", 1.0, 2), ("b", 8.0, None), ("c", None, 1), ("never", 0.0, 0)],
    "ties": [("a", 0.0, 0), ("c", 0.0, 3), ("b", 1.0, 1), ("B", 1.0, 14)],
    "none": [("a", 0.0, 0), ("b", 0.0, -1)],
    "not a number": [("a", float("nan"), 2), ("b", 1.0, 1), ("c", 1.0, None)],
}


@pytest.mark.parametrize("name", TARGETS)
def test_found_agrees_with_sql_on_odd_targets(spark, tmp_path, name):
    assert differences(spark, odd_tables(spark, tmp_path, TARGETS[name]), plans.p9_found, plans.SQL["p9_found"]) == ""


def test_found_comes_from_fit_and_draw(spark, tmp_path, monkeypatch):
    folder = odd_tables(spark, tmp_path, TARGETS["plain"])
    fitted, rake = [], mixing.rake

    def seen(cells, wanted, most, *more):
        uses = rake(cells, wanted, most, *more)
        fitted.append(cells.assign(uses=uses, cap=cells["source"].map(most)))
        return uses

    monkeypatch.setattr(mixing, "rake", seen)
    assert sorted(r[0] for r in plans.p9_found(spark, folder).collect()) == ["B", "C", "never"]
    assert len(fitted) == 1 and fitted[0].groupby("source").size().max() >= 6  # A's cells by language and topic
    monkeypatch.setattr(mixing, "rake", lambda cells, *_: np.zeros(len(cells)))  # without a fit no document is used up
    assert sorted(r[0] for r in plans.p9_found(spark, folder).collect()) == ["C", "never"]
    monkeypatch.setattr(mixing, "rake", rake)
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    assert sorted(r[0] for r in plans.p9_found(spark, folder).collect()) == ["B", "C", "never"]


def test_reach_tells_what_was_drawn(spark):
    docs, targets = data(spark)
    got = {r["source"]: r for r in mixing.reach(docs, targets, F.col("n"), F.lit(None).cast("string")).collect()}
    mixed = mixing.mix(docs, targets, F.col("n"), F.lit(None).cast("string")).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses"))).collect()
    assert set(got) == {"Big", "Small", "mid", "never"} and got["Small"]["drawn"] == 20 * 50 * 3 and got["never"]["drawn"] == 0
    assert {k: r["drawn"] for k, r in got.items() if r["drawn"]} == pytest.approx({k: n for k, n in mixed}, rel=0.01)
    assert {k for k, r in got.items() if r["used_up"] and r["drawn"] < r["wanted"]} == {"Small", "never"}


def test_cells_end_at_the_cap_itself_where_more_is_wanted(spark):
    cells = pd.DataFrame([(s, l, t, 10.0 ** (i + 2 * j + k)) for i, s in enumerate("ab") for j, l in enumerate(("da", "en")) for k, t in enumerate("xyz")], columns=["source", "lang", "topic", "tokens"])
    a = cells.loc[cells["source"] == "a", "tokens"].sum()
    for wanted in (3 * a * (1 + 1e-12), 4 * a, float("inf"), float("nan")):
        uses = mixing.rake(cells, {"a": wanted, "b": 1000.0}, {"a": 3.0, "b": 2.0})
        assert (uses[:6] == 3).all() and (cells["tokens"] * uses)[6:].sum() == pytest.approx(1000)
    table = mixing.rake_table(spark.createDataFrame(cells), {"a": 3 * a * (1 + 1e-12), "b": 1000.0}, {"a": 3.0, "b": 2.0}, rounds=2, refits=0).toPandas()
    assert (table.loc[table["source"] == "a", "uses"] == 3).all()
    assert (table.loc[table["source"] == "b", "tokens"] * table.loc[table["source"] == "b", "uses"]).sum() == pytest.approx(1000)
