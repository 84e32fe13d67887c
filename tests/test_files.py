"""Readers, writers, splits, submissions and bootstrap."""

import json
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows, t
from pyspark.sql import functions as F

from rankloom.operators import bootstrap, splits, submission
from rankloom.sources import sinks, tables, tsv


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "train" / "train").mkdir(parents=True)
    lines = ['7\tU8\t2/3/2024 9:05:58 AM\tK4 K9\tK-1-1 K6-0', '8\tU3\t12/30/2024 6:11:30 PM\t\tK6-0 K7-1']
    (tmp_path / "train" / "train" / "behaviors.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "news.tsv").write_text('N1\tsport\tfoot\t"Quoted start\tan "inner" mark\turl\t[]\t[]\nN2\tnews\tx\tTitle\t\turl\t[]\t[]\n')
    return tmp_path


def test_tab_separated(spark, folder):
    path = tsv.split_folder(spark, str(folder), "train")
    assert path.endswith("/train/train")
    got = sorted(tsv.impressions(tsv.read_behaviors(spark, f"{path}/behaviors.tsv")).collect())
    assert got[0]["ts"] == datetime(2024, 2, 3, 9, 5, 58) and got[1]["ts"].hour == 18
    assert got[0]["history_ids"] == ["K4", "K9"] and got[1]["history_ids"] == []
    assert got[0]["candidates"] == ["K-1", "K6"] and got[0]["labels"] == [1, 0]
    news = {r["news_id"]: r for r in tsv.read_news(spark, str(folder / "news.tsv")).collect()}
    assert news["N1"]["title"] == '"Quoted start' and news["N1"]["abstract"] == 'an "inner" mark' and news["N2"]["abstract"] is None
    with pytest.raises(FileNotFoundError):
        tsv.split_folder(spark, str(folder), "none")
    (folder / "dev").mkdir()
    (folder / "dev" / "behaviors.tsv").write_text("")
    (folder / "behaviors.tsv").write_text("")
    assert tsv.split_folder(spark, str(folder), "dev").endswith("/dev")
    assert not tsv.split_folder(spark, str(folder), "test").endswith("/test")


@pytest.mark.parametrize("field", ["K12345 K7-1", "K7-2", "-1"])
def test_candidates_without_label_raise(spark, field):
    df = spark.createDataFrame([(field,)], "impressions string")
    for column in (tsv.labels(), tsv.candidates()):
        with pytest.raises(Exception, match="without label"):
            df.select(column).collect()
    assert df.select(tsv.bare_candidates()).first()[0] == field.split()


def test_bad_time_raises(spark):
    with pytest.raises(Exception, match="CANNOT_PARSE"):
        spark.createDataFrame([("2019-11-11",)], "time string").select(tsv.parsed_time()).collect()


def test_first_file_wins(spark):
    a = spark.createDataFrame([("N1", "a")], "news_id string, title string")
    b = spark.createDataFrame([("N1", "b"), ("N2", None)], "news_id string, title string")
    assert rows(tsv.first_wins(a, b)) == [("N1", "a"), ("N2", None)]


def test_labels(spark):
    data = [([5, 6, 9], [9]), ([61, 4], [4, 61]), ([3, 8, 3], [3]), ([12, 13], [14]), ([], [1])]
    df = spark.createDataFrame(data, "candidates array<int>, clicked array<int>").withColumn("labels", tables.labels_of())
    assert [r["labels"] for r in df.collect()] == [[0, 0, 1], [1, 1], [1, 0, 1], [0, 0], []]
    assert [r[0] for r in df.select(tables.clicked_of()).collect()] == [[9], [61, 4], [3, 3], [], []]


def test_recent_history(spark):
    at = [t(f"2025-01-{d:02d} 00:00:00") for d in range(1, 7)]
    data = [(4, [31, 37, 32, 38, 33, 39], at), (4, [31, 37, 32, 38, 33, 39], at), (5, [52, 51], [at[4], at[2]]), (6, None, None), (None, [9], [at[0]])]
    df = spark.createDataFrame(data, "user_id bigint, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>")
    assert rows(tables.recent_history(df, 3)) == [(4, [38, 33, 39]), (5, [51, 52]), (6, [])]
    assert rows(tables.recent_history(df, 3, spark.createDataFrame([(5,)], "user_id bigint"))) == [(5, [51, 52])]
    with pytest.raises(ValueError, match="at least 1"):
        tables.recent_history(df, 0)


def test_columns_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.missing_columns(df, df.drop("b")) == ["b"]
    path = sinks.write_features(df, str(tmp_path), "x")
    assert tables.row_count(spark, path) == 1
    sinks.write_json(tmp_path / "m" / "manifest.json", {"cutoff": t("2025-01-01 00:00:00")})
    assert json.loads((tmp_path / "m" / "manifest.json").read_text()) == {"cutoff": "2025-01-01 00:00:00"}


def test_splits(spark):
    at = [(datetime(2024, 5, 1) + timedelta(days=d, hours=6 * h),) for d in range(6) for h in range(4)]
    df = spark.createDataFrame(at, "ts timestamp_ntz")
    b = splits.boundaries(df)
    assert (b.val_start, b.test_start) == (datetime(2024, 5, 5), datetime(2024, 5, 6))
    parts = splits.split(df, b)
    assert [parts[n].count() for n in splits.ORDER] == [16, 4, 4]
    named = df.withColumn("split", splits.split_name(b))
    assert {r["split"]: r["n"] for r in splits.assert_disjoint(named).collect()} == {"train": 16, "val": 4, "test": 4}
    assert splits.overlaps(named.where("split <> 'val'")).count() == 0 and splits.overlaps(named.limit(0)).count() == 0
    touching = named.withColumn("split", F.when(F.col("ts") < datetime(2024, 5, 3), "train").otherwise("test")).unionByName(named.where(F.col("ts") == datetime(2024, 5, 3)).withColumn("split", F.lit("train")))
    assert splits.overlaps(touching).first()["split"] == "test"
    with pytest.raises(AssertionError, match="begins at"):
        splits.assert_disjoint(df.withColumn("split", F.when(F.hour("ts") < 12, "train").otherwise("val")))
    with pytest.raises(ValueError, match="too short"):
        splits.boundaries(df.limit(1), 3, 3)
    with pytest.raises(ValueError, match="no time"):
        splits.boundaries(df.limit(0))


def test_submission(spark, tmp_path):
    data = [(80451, p, s) for p, s in enumerate([3, 1, 5, 2, 4])]
    ranks = submission.slate_ranks(spark.createDataFrame([(i, p, -float(r)) for i, p, r in data], "impression_id bigint, pos int, score double"), ["impression_id"], "score")
    lines = ranks.select("impression_id", submission.line().alias("line"))
    assert lines.first()["line"] == "80451 [3,1,5,2,4]"
    sinks.write_lines(lines, str(tmp_path / "out"), ["impression_id"])
    zipped = sinks.zip_lines(tmp_path / "out", tmp_path / "out.zip")
    assert zipfile.ZipFile(zipped).read("prediction.txt").decode() == "80451 [3,1,5,2,4]\n"


@pytest.mark.parametrize("line", ["1 [1, 2]", "1 [1,2", "1 1,2", "x [1,2]", "1 []", ""])
def test_malformed_line(spark, line):
    assert submission.parsed(spark.createDataFrame([(line,)], "value string")).first()["problem"] == "format"


@pytest.mark.parametrize("line", ["1 [1,1,3]", "1 [1,2,4]", "1 [0,1,2]", "1 [2,3,4]", "1 [99999999999]"])
def test_no_permutation(spark, line):
    assert submission.parsed(spark.createDataFrame([(line,)], "value string")).first()["problem"] == "ranks"


def test_file_checks(spark):
    def check(lines, expected=None, **more):
        want = spark.createDataFrame(expected, "impression_id bigint, n_candidates int") if expected is not None else None
        return submission.validate(spark.createDataFrame([(x,) for x in lines], "value string"), want, **more).first()

    assert check(["1 [1,2]", "2 [1]"], [(1, 2), (2, 1)])["ok"]
    assert check(["1 [1,2]", "1 [2,1]"])["duplicate_rows"] == 1 and not check(["1 [1,2]", "1 [2,1]"])["ok"]
    assert check(["1 [1,2]"], [(1, 2), (2, 1)])["missing"] == 1 and check(["1 [1,2]", "3 [1]"], [(1, 2)])["extra"] == 1
    assert check(["1 [1,2]"], [(1, 3)])["bad_length"] == 1
    got = check(["0 [1]", "0 [1]", "5 [2,1]"], allow_duplicates=True)
    assert (got["lines"], got["impressions"], got["duplicate_rows"], got["ok"]) == (3, 2, 1, True)
    assert check([])["ok"] and not check([], [(1, 1)])["ok"]


def test_bootstrap(spark):
    assert bootstrap.interval([0.7] * 100).lo == pytest.approx(0.7) and bootstrap.interval([0.5, float("nan"), 0.5, None]).n == 2
    one = bootstrap.interval([0.3])
    assert (one.mean, one.lo, one.hi, one.n) == (0.3, 0.3, 0.3, 1) and np.isnan(bootstrap.interval([]).mean)
    x = np.random.default_rng(3).random(5000)
    rng = np.random.default_rng(0)
    means = x[rng.integers(0, len(x), size=(1000, len(x)))].mean(axis=1)
    got = bootstrap.interval(x)
    assert (got.lo, got.hi) == tuple(np.quantile(means, [0.025, 0.975]))
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x[:800])], "model string, id int, value double")
    exact = bootstrap.exact_intervals(df, ["model"], order=["id"]).first()
    assert exact["lo"] == pytest.approx(bootstrap.interval(x[:800]).lo)
    near = bootstrap.poisson_intervals(df, ["model"], ["id"]).first()
    assert near["n"] == 800 and near["lo"] == pytest.approx(exact["lo"], abs=0.01) and near["hi"] == pytest.approx(exact["hi"], abs=0.01)
    a, b, c = (bootstrap.Interval(m, m - 0.1, m + 0.1, 9) for m in (0.3, 0.5, 0.9))
    assert a.overlaps(b) and not a.overlaps(c)
    table = spark.createDataFrame([("m", n, i.lo, i.hi) for n, i in (("a", a), ("b", b), ("c", c))] + [("z", "a", 0.0, 9.0)], "metric string, model string, lo double, hi double")
    assert rows(bootstrap.compared(table, by=["metric"])) == [("m", "a", "b", None), ("m", "a", "c", "c"), ("m", "b", "c", "c")]
    assert bootstrap.compared(table.limit(0), by=["metric"]).count() == 0
    assert bootstrap.best_model({"a": a, "b": b, "c": c}) == ("c", [])
