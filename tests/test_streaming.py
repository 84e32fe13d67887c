"""Streamed counts against a batch over the same rows."""

from conftest import rows, t
from pyspark.sql import functions as F

from rankloom.streaming import click_stream as cs

SCHEMA = "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>"


def test_daily_counts(spark, tmp_path):
    data = [(1, 7, t("2025-03-01 10:00:00"), [1, 2], [2, 9]), (1, 7, t("2025-03-01 10:00:00"), [1, 2], [2, 9]), (2, None, t("2025-03-01 23:00:00"), [2], [2]), (3, 7, t("2025-03-02 01:00:00"), [1], [1]), (4, 7, None, [1], [1]), (5, 7, t("2025-03-02 02:00:00"), None, [1]), (6, 8, t("2025-03-09 00:00:00"), [5], [5])]
    log = spark.createDataFrame(data, SCHEMA)
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = cs.read_log(spark, str(tmp_path / "in"), log.schema)
    query = cs.write_counts(cs.windowed_counts(cs.stream_clicks(stream)), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select(F.to_date("window_start").cast("string").alias("d"), "article_id", "click_count")) == [("2025-03-01", 2, 2), ("2025-03-02", 1, 1)]


def test_sliding_windows(spark, tmp_path):
    log = spark.createDataFrame([(1, 7, t("2025-03-01 10:00:00"), [1], [1]), (2, 7, t("2025-03-20 10:00:00"), [1], [1])], SCHEMA)
    log.write.parquet(str(tmp_path / "in"))
    counts = cs.windowed_counts(cs.stream_clicks(cs.read_log(spark, str(tmp_path / "in"), log.schema)), "7 days", "1 day")
    cs.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
