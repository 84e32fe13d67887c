"""Readers of the click-log tables and the rules that make their rows countable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_START = "2025-02-01 00:00:00"
LOG_END = "2025-04-12 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_log(behaviors: DataFrame, start: str = LOG_START, end: str = LOG_END) -> DataFrame:
    """Rows whose impression_time lies in [start, end); rows without a time are left out."""
    t = F.col("impression_time")
    return behaviors.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))


def click_rows(behaviors: DataFrame, *keep: str) -> DataFrame:
    """One row per clicked article of each log row: ``keep`` and ``article_id``.

    A click is a distinct id of article_ids_clicked that article_ids_inview holds too. Redelivered rows are
    not merged here. Null lists and null ids give no row.
    """
    ids = F.array_intersect("article_ids_clicked", "article_ids_inview")
    return (
        in_log(behaviors)
        .where(F.size("article_ids_clicked") > 0)
        .select(*keep, F.explode(ids).alias("article_id"))
        .where(F.col("article_id").isNotNull())
    )


def clicks(behaviors: DataFrame) -> DataFrame:
    """Distinct clicks (impression_id, user_id, impression_time, article_id) and the time the first copy was logged.

    Rows equal in impression_id, user_id and impression_time are one row, null equal to null. The merge is done
    on the exploded ids, so the lists themselves are never shuffled.
    """
    key = ["impression_id", "user_id", "impression_time", "article_id"]
    rows = click_rows(behaviors, "impression_id", "user_id", "impression_time", "logged_time")
    return rows.groupBy(*key).agg(F.min("logged_time").alias("logged_time"))


def impressions(behaviors: DataFrame) -> DataFrame:
    """One row per distinct log row with candidates: (impression_id, user_id, ts, candidates, clicked).

    impression_id is not unique; the three first columns together are. A null clicked list is [].
    """
    rows = in_log(behaviors).where(F.size("article_ids_inview") > 0)
    once = rows.dropDuplicates(["impression_id", "user_id", "impression_time"])
    return once.select(
        "impression_id", "user_id", F.col("impression_time").alias("ts"), F.col("article_ids_inview").alias("candidates"),
        F.coalesce("article_ids_clicked", F.array().cast("array<int>")).alias("clicked"),
    )


def labels_of(candidates: str = "candidates", clicked: str = "clicked") -> Column:
    """0/1 labels aligned with the candidates: repeated clicked ids are marked everywhere, foreign ids ignored."""
    return F.transform(F.col(candidates), lambda x: F.array_contains(F.col(clicked), x).cast("int"))


def clicked_of(candidates: str = "candidates", labels: str = "labels") -> Column:
    """Ids with label 1: the inverse of labels_of."""
    return F.transform(F.filter(F.arrays_zip(F.col(candidates).alias("c"), F.col(labels).alias("l")), lambda x: x["l"] == 1), lambda x: x["c"])


def candidate_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Long form of impressions: ``keep``, pos (0-based), article_id, label. pos tells repeated candidates apart."""
    label = F.array_contains("clicked", F.col("article_id")).cast("int")
    return rows.select(*keep, "clicked", F.posexplode("candidates").alias("pos", "article_id")).select(*keep, "pos", "article_id", label.alias("label"))


def recent_history(history: DataFrame, n: int, users: DataFrame | None = None) -> DataFrame:
    """(user_id, article_ids): the last ``n`` clicks of every reader, oldest first, of ``users`` only if given.

    Lists are put in time order first; repeated rows are one. n below 1 raises.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = history if users is None else history.join(users.select("user_id").distinct(), "user_id", "left_semi")
    pairs = F.arrays_zip(F.col("impression_time_fixed").alias("t"), F.col("article_id_fixed").alias("a"))
    tail = F.reverse(F.slice(F.reverse(F.array_sort(pairs)), 1, n))
    return rows.where("user_id IS NOT NULL").dropDuplicates(["user_id"]).select("user_id", F.transform(F.coalesce(tail, F.array()), lambda x: x["a"]).alias("article_ids"))


def article_texts(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """(article_id, title, abstract): one row per article; ``limit`` takes the smallest ids."""
    rows = articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min(F.struct("title", "abstract")).alias("t"))
    rows = rows.select("article_id", "t.title", "t.abstract")
    return rows if limit is None else rows.orderBy("article_id").limit(limit)


def publish_times(articles: DataFrame) -> DataFrame:
    """(article_id, published_time): the earliest of an article."""
    return articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min("published_time").alias("published_time"))


def missing_columns(validation: DataFrame, test: DataFrame) -> list[str]:
    """Columns that serving does not have: those of ``validation`` that ``test`` lacks."""
    return sorted(set(validation.columns) - set(test.columns))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; nothing but row counts is read from it."""
    return spark.read.parquet(path).count()
