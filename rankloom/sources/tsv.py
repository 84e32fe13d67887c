"""Readers of the tab-separated click log: a behaviours file and a news file without headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns in file order, and the time format (month first, twelve hours).
BEHAVIOR_COLUMNS = "impression_id BIGINT, user_id STRING, time STRING, history STRING, impressions STRING"
NEWS_COLUMNS = "news_id STRING, category STRING, subcategory STRING, title STRING, abstract STRING, url STRING, title_entities STRING, abstract_entities STRING"
TIME_FORMAT = "M/d/yyyy h:mm:ss a"


def split_folder(spark: SparkSession, root: str, name: str, file: str = "behaviors.tsv") -> str:
    """Path of the folder that holds a split's behaviours file: the split's own, however deep, else the root itself.

    One listing by Hadoop's file system, so any store that Spark reads works. Of several folders of the split's name
    the deepest wins, of equally deep ones the first by name.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    shape = spark._jvm.org.apache.hadoop.fs.Path(base, f"{{{name}/{name}/,{name}/,}}{file}")
    found = [s.getPath().getParent() for s in system.globStatus(shape) or []]
    if not found:
        raise FileNotFoundError(f"split {name!r}: {root} holds no {file}")
    return min(found, key=lambda p: (-p.depth(), p.toString())).toString()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Quoting is off: fields hold bare quotation marks.
    return spark.read.csv(str(path), schema=schema, sep="\t", header=False, quote="", escape="", mode="FAILFAST")


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """Behaviours as they stand in the file; an empty field is null."""
    return _read(spark, path, BEHAVIOR_COLUMNS)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News articles; entity fields stay raw text."""
    return _read(spark, path, NEWS_COLUMNS)


def first_wins(*news: DataFrame, key: str = "news_id") -> DataFrame:
    """Union of news files in which the first file that has an article wins."""
    every = news[0].withColumn("__file", F.lit(0))
    for i, other in enumerate(news[1:], 1):
        every = every.unionByName(other.withColumn("__file", F.lit(i)))
    columns = [c for c in news[0].columns if c != key]
    best = every.groupBy(key).agg(F.min(F.struct("__file", *columns)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in columns])


def parsed_time(column: str = "time") -> Column:
    """Timestamp of a time field; malformed input raises, null stays null."""
    return F.to_timestamp_ntz(F.col(column), F.lit(TIME_FORMAT))


def history_ids(column: str = "history") -> Column:
    """Ids of a space-separated history; null gives []."""
    return F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda x: x != "")


def bare_candidates(column: str = "impressions") -> Column:
    """Ids of candidates without labels, in order, as they stand."""
    return history_ids(column)


def _labelled(x: Column) -> Column:
    """The candidate itself if it ends in -0 or -1; anything else raises."""
    return F.when(x.rlike("^.+-[01]$"), x).otherwise(F.raise_error(F.concat(F.lit("a candidate without label: "), x)))


def candidates(column: str = "impressions") -> Column:
    """Ids of labelled candidates, in order; an id without -0 or -1 raises."""
    return F.transform(history_ids(column), lambda x: F.regexp_replace(_labelled(x), "-[01]$", ""))


def labels(column: str = "impressions") -> Column:
    """0/1 labels of labelled candidates, aligned with them; an id without -0 or -1 raises."""
    return F.transform(history_ids(column), lambda x: F.right(_labelled(x), F.lit(1)).cast("int"))


def impressions(behaviors: DataFrame, labelled: bool = True) -> DataFrame:
    """(impression_id, user_id, ts, history_ids, candidates[, labels]); without labels ids are taken as they stand."""
    columns = [F.col("impression_id"), F.col("user_id"), parsed_time().alias("ts"), history_ids().alias("history_ids")]
    more = [candidates().alias("candidates"), labels().alias("labels")] if labelled else [bare_candidates().alias("candidates")]
    return behaviors.select(*columns, *more)
