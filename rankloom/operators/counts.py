"""Popularity, activity and counts as of a time."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.heavy import heavy_keys

DAY_S = 86_400
#: Views added to a click-through rate's denominator.
CTR_PRIOR = 10.0


def click_counts(labelled: DataFrame) -> DataFrame:
    """(article_id, click_count) of labelled rows (article_id, label); articles without a click are left out."""
    return labelled.where("label = 1 AND article_id IS NOT NULL").groupBy("article_id").agg(F.count("*").alias("click_count"))


def listed_counts(lists: DataFrame, column: str) -> DataFrame:
    """(article_id, click_count) of ids in a list column; null lists and ids count nothing, repeated ids count again."""
    return lists.select(F.explode(column).alias("article_id")).where("article_id IS NOT NULL").groupBy("article_id").agg(F.count("*").alias("click_count"))


def before(df: DataFrame, cutoff: datetime | str, time: str = "ts") -> DataFrame:
    """Rows strictly before the cutoff: the first step of every feature builder."""
    return df.where(F.col(time) < F.lit(str(cutoff)).cast("timestamp_ntz"))


def popularity(labelled: DataFrame, cutoff: datetime | str) -> DataFrame:
    """Clicks per article strictly before the cutoff, which stays in the rows."""
    return click_counts(before(labelled, cutoff)).withColumn("cutoff", F.lit(str(cutoff)).cast("timestamp_ntz"))


def user_activity(rows: DataFrame, history: DataFrame, cutoff: datetime | str) -> DataFrame:
    """(user_id, n_impressions, n_clicks, last_seen, history_len, cutoff) of impressions with ts, labels strictly before the cutoff.

    A reader without history has length 0. Rows without a user form one group with a null user.
    """
    clicks = F.aggregate("labels", F.lit(0), lambda s, x: s + x)
    per_user = before(rows, cutoff).groupBy("user_id").agg(F.count("*").alias("n_impressions"), F.sum(clicks).alias("n_clicks"), F.max("ts").alias("last_seen"))
    lengths = history.select("user_id", F.size("article_ids").alias("history_len"))
    return per_user.join(lengths, "user_id", "left").select(
        "user_id", "n_impressions", "n_clicks", "last_seen", F.coalesce("history_len", F.lit(0)).alias("history_len"), F.lit(str(cutoff)).cast("timestamp_ntz").alias("cutoff")
    )


def users_remaining(rows: DataFrame, cutoff: datetime | str, time: str = "ts") -> DataFrame:
    """One row: users, the different users (nulls not counted) of rows at or after the cutoff, those still to be served."""
    return rows.where(F.col(time) >= F.lit(str(cutoff)).cast("timestamp_ntz")).agg(F.count_distinct("user_id").alias("users"))


def latest_source(rows: DataFrame, cutoff: datetime | str, time: str = "ts") -> DataFrame:
    """One row: the latest time a feature as of the cutoff could have seen, null if there is none."""
    return before(rows, cutoff, time).agg(F.max(time).alias("latest"))


def assert_no_leak(rows: DataFrame, cutoff: datetime, time: str = "ts") -> None:
    """Raises if features as of the cutoff could have seen a time at or after it."""
    latest = latest_source(rows, cutoff, time).first()["latest"]
    if latest is not None and latest >= cutoff:
        raise AssertionError(f"a source row at {latest} is not before the cutoff {cutoff}")


def asof_counts(events: DataFrame, asked: DataFrame, entity: str, time: str, windows: Mapping[str, int | None], measures: Mapping[str, str] | None = None, keys: list | None = None) -> DataFrame:
    """``asked`` with, per measure and window, how many events of its entity lie in [time - window, time).

    ``events`` has the entity, the time and the measures' 0/1 (or count) columns; ``windows`` maps a name to
    seconds of any number, None for all earlier events; ``measures`` maps a prefix to an event column (default: one
    measure that counts rows). Columns are <prefix><window name>. An event at the very time does not count, one
    exactly a window earlier does. Without events the counts are 0; so they are for a null entity or time.

    A count is the difference of two running sums, up to the time and up to the window's start, so each row is
    sorted once and a crowded window costs no more than an empty one. Entities with many rows are cut into day
    buckets: a bucket also holds the events of as many earlier days as the longest window reaches, and the total of
    all days before its own is joined to it, so no task sorts all rows of one entity. ``keys`` are those entities;
    give them where ``asked`` comes out of a shuffle.
    """
    measures = dict(measures or {"n_": ""})
    reach = max([-(-w // DAY_S) for w in windows.values() if w is not None], default=0)
    hot = heavy_keys(asked, entity) if keys is None else keys
    zero = F.lit(0).cast("long")
    sums = [f"m{i}" for i in range(len(measures))]
    amount = [(F.col(c) if c else F.lit(1)).cast("long").alias(m) for m, c in zip(sums, measures.values())]
    micros = F.unix_micros(F.col(time).cast("timestamp")).alias("u")
    rows = events.select(F.col(entity).alias("e"), micros, *amount).where("e IS NOT NULL AND u IS NOT NULL")
    day = F.floor(F.col("u") / F.lit(DAY_S * 1_000_000)).cast("long")
    is_hot = F.col("e").isin(hot) if hot else F.lit(False)
    question = asked.select(F.col(entity).alias("e"), micros, F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("row"))
    if hot:
        copies = F.array(*[F.struct((day + i).alias("bucket"), F.lit(int(i == 0)).alias("own")) for i in range(reach + 1)])
        once = F.array(F.struct(zero.alias("bucket"), F.lit(1).alias("own")))
        held = rows.select("e", "u", *sums, F.explode(F.when(is_hot, copies).otherwise(once)).alias("b")).select("e", "u", *sums, "b.*")
        question = question.withColumn("bucket", F.when(is_hot, day).otherwise(zero))
        per_day = rows.where(is_hot).groupBy("e", day.alias("bucket")).agg(*[F.sum(s).alias(s) for s in sums])
        line = Window.partitionBy("e").orderBy("bucket")
        upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spans = per_day.select("e", (F.col("bucket") + 1).alias("lo"), F.lead("bucket").over(line).alias("hi"), *[F.sum(s).over(upto).alias(f"c{s}") for s in sums])
        # one row per heavy entity and span between its active days: at most heavy keys * days of the log
        question = question.join(F.broadcast(spans.withColumnRenamed("e", "he")), (F.col("e") == F.col("he")) & (F.col("bucket") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("bucket") <= F.col("hi"))), "left")
        question = question.select("e", "u", "row", "bucket", *[F.coalesce(f"c{s}", zero).alias(f"c{s}") for s in sums])
    else:
        held = rows.select("*", zero.alias("bucket"), F.lit(1).alias("own"))
        question = question.select("e", "u", "row", zero.alias("bucket"), *[zero.alias(f"c{s}") for s in sums])
    both = held.unionByName(question, allowMissingColumns=True)
    line = Window.partitionBy("e", "bucket").orderBy("u")
    before = lambda column, seconds: F.coalesce(F.sum(column).over(line.rangeBetween(Window.unboundedPreceding, -1 - seconds * 1_000_000)), zero)
    out = []
    for s, prefix in zip(sums, measures):
        for name, seconds in windows.items():
            count = before(F.col(s) * F.col("own"), 0) + F.coalesce(f"c{s}", zero) if seconds is None else before(F.col(s), 0) - before(F.col(s), seconds)
            out.append(F.when(F.col("e").isNotNull() & F.col("u").isNotNull(), count).otherwise(zero).alias(f"{prefix}{name}"))
    return both.select("row", *out).where("row IS NOT NULL").select("row.*", *[f"{p}{n}" for p in measures for n in windows])


def rate(clicks: str, views: str, prior: float = CTR_PRIOR):
    """Clicks per view, damped by a prior in the denominator; 0 without views."""
    return F.when(F.col(views) == 0, F.lit(0.0)).otherwise(F.col(clicks) / (F.col(views) + F.lit(prior)))
