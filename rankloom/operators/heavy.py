"""Per-key results that do not wait for the few keys that hold most rows.

Heavy keys are found with a frequent-items sketch that merges map-side, so its size is fixed. Their rows are
marked by a broadcast join with that bounded key list and spread over a second key; all other rows take one
ordinary shuffle by key. The two results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of the rows from which on a key is heavy, where there are few shuffle partitions.
HEAVY_SHARE = 0.005
#: Smallest share, whatever the number of partitions: 1 / LEAST_SHARE keys bound every broadcast made here.
LEAST_SHARE = 0.0001
#: Counters of the sketch per key that can be heavy; its error is below share / SLOTS_PER_KEY of the rows.
SLOTS_PER_KEY = 20


def heavy_share(spark: SparkSession) -> float:
    """Half of a shuffle partition's share of the rows: a key beyond it makes its task stand out on this cluster."""
    return max(LEAST_SHARE, min(HEAVY_SHARE, 0.5 / max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    """The keys that hold at least ``share`` (by default ``heavy_share``) of the non-null rows; an empty table has none.

    At most 1 / share keys can. The sketch's size follows the share and is bounded by LEAST_SHARE, so a task sends a
    bounded sketch however many keys it reads. Give raw columns, so that nothing but the key is scanned for it.
    """
    share = heavy_share(df.sparkSession) if share is None else max(share, LEAST_SHARE)
    most = int(1 / share) + 1
    row = (
        df.where(F.col(key).isNotNull())
        .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {SLOTS_PER_KEY * most})").alias("top"))
        .first()
    )
    return sorted(x["item"] for x in row["top"] or [] if x["count"] >= max(2, share * row["n"]))


def heaviest(counts: DataFrame, key: str, count: str, share: float | None = None) -> list:
    """As ``heavy_keys``, exactly, from a table that has every key's number of rows already."""
    share = heavy_share(counts.sparkSession) if share is None else max(share, LEAST_SHARE)
    total = counts.agg(F.sum(count)).first()[0] or 0
    # at most 1 / share keys hold that share of the total
    return sorted(r[0] for r in counts.where(F.col(key).isNotNull() & (F.col(count) >= max(2, share * total))).select(key).collect())


def mark_heavy(df: DataFrame, key: str, keys: list, name: str = "is_heavy") -> DataFrame:
    """Adds a boolean column: whether the row's key is one of ``keys``, by broadcast join with that bounded list."""
    if not keys:
        return df.withColumn(name, F.lit(False))
    kind = df.schema[key].dataType.simpleString()
    small = df.sparkSession.createDataFrame([(k,) for k in keys], f"`__heavy` {kind}")
    return (
        df.join(F.broadcast(small), df[key] == small["__heavy"], "left")
        .withColumn(name, F.col("__heavy").isNotNull())
        .drop("__heavy")
    )


def split_heavy(df: DataFrame, key: str, keys: list | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, heavy rows); heavy is None when no key is heavy. Rows with a null key are ordinary."""
    keys = heavy_keys(df, key) if keys is None else keys
    if not keys:
        return df, None
    marked = mark_heavy(df, key, keys)
    return marked.where(~F.col("is_heavy")).drop("is_heavy"), marked.where("is_heavy").drop("is_heavy")


def first_members(df: DataFrame, key: str, member: str, time: str, k: int = 5, keys: list | None = None) -> DataFrame:
    """The first ``k`` different members of every key: (key, member, first_time, place).

    Order: time of the member's first row, then the smaller member. Repeated rows change nothing. Rows with a
    null key, member or time are left out; a key with fewer than ``k`` members gives all of them. Other columns
    of ``df`` are ignored, whatever their names.
    """
    rows = df.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(time).alias("t")).dropna()
    order = Window.partitionBy("k").orderBy("t", "m")

    def best(x: DataFrame) -> DataFrame:
        return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    light, heavy = split_heavy(rows, "k", keys)
    # Ordinary keys: one shuffle by key serves both the grouping and the ranking.
    out = best(light.repartition("k").groupBy("k", "m").agg(F.min("t").alias("t")))
    if heavy is not None:
        # Heavy keys: grouped by (key, member), which spreads a key over all tasks; the ranking then prunes to k
        # rows of a key in each task before it shuffles.
        out = out.unionByName(best(heavy.groupBy("k", "m").agg(F.min("t").alias("t"))))
    return out.select(F.col("k").alias(key), F.col("m").alias(member), F.col("t").alias("first_time"), "place")


def key_totals(df: DataFrame, key: str, member: str, time: str, keys: list | None = None) -> DataFrame:
    """Per key: rows, different members (nulls not counted), first and last time.

    Ordinary keys are grouped after one shuffle by key. Heavy keys are grouped by (key, member) first and then by
    key, so that no task holds a heavy key's members. Rows with a null key are left out.
    """
    rows = df.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(time).alias("t")).where("k IS NOT NULL")

    def total(x: DataFrame) -> DataFrame:
        by_member = x.groupBy("k", "m").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
        return by_member.groupBy("k").agg(
            F.sum("n").alias("n_rows"), F.count("m").alias("n_members"), F.min("t0").alias("first_time"), F.max("t1").alias("last_time")
        )

    light, heavy = split_heavy(rows, "k", keys)
    out = total(light.repartition("k"))
    if heavy is not None:
        out = out.unionByName(total(heavy))
    return out.withColumnRenamed("k", key)


def join_on_skewed_key(left: DataFrame, right: DataFrame, key: str, keys: list | None = None, how: str = "left") -> DataFrame:
    """Join of a large, skewed ``left`` with ``right``, which has at most one row per key.

    Heavy keys of ``left`` meet a broadcast of only their rows of ``right`` (at most 1 / LEAST_SHARE); the others
    take an ordinary shuffle join. ``how`` is left or inner. The list of keys is fixed once and splits both sides, so
    a row of ``left`` meets its row of ``right`` whichever keys the sketch names. Give ``keys`` where ``left`` comes
    out of a shuffle, so that finding them does not run that again.
    """
    keys = heavy_keys(left, key) if keys is None else keys
    light, heavy = split_heavy(left, key, keys)
    out = light.join(right, key, how)
    if heavy is not None:
        few = mark_heavy(right, key, keys).where("is_heavy").drop("is_heavy")
        out = out.unionByName(heavy.join(F.broadcast(few), key, how))
    return out


def salt(key: Column, keys: list, spread: Column, parts: int) -> Column:
    """0 for ordinary keys; a number below ``parts`` made from ``spread`` for heavy ones."""
    return F.when(key.isin(keys), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0)) if keys else F.lit(0)
