"""One ranking of a group's items from several scores of different scale and spread.

Every score is first replaced by its rank within the group, so no score's range matters. The rank-transformed scores
are then projected onto one direction: their first principal component, taken from a correlation matrix that is
accumulated over all rows, with its sign turned to the declared directions; or a fixed direction, where a caller
needs a stated sum of rank worths.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.heavy import heavy_keys
from rankloom.operators.lineage import cut_lineage

#: A group is ranked by several tasks if it holds at least this share of the rows and this many.
HOT_SHARE, HOT_ROWS = 0.005, 200_000
#: Added to a rank in the reciprocal worth.
RECIPROCAL_K = 60


def _usable(score: Column, unknown) -> Column:
    ok = score.isNotNull() & ~F.isnan(score.cast("double"))
    return ok if unknown is None else ok & (score != F.lit(unknown))


def hot_groups(df: DataFrame, group: str) -> list:
    """Groups that are ranked by several tasks, found on the raw column."""
    rows = df.select(F.col(group).alias("grp")).where("grp IS NOT NULL")
    n = rows.count()
    return heavy_keys(rows, "grp", max(HOT_SHARE, HOT_ROWS / max(n, 1))) if n else []


def _rank_hot(rows: DataFrame, score: str, tasks: int) -> DataFrame:
    """rank_<score> and have_<score> in groups too large for one task: ranges of (group, score, pos), each ranked on its own, plus an offset."""
    order = [F.col(score).desc_nulls_last(), F.col("pos").asc()]
    cut = cut_lineage(rows.repartitionByRange(tasks, F.col("grp"), *order).withColumn("cut", F.spark_partition_id()))
    have = F.count(score).alias("n")
    before = Window.partitionBy("grp").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("grp", "cut").agg(have)  # at most tasks rows per hot group
    offsets = sizes.select("grp", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("grp")).alias(f"have_{score}"))
    place = F.row_number().over(Window.partitionBy("grp", "cut").orderBy(*order)) + F.col("offset")
    return cut.join(F.broadcast(offsets), ["grp", "cut"]).withColumn(f"rank_{score}", F.when(F.col(score).isNotNull(), place)).drop("cut", "offset")


def placed(rows: DataFrame, score: str, hot: list, tasks: int = 64) -> DataFrame:
    """Adds place: 1 for the highest ``score`` of each group (grp), ties by smaller pos; ``hot`` groups by several tasks."""
    order = Window.partitionBy("grp").orderBy(F.col(score).desc(), "pos")
    out = (rows.where(~F.col("grp").isin(hot)) if hot else rows).withColumn("place", F.row_number().over(order))
    if hot:
        several = _rank_hot(rows.where(F.col("grp").isin(hot)), score, tasks).withColumnRenamed(f"rank_{score}", "place")
        out = out.unionByName(several.select(*out.columns))
    return out


def rank_scores(
    df: DataFrame, group: str, pos: str, scores: Sequence[str], unknown: Mapping[str, float] | None = None,
    lower_is_better: Sequence[str] = (), hot: list | None = None, tasks: int = 64,
) -> DataFrame:
    """(grp, pos, rank_<score>..., have_<score>...): every score's rank in its group, 1 the best, ties by smaller pos.

    Exact duplicate rows are one row. A null, NaN or ``unknown`` score has no rank (null) and does not count in
    have_. Rows with a null group or pos are left out. Infinite scores rank as such. Groups that hold a large
    share of all rows are ranked by several tasks.
    """
    unknown = unknown or {}
    rows = df.where(F.col(group).isNotNull() & F.col(pos).isNotNull()).select(
        F.col(group).alias("grp"), F.col(pos).alias("pos"),
        *[F.when(_usable(F.col(s), unknown.get(s)), -F.col(s).cast("double") if s in lower_is_better else F.col(s).cast("double")).alias(s) for s in scores],
    )
    hot = hot_groups(df, group) if hot is None else hot
    columns = ["grp", "pos", *[f"rank_{s}" for s in scores], *[f"have_{s}" for s in scores]]

    light = (rows.where(~F.col("grp").isin(hot)) if hot else rows).repartition("grp").dropDuplicates()
    whole = Window.partitionBy("grp")
    for s in scores:
        order = whole.orderBy(F.col(s).desc_nulls_last(), "pos")
        light = light.withColumn(f"rank_{s}", F.when(F.col(s).isNotNull(), F.row_number().over(order))).withColumn(f"have_{s}", F.count(s).over(whole))
    out = light.select(*columns)
    if hot:
        heavy = rows.where(F.col("grp").isin(hot)).dropDuplicates()
        for s in scores:
            heavy = _rank_hot(heavy, s, tasks)
        out = out.unionByName(heavy.select(*columns))
    return out


def percentiles(ranks: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Adds u_<score>: 1 for the best to 0 for the worst of the group; 0.5 where the item lacks the score."""
    u = {f"u_{s}": F.coalesce(F.lit(1.0) - (F.col(f"rank_{s}") - F.lit(0.5)) / F.col(f"have_{s}"), F.lit(0.5)) for s in scores}
    return ranks.withColumns(u)


def principal_direction(rows: DataFrame, columns: Sequence[str], directions: Sequence[float] | None = None) -> dict:
    """Means, spreads and the first principal component of the correlation matrix of ``columns``.

    One aggregation over all rows; only k*(k+3)/2+1 sums reach the driver. The component's sign is turned so that
    its loadings agree with ``directions`` (all +1 by default); a column without spread gets loading 0. Without
    any row, or without any spread, the loadings are equal.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"q{i}_{j}") for i, j in pairs]
    ).first()
    want = np.asarray(directions if directions is not None else [1.0] * k, dtype=float)
    n = got["n"]
    if not n:
        return {"mean": [0.0] * k, "sd": [1.0] * k, "loading": list(want / np.sqrt(k)), "share": 0.0}
    mean = np.array([got[f"s{i}"] / n for i in range(k)])
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"q{i}_{j}"] / n - mean[i] * mean[j]
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = sd < 1e-12
    safe = np.where(flat, 1.0, sd)
    corr = cov / np.outer(safe, safe)
    corr[flat, :] = corr[:, flat] = 0
    values, vectors = np.linalg.eigh(corr)
    top = vectors[:, -1] if values[-1] > 1e-12 else want / np.sqrt(k)
    top = top if float(top @ want) >= 0 else -top
    return {"mean": mean.tolist(), "sd": safe.tolist(), "loading": top.tolist(), "share": float(values[-1] / max(values.sum(), 1e-12))}


def fuse_principal(ranks: DataFrame, scores: Sequence[str], directions: Sequence[float] | None = None, hot: Sequence = ()) -> DataFrame:
    """(grp, pos, projection, place): items by their projection on the first principal component, ties by pos.

    Projections are compared after rounding to 9 decimals. ``hot`` are the groups of ``hot_groups``.
    """
    rows = percentiles(ranks, scores)
    columns = [f"u_{s}" for s in scores]
    fit = principal_direction(rows, columns, directions)
    z = [(F.col(c) - F.lit(m)) / F.lit(s) * F.lit(w) for c, m, s, w in zip(columns, fit["mean"], fit["sd"], fit["loading"])]
    total = z[0]
    for x in z[1:]:
        total = total + x
    return placed(rows.select("grp", "pos", F.round(total, 9).alias("projection")), "projection", list(hot)).select("grp", "pos", "projection", "place")


def fuse_reciprocal(ranks: DataFrame, scores: Sequence[str], k: int = RECIPROCAL_K, top: int | None = None) -> DataFrame:
    """(grp, pos, worth, place): items by the sum of 1/(k + rank) over their scores, rounded to 10 decimals, ties by pos.

    This projects the transformed ranks onto the fixed all-ones direction. Items without any score are left out. With
    ``top`` every task prunes a group to that many rows before they are shuffled.
    """
    some = F.coalesce(*[F.col(f"rank_{s}") for s in scores]).isNotNull()
    worth = F.lit(0.0)
    for s in scores:
        worth = worth + F.coalesce(F.lit(1.0) / (F.col(f"rank_{s}") + k), F.lit(0.0))
    order = Window.partitionBy("grp").orderBy(F.col("worth").desc(), "pos")
    out = ranks.where(some).withColumn("worth", F.round(worth, 10)).withColumn("place", F.row_number().over(order))
    return (out if top is None else out.where(F.col("place") <= top)).select("grp", "pos", "worth", "place")
