"""Ranks, top k, fusion of rankers and ranking metrics of slates. Ties always go to the smaller position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rank(key: Sequence[str], score: str, pos: str = "pos") -> Column:
    """1-based rank in the slate, score descending, null scores last, ties by position."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), pos))


def top_k(df: DataFrame, key: Sequence[str], score: str, k: int, pos: str = "pos") -> DataFrame:
    """The k best rows of every slate, with their place."""
    return df.withColumn("place", rank(key, score, pos)).where(F.col("place") <= k)


def reciprocal_rank_fusion(df: DataFrame, key: Sequence[str], scores: Sequence[str], k: int = RRF_K, pos: str = "pos") -> DataFrame:
    """Adds rrf: the sum over rankers of 1 / (k + rank)."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.lit(1.0) / (rank(key, s, pos) + F.lit(k))
    return df.withColumn("rrf", total)


def min_max(key: Sequence[str], score: str) -> Column:
    """Score scaled to 0..1 within its slate; 0.0 everywhere in a slate without spread."""
    w = Window.partitionBy(*key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0))


def weighted_sum(df: DataFrame, key: Sequence[str], scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Adds fused: the weighted sum of min-max scaled scores."""
    if len(scores) != len(weights):
        raise ValueError(f"{len(scores)} scores but {len(weights)} weights")
    total = F.lit(0.0)
    for s, w in zip(scores, weights):
        total = total + F.lit(float(w)) * min_max(key, s)
    return df.withColumn("fused", total)


def slate_metrics(df: DataFrame, key: Sequence[str], score: str, label: str = "label", pos: str = "pos", at: Sequence[int] = (5, 10)) -> DataFrame:
    """Per slate: n, n_positive, auc, mrr, mrr_first, ndcg<k>. One shuffle by the slate's key.

    auc uses average ranks for ties and is null if all labels are alike; a null score counts as lowest. mrr is the
    sum of label / rank over the sum of labels, mrr_first 1 / rank of the first relevant candidate, both 0 without
    one. ndcg uses gain 2^label - 1 and discount log2(rank + 1), 0 if the ideal is 0. Labels may be graded; for auc
    any label above 0 is positive.
    """
    whole = Window.partitionBy(*key)
    low = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    x = df.withColumn("__s", low)
    x = x.withColumn("__rk", F.row_number().over(whole.orderBy(F.col("__s").desc(), pos)))
    x = x.withColumn("__low", F.rank().over(whole.orderBy("__s")) + (F.count("*").over(Window.partitionBy(*key, "__s")) - 1) / F.lit(2.0))
    x = x.withColumn("__best", F.row_number().over(whole.orderBy(F.col(label).desc(), pos)))
    positive = F.col(label) > 0
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    sums = [
        F.count("*").alias("n"), F.count(F.when(positive, 1)).alias("n_positive"), F.sum(F.when(positive, F.col("__low"))).alias("__r"),
        F.sum(F.col(label) / F.col("__rk")).alias("__lr"), F.sum(label).alias("__l"), F.min(F.when(positive, F.col("__rk"))).alias("__first"),
    ]
    for k in at:
        for name, place in (("d", "__rk"), ("i", "__best")):
            sums.append(F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + F.lit(1.0)))).alias(f"__{name}{k}"))
    g = x.groupBy(*key).agg(*sums)
    p, n = F.col("n_positive").cast("double"), F.col("n").cast("double")
    auc = F.when((p > 0) & (p < n), (F.col("__r") - p * (p + 1) / 2) / (p * (n - p)))
    zero = F.lit(0.0)
    return g.select(
        *key, "n", "n_positive", auc.alias("auc"), F.when(F.col("__l") > 0, F.col("__lr") / F.col("__l")).otherwise(zero).alias("mrr"),
        F.coalesce(F.lit(1.0) / F.col("__first"), zero).alias("mrr_first"),
        *[F.when(F.col(f"__i{k}") > 0, F.col(f"__d{k}") / F.col(f"__i{k}")).otherwise(zero).alias(f"ndcg{k}") for k in at],
    )


def metric_means(per_slate: DataFrame, by: Sequence[str] = (), at: Sequence[int] = (5, 10)) -> DataFrame:
    """Macro means with both denominators: n_impressions, and n_auc_defined for auc."""
    return per_slate.groupBy(*by).agg(
        F.count("*").alias("n_impressions"), F.count("auc").alias("n_auc_defined"), F.avg("auc").alias("auc"), F.avg("mrr").alias("mrr"), F.avg("mrr_first").alias("mrr_first"),
        *[F.avg(f"ndcg{k}").alias(f"ndcg{k}") for k in at],
    )


def head_items(counts: DataFrame, item: str = "article_id", count: str = "click_count", share: int = 5) -> DataFrame:
    """The most clicked max(1, n // share) items, ties by smaller id: (item).

    The count at the border is found on the histogram of counts, so items are never ranked in one task.
    """
    n = counts.count()
    want = max(1, n // share) if n else 0
    sizes = counts.groupBy(F.col(count).alias("v")).agg(F.count("*").alias("m"))
    upto = Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = sizes.withColumn("upto", F.sum("m").over(upto)).where(F.col("upto") >= want).orderBy(F.col("v").desc()).first() if want else None
    if border is None:
        return counts.select(item).limit(0)
    sure = counts.where(F.col(count) > border["v"]).select(item)
    rest = want - (border["upto"] - border["m"])
    return sure.unionByName(counts.where(F.col(count) == border["v"]).select(item).orderBy(item).limit(int(rest)))


def slices(history_len: Column, in_head: Column, cold: int = 5) -> Column:
    """The slices of an impression, to explode: all, cold_start or warm, head or tail."""
    return F.array(F.lit("all"), F.when(history_len <= cold, "cold_start").otherwise("warm"), F.when(in_head, "head").otherwise("tail"))
