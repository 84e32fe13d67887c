"""A learned ranker: feature assembly, gradient-boosted trees, importance, ablations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import boosting
from rankloom.operators.lineage import cut_lineage
from rankloom.operators.ranking import metric_means, slate_metrics

#: Rows of one group of the permutation.
GROUP_ROWS = 200_000
# The feature lists.
COUNTS = ("pop_total", "pop_24h", "pop_1h", "ctr_total", "ctr_24h")
WITH_CATEGORY = (*COUNTS, "bm25", "semantic", "slate_size", "cat_affinity", "history_len")
WITH_AGE = (*COUNTS, "age_hours", "bm25", "semantic", "slate_size", "history_len")
SKEW_RESISTANT = ("pop_total", "ctr_total", "bm25", "semantic", "slate_size", "cat_affinity", "history_len")


def category_affinity(pairs: DataFrame, histories: DataFrame, categories: DataFrame, key: str, item: str = "article_id") -> DataFrame:
    """(key, item, cat_affinity): share of the history's articles of known category that have the item's category.

    ``histories`` is (key, article_ids), ``categories`` (article_id, category). Without history or category: 0.
    """
    reads = histories.select(key, F.explode("article_ids").alias("article_id")).join(categories, "article_id")
    shares = reads.groupBy(key, "category").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    wanted = pairs.select(key, item).distinct()
    named = wanted.join(categories.select(F.col("article_id").alias(item), "category"), item, "left")
    return named.join(shares, [key, "category"], "left").select(key, item, F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("cat_affinity"))


def article_age(time: str = "ts", published: str = "published_time"):
    """Hours since publication; -1.0 if either time is missing."""
    gone = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(published).cast("timestamp"))
    return F.coalesce(gone / F.lit(3_600_000_000.0), F.lit(-1.0))


def fit(rows: DataFrame, features: Sequence[str], label: str = "label", iterations: int = boosting.ITERATIONS, most_rows: int | None = None, seed: int = boosting.SEED) -> boosting.Model:
    """Gradient-boosted trees on the features; null and NaN features count as 0, labels above 0 as 1.

    Fitted on all rows. They are gathered as one column after the other; ``most_rows``, where it is given, takes a
    sample of about as many by a hash of the row instead. Rows are sorted first, so the same table gives the same model.
    """
    table = _filled(rows, features).select(*features, (F.col(label) > 0).cast("double").alias("__y"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(seed)).alias("__h"))
    if most_rows is not None and (n := rows.count()) > most_rows:
        table = table.where(F.pmod("__h", F.lit(1 << 30)) < F.lit(int(most_rows / n * (1 << 30))))
    got = table.toArrow()
    columns = {c: got[c].to_numpy() for c in ("__h", *features, "__y")}
    del got
    order = np.lexsort([columns[c] for c in reversed(columns)])
    x = np.empty((len(order), len(features)), order="F")
    for j, f in enumerate(features):
        x[:, j] = columns.pop(f)[order]
    return boosting.fit(x, (columns["__y"][order] > 0).astype(float), features, iterations)


def _filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.when(F.isnan(F.col(f).cast("double")), 0.0).otherwise(F.col(f).cast("double")), F.lit(0.0)) for f in features})


def _probability(model: boosting.Model):
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    return predict


def score(model: boosting.Model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds gbt: the probability of a click."""
    return _filled(rows, features).withColumn("gbt", _probability(model)(*features))


def area(rows: DataFrame, score_column: str, label: str = "label") -> float:
    """AUC over all rows together: ranks from the histogram of scores, so equal scores share their mean rank."""
    got = areas(rows.select(F.lit(0).alias("one"), F.col(score_column).alias("b"), F.col(label).alias("label")), ["one"]).first()
    return float("nan") if got is None or got["auc"] is None else got["auc"]


def areas(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, auc): AUC of rows (by, b, label) per group, from the histogram of the scores b; null where labels are alike."""
    h = rows.groupBy(*by, "b").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("double")).alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = h.withColumn("r", below + (F.col("n") + 1) / 2.0).groupBy(*by).agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = (F.col("rp") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), auc).alias("auc"))


def permutation_importance(model: boosting.Model, rows: DataFrame, features: Sequence[str], label: str = "label", repeats: int = 3, bins: int = 10_000, seed: int = 0) -> DataFrame:
    """(feature, importance): mean loss of AUC when the feature's values are dealt out anew.

    In each repeat every row meets another one, by its number in two hash orders; with the other row's value in place
    of its own it is scored once for each feature. Orders are made in groups of at most about GROUP_ROWS rows. Scores
    are put into ``bins`` for the AUC.
    """
    kept = cut_lineage(_filled(rows, features).select(*features, F.col(label).alias("label"), F.monotonically_increasing_id().alias("id")))
    groups = max(1, -(-kept.count() // GROUP_ROWS))
    predict = _probability(model)
    binned = lambda columns: F.floor(predict(*columns) * bins)
    own = [F.col(f) for f in features]
    parts = [kept.select(F.lit(-1).alias("repeat"), F.lit("").alias("feature"), binned(own).alias("b"), "label")]
    for i in range(repeats):
        group = F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(groups)).alias("g")
        order = lambda salt: F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id", F.lit(salt)), "id")).alias("r")
        left = kept.select("*", group).select("*", order(2 * (seed + i) + 1))
        right = kept.select(*[F.col(f).alias(f"other_{f}") for f in features], "id", group).select("g", order(2 * (seed + i) + 2), *[f"other_{f}" for f in features])
        met = left.join(right, ["g", "r"])
        each = [F.struct(F.lit(f).alias("feature"), binned([F.col(f"other_{c}") if c == f else F.col(c) for c in features]).alias("b")) for f in features]
        parts.append(met.select(F.lit(i).alias("repeat"), F.explode(F.array(*each)).alias("e"), "label").select("repeat", "e.feature", "e.b", "label"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = cut_lineage(areas(every, ["repeat", "feature"]))
    whole = found.where("repeat < 0").select(F.col("auc").alias("whole"))
    return found.where("repeat >= 0").join(F.broadcast(whole)).groupBy("feature").agg(F.avg(F.col("whole") - F.col("auc")).alias("importance"))


def compare_features(variants: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]], key: Sequence[str], iterations: int = boosting.ITERATIONS) -> DataFrame:
    """(variant, n_impressions, n_auc_defined, auc, mrr, mrr_first, ndcg5, ndcg10) of refits: train and test rows and features of each."""
    out = None
    for name, (train, test, features) in variants.items():
        scored = score(fit(train, features, iterations=iterations), test, features)
        means = metric_means(slate_metrics(scored, key, "gbt")).select(F.lit(name).alias("variant"), "*")
        out = means if out is None else out.unionByName(means)
    return out


def kept_features(compared: DataFrame, baseline: str) -> DataFrame:
    """(variant, auc, keep): whether a variant's mean AUC is at least that of ``baseline``; the baseline keeps itself."""
    base = compared.where(F.col("variant") == baseline).select(F.col("auc").alias("__base"))
    return compared.join(F.broadcast(base)).select("variant", "auc", F.coalesce(F.col("auc") >= F.col("__base"), F.lit(False)).alias("keep"))


def three_cutoffs(rows: DataFrame, time: str, count_end: str, fit_end: str, eval_end: str) -> dict[str, DataFrame]:
    """Rows for counts (before count_end), for fitting [count_end, fit_end) and for evaluation [fit_end, eval_end)."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    t = F.col(time)
    return {"counts": rows.where(t < at(count_end)), "fit": rows.where((t >= at(count_end)) & (t < at(fit_end))), "eval": rows.where((t >= at(fit_end)) & (t < at(eval_end)))}


def file_order_split(rows: DataFrame, order: Sequence[str], share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """First ``share`` of the rows in the given order, and the rest; the border is the order's value at that place.

    The border is found by counting per range partition, not by numbering all rows in one task.
    """
    keyed = rows.withColumn("__k", F.struct(*order))
    at = keyed.repartitionByRange("__k").sortWithinPartitions("__k").withColumn("__p", F.spark_partition_id()).cache()
    counts = sorted((r["__p"], r["count"]) for r in at.groupBy("__p").count().collect())  # one row per partition
    want, seen = int(share * sum(c for _, c in counts)), 0
    cut = (counts[-1][0] + 1, 0) if counts else (0, 0)
    for p, c in counts:
        if seen + c > want:
            cut = (p, want - seen)
            break
        seen += c
    edge = at.where(F.col("__p") == cut[0]).withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__k")))
    first = at.where(F.col("__p") < cut[0]).unionByName(edge.where(F.col("__r") <= cut[1]).drop("__r"))
    rest = at.where(F.col("__p") > cut[0]).unionByName(edge.where(F.col("__r") > cut[1]).drop("__r"))
    return first.drop("__k", "__p"), rest.drop("__k", "__p")
