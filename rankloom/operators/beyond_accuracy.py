"""What recommended lists are like apart from being right: diversity, novelty, coverage, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diversity(lists: DataFrame, key: Sequence[str], category: str = "category") -> DataFrame:
    """(key, n, diversity): share of all pairs of a list whose categories differ; a list of one has 0.

    Computed from category counts, not from pairs. A null category is the category "?".
    """
    c = lists.groupBy(*key, F.coalesce(category, F.lit("?")).alias("c")).agg(F.count("*").alias("m"))
    per = c.groupBy(*key).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("same"))
    return per.select(*key, "n", F.when(F.col("n") > 1, 1 - F.col("same") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("diversity"))


def novelty(items: DataFrame, counts: DataFrame, item: str = "article_id", count: str = "click_count") -> DataFrame:
    """Adds novelty: -log2 of the item's share of all clicks; items never clicked count as clicked once. No clicks at all: 0."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    if not total:
        return items.withColumn("novelty", F.lit(0.0))
    joined = items.join(counts.select(item, F.col(count).alias("__n")), item, "left")
    return joined.withColumn("novelty", -F.log2(F.coalesce("__n", F.lit(1)) / F.lit(float(total)))).drop("__n")


def coverage_and_gini(lists: DataFrame, catalogue_size: int, item: str = "article_id") -> DataFrame:
    """One row: n_items recommended, coverage of the catalogue, and the Gini index of exposure over those items.

    Ranks come from the histogram of exposure counts: the m items of a count v take the ranks r+1 .. r+m, whose
    sum is known, so no task sorts the catalogue. Empty lists or an empty catalogue give 0.
    """
    exposure = lists.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("v"))
    sizes = exposure.groupBy("v").agg(F.count("*").cast("double").alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranks = sizes.withColumn("r", below).select("v", "m", (F.col("v") * (F.col("m") * F.col("r") + F.col("m") * (F.col("m") + 1) / 2)).alias("rv"))
    sums = ranks.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("n"), F.sum(F.col("m") * F.col("v")).alias("t"), F.sum("rv").alias("rv"))
    gini = F.when(F.col("n") > 0, 2 * F.col("rv") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    covered = F.col("n") / F.lit(float(catalogue_size)) if catalogue_size else F.lit(0.0)
    return sums.select(F.col("n").cast("long").alias("n_items"), covered.alias("coverage"), gini.alias("gini"))


def candidate_coverage(candidates: DataFrame, known: DataFrame, item: str = "article_id") -> DataFrame:
    """One row: distinct candidates, how many of them are known, and their share (0 without candidates)."""
    marked = candidates.select(item).where(F.col(item).isNotNull()).distinct().join(known.select(item).distinct().withColumn("k", F.lit(1)), item, "left")
    return marked.agg(F.count("*").alias("n_candidates"), F.count("k").alias("n_known"), F.coalesce(F.count("k") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"))
