"""How much a term marks out a record among all records.

Term counts of a record, record frequencies and collection frequencies are counted over all records. A term's weight
is its part of the relative entropy between the record's Dirichlet-smoothed term distribution and the collection's,
or tf * ln(n / df) where a caller needs that scale. Terms in fewer than ``min_df`` records are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.heavy import heaviest, join_on_skewed_key
from rankloom.operators.lineage import cut_lineage

#: Pseudo-tokens of the collection distribution that are added to every record.
DIRICHLET_MU = 50.0
#: Terms: runs of letters, digits and underscore of two or more characters.
TERM = r"[\p{L}\p{N}_]{2,}"


def joined_text(*columns: str) -> Column:
    """Lower-cased columns with one space between them, null as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def term_counts(records: DataFrame, record: str, text: Column) -> DataFrame:
    """(id, dl, term, tf). One row per record is expected; repeated (id, text) rows are one. Null ids are left out.

    The counts are checkpointed, so texts are split into terms once.
    """
    words = records.where(F.col(record).isNotNull()).select(F.col(record).alias("id"), text.alias("text"))
    words = words.repartition("id").dropDuplicates(["id", "text"]).select("id", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("w"))
    return cut_lineage(words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))


def term_weights(counts: DataFrame, score: str = "divergence", min_df: int = 2, mu: float = DIRICHLET_MU) -> DataFrame:
    """(id, term, tf, df, weight) of every term with min_df <= df < number of records that have any term.

    ``score``: "divergence" is p(t|d) * ln(p(t|d) / p(t)) with p(t|d) = (tf + mu * p(t)) / (dl + mu); "tf_idf" is
    tf * ln(n / df). The join of counts with frequencies splits off the terms that most records share.
    """
    sums = counts.groupBy("id", "dl").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).first()
    n, tokens = sums["n"], sums["tokens"] or 0
    freq = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= min_df) & (F.col("df") < n))
    rows = join_on_skewed_key(counts, freq, "term", heaviest(freq, "term", "df"), "inner")
    if score == "tf_idf":
        weight = F.col("tf") * F.ln(F.lit(float(n)) / F.col("df"))
    elif score == "divergence":
        p = F.col("cf") / F.lit(float(max(tokens, 1)))
        q = (F.col("tf") + F.lit(mu) * p) / (F.col("dl") + F.lit(mu))
        weight = q * F.ln(q / p)
    else:
        raise ValueError(f"unknown score {score}")
    return rows.select("id", "term", "tf", "df", weight.alias("weight"))


def top_terms(weights: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """The k heaviest terms of every record, ties by the smaller term in code points: (id, term, weight, place).

    ``decimals`` rounds weights first, so that ties do not hang on the last bits.
    """
    w = weights if decimals is None else weights.withColumn("weight", F.round("weight", decimals))
    order = Window.partitionBy("id").orderBy(F.col("weight").desc(), "term")
    return w.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "term", "weight", "place")
