"""Prediction lines: writing, reading back, and checking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import rank

# Fixed value: an id, a space, and the ranks in brackets without spaces.
LINE = r"^(\d+) \[(\d+(?:,\d+)*)\]$"


def slate_ranks(df: DataFrame, key: Sequence[str], score: str, pos: str = "pos") -> DataFrame:
    """(key, ranks): every candidate's rank, in the order of the candidates."""
    ranked = df.select(*key, F.col(pos).alias("pos"), rank(key, score, pos).alias("r"))
    return ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias("ranks"))


def line(impression: str = "impression_id", ranks: str = "ranks") -> Column:
    """id [r1,r2,...]"""
    return F.concat(F.col(impression).cast("string"), F.lit(" ["), F.array_join(F.transform(ranks, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, impression_id, ranks, problem) of text lines: problem is null, "format" or "ranks" (no permutation of 1..n)."""
    text = F.col(column)
    good = F.coalesce(text.rlike(LINE), F.lit(False))
    ranks = F.when(good, F.transform(F.split(F.regexp_extract(text, LINE, 2), ","), lambda x: x.try_cast("int")))
    rows = lines.select(text.alias("line"), F.when(good, F.regexp_extract(text, LINE, 1).try_cast("long")).alias("impression_id"), ranks.alias("ranks"))
    whole = F.array_sort("ranks") == F.sequence(F.lit(1), F.size("ranks"))
    problem = F.when(F.col("impression_id").isNull(), "format").when(~F.coalesce(whole, F.lit(False)), "ranks")
    return rows.withColumn("problem", problem)


def validate(lines: DataFrame, expected: DataFrame | None = None, allow_duplicates: bool = False, column: str = "value") -> DataFrame:
    """One row: lines, impressions, duplicate_rows, bad_format, bad_ranks, bad_length, missing, extra, ok.

    ``expected`` has impression_id and, if lengths are to be checked, n_candidates; ids it does not have are extra
    and take no part in the length check. Repeated expected ids count once, with the lengths they allow. An empty file is
    ok if nothing is missing.
    """
    rows = parsed(lines, column)
    per = rows.groupBy("impression_id").agg(F.count("*").alias("c"), F.collect_set(F.size("ranks")).alias("sizes"))
    base = rows.agg(F.count("*").alias("lines"), F.count(F.when(F.col("problem") == "format", 1)).alias("bad_format"), F.count(F.when(F.col("problem") == "ranks", 1)).alias("bad_ranks")).first()
    ids = per.where("impression_id IS NOT NULL")
    zero = F.lit(0).cast("long")
    if expected is None:
        checked = ids.agg(F.count("*").alias("impressions"), F.coalesce(F.sum(F.col("c") - 1), zero).alias("duplicate_rows"), zero.alias("bad_length"), zero.alias("missing"), zero.alias("extra"))
    else:
        sizes = F.collect_set("n_candidates") if "n_candidates" in expected.columns else F.lit(None).cast("array<int>")
        want = expected.where("impression_id IS NOT NULL").groupBy("impression_id").agg(sizes.alias("want"), F.lit(1).alias("e"))
        both = ids.withColumn("g", F.lit(1)).join(want, "impression_id", "full")
        wrong = (F.col("g") == 1) & F.col("want").isNotNull() & (F.size(F.array_except("sizes", F.transform("want", lambda x: x.cast("int")))) > 0)
        checked = both.agg(
            F.count("g").alias("impressions"), F.coalesce(F.sum(F.col("c") - 1), zero).alias("duplicate_rows"), F.count(F.when(wrong, 1)).alias("bad_length"),
            F.count(F.when(F.col("g").isNull(), 1)).alias("missing"), F.count(F.when(F.col("e").isNull(), 1)).alias("extra"),
        )
    out = checked.select(F.lit(base["lines"]).alias("lines"), "impressions", "duplicate_rows", F.lit(base["bad_format"]).alias("bad_format"), F.lit(base["bad_ranks"]).alias("bad_ranks"), "bad_length", "missing", "extra")
    faults = F.col("bad_format") + F.col("bad_ranks") + F.col("bad_length") + F.col("missing") + F.col("extra")
    return out.withColumn("ok", (faults + (F.lit(0) if allow_duplicates else F.col("duplicate_rows"))) == 0)
