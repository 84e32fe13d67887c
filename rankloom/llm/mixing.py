"""Mixing sources to target weights, with a cap on repeats.

Documents fall into cells of source, language and topic. The cells' token sums, a table bounded by the number of
cells, are raked by iterative proportional fitting: to each source's wanted tokens, and to the corpus's own shares of
languages and topics, never beyond a source's repeat cap. The fit is given what a source should have, not what it
can: a source that cannot reach its share ends with all its cells at the cap. A cell's factor is the expected number of
uses of its documents; a document is used the whole part of it, and once more with the probability of the fraction,
decided by a hash of its id. The probabilities are calibrated per source on a histogram of those hashes over all
documents, so the tokens drawn meet the tokens wanted.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.lineage import cut_lineage

#: Most cells that are gathered on the driver (three short strings and a number each); more are raked as a table.
MAX_CELLS = 200_000
#: Bins of the calibration histogram of a source.
BINS = 2_000
#: A cell within this part of its cap is at the cap.
AT_CAP = 1 - 1e-12
# Language codes of three letters, and the two-letter codes they stand for.
LONG_CODES = {"dan": "da", "eng": "en", "deu": "de", "ger": "de", "swe": "sv", "nor": "no", "fra": "fr", "fre": "fr", "spa": "es", "jpn": "ja", "zho": "zh", "ara": "ar", "tha": "th", "hin": "hi", "rus": "ru", "ell": "el"}


def same_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def same_language(lang: Column) -> Column:
    """Two-letter code in lower case; unknown if missing."""
    code = F.substring_index(F.lower(F.trim(lang)), "-", 1)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LONG_CODES.items())])
    return F.coalesce(known[code], F.when(code != "", code), F.lit("unknown"))


def _goal(wanted: float) -> float:
    """Wanted tokens as the fit takes them: none below 0, all there is for NaN, which both engines order last."""
    return float("inf") if np.isnan(wanted) else max(float(wanted), 0.0)


def rake(cells: pd.DataFrame, wanted: dict, most: dict, rounds: int = 60) -> np.ndarray:
    """Expected uses of every cell (source, lang, topic, tokens), fitted to the three margins.

    ``wanted``: tokens per source, also more than it can give; ``most``: cap on uses per source. The source margin is
    fitted last and exactly, the others as far as it and the caps allow. All cells of a source that can give no more
    than is wanted end at the cap itself.
    """
    tokens = cells["tokens"].to_numpy(float)
    cap = cells["source"].map(most).to_numpy(float)
    uses = np.minimum(np.ones(len(cells)), cap)
    groups = {c: pd.factorize(cells[c]) for c in ("source", "lang", "topic")}
    goal = np.array([_goal(wanted[s]) for s in groups["source"][1]], dtype=float)
    total = np.minimum(goal, np.bincount(groups["source"][0], tokens * cap, len(goal))).sum()

    def to_sources() -> None:
        code = groups["source"][0]
        while True:  # what a capped cell cannot take goes to the source's other cells; every pass but the last caps one
            free = uses < cap
            held = np.bincount(code, tokens * uses * ~free, len(goal))
            room = np.bincount(code, tokens * uses * free, len(goal))
            factor = np.divide(goal - held, room, out=np.ones_like(goal), where=room > 0)
            moved = np.where(free, uses * np.maximum(factor, 0)[code], uses)
            full = free & (moved >= cap * AT_CAP)
            uses[:] = np.where(full, cap, moved)
            if not full.any():
                break

    for _ in range(rounds):
        before = uses.copy()
        for c in ("lang", "topic"):
            code, names = groups[c]
            own = np.bincount(code, tokens, len(names))
            have = np.bincount(code, tokens * uses, len(names))
            factor = np.divide(own / max(own.sum(), 1e-300) * total, have, out=np.ones(len(names)), where=have > 0)
            uses[:] = np.minimum(uses * factor[code], cap)
        to_sources()
        if np.allclose(before, uses, rtol=1e-6, atol=0):
            break
    return uses


def rake_table(cells: DataFrame, wanted: dict, most: dict, rounds: int = 20, refits: int = 8) -> DataFrame:
    """As ``rake`` for any number of cells: (source, lang, topic, tokens, uses), one grouping and join per margin.

    Margins of languages and topics are joined, not gathered; those of sources come from the targets, a bounded list.
    After the rounds the source margin is fitted ``refits`` more times, and on until no further cell comes to its cap,
    so that what capped cells cannot take goes to the source's other cells.
    """
    spark = cells.sparkSession
    goals = F.broadcast(spark.createDataFrame([(k, _goal(wanted[k]), float(most[k])) for k in wanted], "source string, goal double, cap double"))
    held = {r["source"]: float(r["t"]) for r in cells.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one row per target source
    total = sum(min(_goal(wanted[k]), t * most[k]) for k, t in held.items())
    whole = sum(held.values()) or 1.0
    now = cells.join(goals, "source").withColumn("uses", F.least(F.lit(1.0), "cap"))

    def to_margin(df: DataFrame, c: str) -> DataFrame:
        sums = df.groupBy(c).agg((F.sum("tokens") / whole * total).alias("aim"), F.sum(F.col("tokens") * F.col("uses")).alias("have"))
        factor = F.when(F.col("have") > 0, F.col("aim") / F.col("have")).otherwise(F.lit(1.0))
        return df.join(sums, c).withColumn("uses", F.least(F.col("uses") * factor, "cap")).drop("aim", "have")

    def to_sources(df: DataFrame) -> DataFrame:
        used, free = F.col("tokens") * F.col("uses"), F.col("uses") < F.col("cap")
        sums = df.groupBy("source").agg(F.sum(F.when(~free, used).otherwise(F.lit(0.0))).alias("held"), F.sum(F.when(free, used).otherwise(F.lit(0.0))).alias("open"))
        factor = F.when(F.col("open") > 0, F.greatest((F.col("goal") - F.col("held")) / F.col("open"), F.lit(0.0))).otherwise(F.lit(1.0))
        moved = df.join(F.broadcast(sums), "source").withColumn("moved", F.when(free, F.col("uses") * factor).otherwise(F.col("uses")))
        full = free & (F.col("moved") >= F.col("cap") * AT_CAP)
        return moved.withColumns({"uses": F.when(full, F.col("cap")).otherwise(F.col("moved")), "full": full}).drop("held", "open", "moved")

    for _ in range(rounds):
        now = cut_lineage(to_sources(to_margin(to_margin(now, "lang"), "topic")))
    done = 0
    while done < refits or not now.where("full").isEmpty():
        now = cut_lineage(to_sources(now))
        done += 1
    return now.select("source", "lang", "topic", "tokens", "uses")


def source_sizes(documents: DataFrame, targets: DataFrame, tokens: Column) -> DataFrame:
    """Every source of ``targets`` with its size, wanted tokens and reach: one row per target, also without documents.

    (source, key, target_weight, max_repeats, size, wanted, target_share, reachable). Sources match after trimming
    and lower-casing; exact duplicate targets are one; targets without a source are left out. wanted is T *
    weight / (sum of weights), T the sum of the sizes; reachable is false if size * max_repeats < wanted. Null
    weights and repeats count as 0.
    """
    goals = targets.where("source IS NOT NULL").dropDuplicates().select(
        "source", same_source(F.col("source")).alias("key"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    )
    held = documents.groupBy(same_source(F.col("source")).alias("key")).agg(F.sum(tokens).alias("size"))
    rows = goals.join(held, "key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    sums = rows.agg(F.sum("size").alias("t"), F.sum("target_weight").alias("w")).first()
    total, weight = float(sums["t"] or 0), float(sums["w"] or 0) or 1.0
    return rows.withColumns({
        "wanted": F.lit(total) * F.col("target_weight") / F.lit(weight),
        "target_share": F.col("target_weight") / F.lit(weight),
    }).withColumn("reachable", ~(F.col("size") * F.col("max_repeats") < F.col("wanted")))


def mix(documents: DataFrame, targets: DataFrame, tokens: Column, topic: Column, sizes: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often every document is used; documents used 0 times are left out.

    ``documents`` has doc_id, source, lang and what ``tokens`` and ``topic`` read. Documents whose source has no
    target, or without tokens, are never used; uses never exceed the source's max_repeats. A source that cannot
    reach its share is used as often as it may. Beyond MAX_CELLS cells the fit runs on a table.
    """
    goals = (source_sizes(documents, targets, tokens) if sizes is None else sizes).groupBy("key").agg(
        F.min("source").alias("source"), F.min("size").alias("size"), F.sum("wanted").alias("wanted"), F.max("max_repeats").alias("max_repeats")
    )
    plan = {r["key"]: r for r in goals.collect()}  # one row per target source
    wanted = {k: float(r["wanted"]) for k, r in plan.items()}
    most = {k: float(max(0, r["max_repeats"])) for k, r in plan.items()}
    names = documents.sparkSession.createDataFrame([(k, r["source"]) for k, r in plan.items()], "key string, source string")
    drawn = _draw(_sized(documents, list(plan), tokens, topic), wanted, most, seed)
    return drawn.join(F.broadcast(names), "key").select("doc_id", "source", "n_tokens", "uses").where("uses > 0")


def _sized(documents: DataFrame, keys: list, tokens: Column, topic: Column) -> DataFrame:
    """(doc_id, key, lang, topic, n_tokens) of the documents with tokens whose source is one of ``keys``."""
    return documents.select(
        "doc_id", same_source(F.col("source")).alias("key"), same_language(F.col("lang")).alias("lang"), F.coalesce(topic, F.lit("none")).alias("topic"), tokens.cast("long").alias("n_tokens")
    ).where((F.col("n_tokens") > 0) & F.col("key").isin(keys))


def _draw(rows: DataFrame, wanted: dict, most: dict, seed: int) -> DataFrame:
    """(doc_id, key, n_tokens, uses) of all ``rows``: cells of the keys fitted, their documents drawn, uses 0 included."""
    table = rows.groupBy(F.col("key").alias("source"), "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    cells = table.limit(MAX_CELLS + 1).toPandas()
    spark = rows.sparkSession
    if len(cells) > MAX_CELLS:
        factors = rake_table(table, wanted, most).select(F.col("source").alias("key"), "lang", "topic", F.col("uses").alias("expected"))
    else:
        cells["uses"] = rake(cells, wanted, most) if len(cells) else 0.0
        fitted = [tuple(r) for r in cells[["source", "lang", "topic", "uses"]].itertuples(index=False)]
        factors = F.broadcast(spark.createDataFrame(fitted, "key string, lang string, topic string, expected double"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    drawn = rows.join(factors, ["key", "lang", "topic"]).withColumn("sure", F.floor("expected"))
    part = F.col("expected") - F.col("sure")
    drawn = drawn.withColumn("need", F.when(part > 1e-9, u / part))  # drawn once more if need is below the source's level
    level = F.least(F.floor(F.coalesce("need", F.lit(1e9)) * F.lit(BINS / 2.0)), F.lit(BINS)).cast("int")
    histogram = drawn.groupBy("key", level.alias("bin")).agg(F.sum(F.when(F.col("need").isNotNull(), F.col("n_tokens")).otherwise(F.lit(0))).alias("t"), F.sum(F.col("n_tokens") * F.col("sure")).alias("base")).toPandas()
    levels = {}
    for key, g in histogram.groupby("key"):  # at most BINS + 1 rows per target source
        g = g.sort_values("bin")
        missing = wanted[key] - float(g["base"].sum())
        sums = np.concatenate([[0.0], np.cumsum(g["t"].to_numpy(float))])
        edges = np.concatenate([[0], g["bin"].to_numpy() + 1])
        levels[key] = float(edges[int(np.abs(sums - missing).argmin())]) / (BINS / 2.0) if missing > 0 else 0.0
    cut = spark.createDataFrame(list(levels.items()), "key string, level double")
    uses = F.col("sure") + F.when(F.col("need") < F.col("level"), 1).otherwise(0)
    return drawn.join(F.broadcast(cut), "key").select("doc_id", "key", "n_tokens", uses.cast("int").alias("uses"))


def reach(documents: DataFrame, targets: DataFrame, tokens: Column, topic: Column, seed: int = 0) -> DataFrame:
    """(source, max_repeats, wanted, drawn, used_up): what fit and draw give every target, one row per target.

    Targets and wanted as in ``source_sizes``, with nulls and divisions as in SQL; targets that name one source are
    fitted side by side, each from all its documents. used_up: every document is used max_repeats times, also where
    there is none; null without max_repeats. A target that is used up and still has less than wanted is out of reach.
    """
    spark = documents.sparkSession
    goals = targets.where("source IS NOT NULL").dropDuplicates().select("source", same_source(F.col("source")).alias("key"), "target_weight", "max_repeats").collect()
    numbers = F.broadcast(spark.createDataFrame([(str(i), r["key"]) for i, r in enumerate(goals)], "number string, key string"))
    rows = _sized(documents, sorted({r["key"] for r in goals}), tokens, topic).join(numbers, "key").drop("key").withColumnRenamed("number", "key")
    rows = cut_lineage(rows)  # texts are read once
    total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    weight = np.float64(sum(r["target_weight"] or 0.0 for r in goals))
    with np.errstate(divide="ignore", invalid="ignore"):
        wanted = {str(i): None if r["target_weight"] is None else float(total * np.float64(r["target_weight"]) / weight) for i, r in enumerate(goals)}
    most = {str(i): float(max(0, r["max_repeats"] or 0)) for i, r in enumerate(goals)}
    drawn = _draw(rows, {k: w or 0.0 for k, w in wanted.items()}, most, seed)
    plan = spark.createDataFrame([(str(i), r["source"], r["max_repeats"], wanted[str(i)]) for i, r in enumerate(goals)], "key string, source string, max_repeats int, wanted double")
    given = F.least("uses", "max_repeats")  # also where max_repeats is below 0
    got = drawn.join(F.broadcast(plan.select("key", "max_repeats")), "key").groupBy("key").agg(F.sum(F.col("n_tokens") * given).alias("drawn"), F.min(F.col("uses") >= F.col("max_repeats")).alias("all"))
    used_up = F.when(F.col("max_repeats").isNotNull(), F.coalesce("all", F.lit(True)))
    return plan.join(got, "key", "left").select("source", "max_repeats", "wanted", F.coalesce("drawn", F.lit(0).cast("long")).alias("drawn"), used_up.alias("used_up"))


def margins(documents: DataFrame, mixed: DataFrame, topic: Column) -> DataFrame:
    """(margin, name, n_tokens, drawn): tokens in the corpus and in the mix of every language and topic.

    ``documents`` are those the mix was made from; only documents whose source is in the mix's targets take part in
    either sum, so they must be left out before.
    """
    own = documents.select("doc_id", same_language(F.col("lang")).alias("lang"), F.coalesce(topic, F.lit("none")).alias("topic"), "size")
    both = own.join(mixed.select("doc_id", (F.col("n_tokens") * F.col("uses")).alias("drawn")), "doc_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("name")) for m in ("lang", "topic")]))
    return both.select(each.alias("m"), "size", "drawn").groupBy("m.margin", "m.name").agg(F.sum("size").alias("n_tokens"), F.coalesce(F.sum("drawn"), F.lit(0)).alias("drawn"))


def mix_report(sizes: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per target: size, wanted and drawn tokens, target and actual share, documents, largest use, reachable.

    actual_share is the source's part of all drawn tokens, reached its drawn tokens over those wanted. Where some
    sources cannot reach their share, the parts of the others rise above their targets.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn"), F.count("*").alias("n_documents"), F.max("uses").alias("largest_use"))
    total = got.agg(F.sum("drawn")).first()[0] or 1
    out = sizes.join(got, "source", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "source", "size", "target_share", "max_repeats", "reachable", F.round("wanted", 3).alias("wanted"), F.coalesce("drawn", zero).alias("drawn"),
        (F.coalesce("drawn", zero) / F.lit(float(total))).alias("actual_share"), F.when(F.col("wanted") > 0, F.coalesce("drawn", zero) / F.col("wanted")).alias("reached"), F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("largest_use", F.lit(0)).alias("largest_use"),
    )
