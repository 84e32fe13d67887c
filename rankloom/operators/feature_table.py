"""One feature row per entity from a log of events of many types.

The log is shuffled once, by entity, with its lists still packed. Behind that shuffle every step is local to the
entity: copies are merged, lists are unpacked into events, the events of an (entity, type) become a counter and a
latest time, and an entity's counters one wide row. Counters are kept in a hash aggregate, which needs no sort of the
events; it falls back to sorted runs by itself where an entity's types do not fit. Entities that hold a large share of
the log are salted by row and get one small second aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.heavy import heavy_keys, join_on_skewed_key, salt

#: Most rows of a lookup table that is broadcast (about 85 bytes each as measured, so 85 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
SALTS = 64
#: Most event types that get columns of their own; type_rows takes any number.
MAX_TYPES = 4_000
#: Wide rows that are built at a time.
WIDE_BLOCK = 500


def article_types(articles: DataFrame) -> DataFrame:
    """(article_id, kind): category_str trimmed and in lower case; rows without one are left out.

    If rows of one article disagree, the smallest category is taken.
    """
    kind = F.lower(F.trim("category_str"))
    return articles.where(F.col("article_id").isNotNull() & (kind != "")).groupBy("article_id").agg(F.min(kind).alias("kind"))


def entity_events(log: DataFrame, lookup: DataFrame, keys: list | None = None) -> tuple[DataFrame, bool]:
    """Counts and last times per entity and event type: (user_id, event_type, n, last_time), and whether salted.

    ``log`` has impression_id, user_id, impression_time, article_ids_inview and article_ids_clicked. A view is a
    distinct id of the first list, a click a distinct id of the second that the first holds. Null and 0 users, null
    lists and null ids give nothing. event_type is view:<kind> or click:<kind>, kind none where unknown.
    """
    log = log.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0))
    hot = heavy_keys(log, "user_id") if keys is None else keys
    log = log.where(F.size("article_ids_inview") > 0)
    part = salt(F.col("user_id"), hot, F.struct("impression_id", "impression_time"), SALTS)
    packed = log.select("user_id", part.alias("part"), "impression_id", "impression_time", "article_ids_inview", "article_ids_clicked")
    once = (
        packed.repartition("user_id", "part") if hot else packed.repartition("user_id")
    ).dropDuplicates(["user_id", "part", "impression_id", "impression_time"])
    seen = F.array_distinct("article_ids_inview")
    tagged = F.transform(seen, lambda a: F.struct(a.alias("article_id"), F.coalesce(F.array_contains("article_ids_clicked", a), F.lit(False)).alias("clicked")))
    views = once.select("user_id", "part", "impression_time", F.explode(tagged).alias("e")).select("user_id", "part", "impression_time", "e.*")
    views = views.where("article_id IS NOT NULL")
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        typed = views.join(F.broadcast(lookup), "article_id", "left")
    else:
        asked = log.select(F.explode("article_ids_inview").alias("article_id"))  # before the shuffle, so nothing runs twice
        typed = join_on_skewed_key(views, lookup, "article_id", heavy_keys(asked, "article_id"))
    runs = typed.groupBy("user_id", "part", "kind").agg(
        F.count("*").alias("nv"), F.max("impression_time").alias("tv"), F.count(F.when(F.col("clicked"), 1)).alias("nc"), F.max(F.when(F.col("clicked"), F.col("impression_time"))).alias("tc")
    )
    kind = F.coalesce("kind", F.lit("none"))
    pair = F.array(
        F.struct(F.concat(F.lit("view:"), kind).alias("event_type"), F.col("nv").alias("n"), F.col("tv").alias("last_time")),
        F.struct(F.concat(F.lit("click:"), kind).alias("event_type"), F.col("nc").alias("n"), F.col("tc").alias("last_time")),
    )
    out = runs.select("user_id", "part", F.explode(pair).alias("e")).select("user_id", "part", "e.*").where("n > 0")
    if hot:
        few = out.where(F.col("user_id").isin(hot)).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max("last_time").alias("last_time"))
        out = out.where(~F.col("user_id").isin(hot)).drop("part").unionByName(few)
    return out.select("user_id", "event_type", "n", "last_time"), bool(hot)


def event_types(lookup: DataFrame) -> list[str]:
    """Every event type the lookup can give, sorted; more than MAX_TYPES raise, since a row cannot be that wide."""
    kinds = [r[0] for r in lookup.select("kind").distinct().limit(MAX_TYPES // 2).collect()]
    if len(kinds) > MAX_TYPES // 2 - 1:
        raise ValueError(f"more than {MAX_TYPES} event types: use type_rows")
    return sorted(f"{event}:{kind}" for event in ("view", "click") for kind in {*kinds, "none"})


def wide_rows(events: DataFrame, types: Sequence[str], as_of: str) -> DataFrame:
    """One row per entity: <type>_n and <type>_days for each of ``types``, and n_all, n_types, last_time.

    Colons in types become underscores. _n is 0 and _days (since the last event, up to as_of) null where the type
    never occurred. Types that are not named still count in the last three. An entity has at most one event row per
    type, so its list is bounded by the number of types; rows are spread out by array arithmetic, a block at a time.
    The grouping reuses the partitioning by entity of ``events``.
    """
    stems = [t.replace(":", "_") for t in types]
    fields = [f for s in stems for f in (T.StructField(f"{s}_n", T.LongType()), T.StructField(f"{s}_days", T.DoubleType()))]
    schema = T.StructType([events.schema["user_id"], *fields, T.StructField("n_all", T.LongType()), T.StructField("n_types", T.LongType()), T.StructField("last_time", events.schema["last_time"].dataType)])
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    one = F.struct("event_type", "n", (at - F.unix_micros(F.col("last_time").cast("timestamp"))).alias("gone"))
    rows = events.groupBy("user_id").agg(F.collect_list(one).alias("e"), F.sum("n").alias("n_all"), F.count("*").alias("n_types"), F.max("last_time").alias("last_time"))
    names, width = [f.name for f in schema], len(stems)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(types), pa.string())
        for whole in batches:
            for s in range(0, whole.num_rows, WIDE_BLOCK):
                b = whole.slice(s, WIDE_BLOCK)
                flat = b.column("e").flatten()
                row = np.repeat(np.arange(b.num_rows), b.column("e").value_lengths().to_numpy(zero_copy_only=False))
                at_type = pc.fill_null(pc.index_in(flat.field("event_type"), value_set=known), -1).to_numpy(zero_copy_only=False)
                ok = at_type >= 0
                count, gone = np.zeros((width, b.num_rows), np.int64), np.full((width, b.num_rows), np.nan)
                count[at_type[ok], row[ok]] = flat.field("n").to_numpy(zero_copy_only=False)[ok]
                gone[at_type[ok], row[ok]] = flat.field("gone").to_numpy(zero_copy_only=False)[ok] / 86_400_000_000.0
                wide = [a for i in range(width) for a in (pa.array(count[i]), pa.array(gone[i], mask=np.isnan(gone[i])))]
                yield pa.RecordBatch.from_arrays([b.column("user_id"), *wide, b.column("n_all"), b.column("n_types"), b.column("last_time")], names)

    return rows.mapInArrow(spread, schema)


def type_rows(events: DataFrame) -> DataFrame:
    """One row per entity with all its types: event_types, counts and last_times in one order, and n_all, n_types, last_time.

    The lists are sorted by event_type and hold the types that occurred, whatever their number. The grouping reuses
    the partitioning by entity of ``events``.
    """
    one = F.struct("event_type", "n", "last_time")
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("e"), F.sum("n").alias("n_all"), F.count("*").alias("n_types"), F.max("last_time").alias("last_time"))
    return rows.select("user_id", F.col("e.event_type").alias("event_types"), F.col("e.n").alias("counts"), F.col("e.last_time").alias("last_times"), "n_all", "n_types", "last_time")
