"""Attributes of an entity as they were known at an event's time.

Every attribute has a change history of its own: (entity, attribute, known_from, rank, value). A change counts from
the later of the moment it holds from and the moment it was recorded, so at any time the changes that count are a
growing set, and the best of them (latest valid_from, then latest recorded_time, then highest version) is a running
maximum. Each attribute is matched on its own, by a running maximum over its own changes only, so updates of one never
produce versions of another; the matched values stand side by side in the event's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.heavy import heavy_keys

#: Length of the time buckets into which the events of a heavy entity are cut.
BUCKET_S = 3600


def change_histories(
    versions: DataFrame, entity: str, attributes: Sequence[str], valid: str = "valid_from", recorded: str = "recorded_time", version: str = "version_no"
) -> DataFrame:
    """One history per attribute: (entity, attribute, known_from, rank STRUCT, value STRING).

    Exact duplicate rows change nothing. Rows with a null entity, valid or recorded time never count. A null
    attribute value is a value: it says the attribute was empty from then on. A row is kept only where it changes what
    is known: it must outrank all rows known before it, and its value must differ from the one that held until then.
    So an attribute that stays while others change has no rows for their updates.
    """
    rank = F.struct(F.col(valid).alias("valid"), F.col(recorded).alias("recorded"), F.col(version).alias("version"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    rows = (
        versions.where(F.col(entity).isNotNull() & F.col(valid).isNotNull() & F.col(recorded).isNotNull())
        .select(F.col(entity).alias("entity"), F.greatest(valid, recorded).alias("known_from"), rank.alias("rank"), each.alias("c"))
        .select("entity", "c.attribute", "known_from", "rank", "c.value")
    )
    line = Window.partitionBy("entity", "attribute").orderBy("known_from", "rank", "value")
    held = F.max(F.struct("rank", "value")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    changes = F.col("held").isNull() | ((F.struct("rank", "value") > F.col("held")) & ~F.col("value").eqNullSafe(F.col("held.value")))
    return rows.withColumn("held", held).where(changes).drop("held")


def as_known(
    events: DataFrame, versions: DataFrame, entity: str, time: str, attributes: Sequence[str], *, keys: list | None = None, span: tuple[datetime, datetime] | None = None,
    valid: str = "valid_from", recorded: str = "recorded_time", version: str = "version_no",
) -> DataFrame:
    """``events`` with each attribute of ``versions`` as known at ``time``: columns known_<attribute> and has_<attribute>.

    has_<attribute> is false where no change counted yet (also for a null entity or time); the value is then null.
    Repeated event rows stay repeated. Columns of ``events`` keep their names, so names shared with ``versions``
    do not clash.

    Events and changes are united, sorted by time within the entity and carried forward; there is no range join,
    and events are not multiplied by the number of attributes. Entities that hold a large share of the events are cut into hourly buckets, and every bucket starts
    with the change that held when it began, so no task receives all events of one entity. ``keys`` are those
    entities and ``span`` the first and last moment of the events; where they are given, events are read once.
    """
    attributes = list(attributes)
    history = change_histories(versions, entity, attributes, valid, recorded, version)
    hot = heavy_keys(events, entity) if keys is None else keys
    bucket = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / F.lit(BUCKET_S * 1_000_000)).cast("long")
    zero = F.lit(0).cast("long")
    state_type = T.StructType([T.StructField("rank", history.schema["rank"].dataType), T.StructField("value", T.StringType())])

    changes = history.select("entity", "attribute", F.col("known_from").alias("t"), F.struct("rank", "value").alias("state"))
    own = changes.withColumn("bucket", zero)
    if hot:
        heavy = changes.where(F.col("entity").isin(hot)).withColumn("bucket", bucket)
        parts = [own.where(~F.col("entity").isin(hot)), heavy]
        ends = events.where(F.col(entity).isin(hot)).agg(F.min(time), F.max(time)).first() if span is None else span
        if ends[0] is not None:
            b0, b1 = (int(x.replace(tzinfo=UTC).timestamp() // BUCKET_S) for x in ends)
            line = Window.partitionBy("entity", "attribute").orderBy("t")
            upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            held = heavy.select("entity", "attribute", "bucket", F.max("state").over(upto).alias("state"), F.lead("bucket").over(line).alias("next"))
            first = F.greatest(F.col("bucket") + 1, F.lit(b0))
            last = F.least(F.coalesce("next", F.lit(b1)), F.lit(b1))
            carried = held.where(first <= last).select("entity", "attribute", F.explode(F.sequence(first, last)).alias("bucket"), "state")
            start = (F.col("bucket") * BUCKET_S).cast("timestamp").cast(history.schema["known_from"].dataType)
            parts.append(carried.select("entity", "attribute", start.alias("t"), "state", "bucket"))
        own = parts[0]
        for part in parts[1:]:
            own = own.unionByName(part)

    states = [f"s{i}" for i in range(len(attributes))]
    apart = own.select("entity", "t", "bucket", F.lit(0).alias("kind"), *[F.when(F.col("attribute") == a, F.col("state")).alias(s) for s, a in zip(states, attributes)])
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    asked = events.select(F.col(entity).alias("entity"), F.col(time).alias("t"), row.alias("row"), F.lit(1).alias("kind"))
    asked = asked.withColumn("bucket", F.when(F.col("entity").isin(hot), bucket).otherwise(zero) if hot else zero)
    both = apart.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("entity", "bucket").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.select("entity", "t", "kind", "row", *[F.max(s).over(upto).alias(s) for s in states]).where("kind = 1")
    known = F.col("entity").isNotNull() & F.col("t").isNotNull()
    picked = {a: F.when(known, F.col(s)).cast(state_type) for s, a in zip(states, attributes)}
    kinds = {a: versions.schema[a].dataType for a in attributes}
    return matched.select(
        *[F.col(f"row.`{c}`").alias(c) for c in events.columns],
        *[s["value"].cast(kinds[a]).alias(f"known_{a}") for a, s in picked.items()],
        *[s.isNotNull().alias(f"has_{a}") for a, s in picked.items()],
    )
