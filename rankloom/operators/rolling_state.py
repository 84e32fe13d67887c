"""Rolling totals over trailing periods, kept as versioned daily state.

The state of a day is yesterday's totals, plus today's arrivals, minus the amounts that leave each period:
``total(d) = total(d-1) + amount(d) - amount(d-w)``. A ``StateStore`` is a folder of two tables, written a batch of
days at a time and sorted by day: daily amounts, and states with a version. ``advance`` joins the stored state of the day before with the arrivals and
the expiring amounts, and reads no other day; a daily job calls it for one day, a backfill for blocks of days. Late
amounts are corrections: ``correct`` recomputes the dates they reach, d .. d+w-1, and stores these rows with the next
version. The highest version of a row holds; older ones stay readable.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = (7, 30)
#: Days that a backfill advances at a time.
BLOCK_DAYS = 35


def _day(d: str | date) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


def moves(amounts: DataFrame, first: str | date, last: str | date, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(key, day, d<w>...): by how much each period's total changes on the days first .. last.

    ``amounts`` is (key, day, amount). A day's amounts arrive on it and leave the period of w days w days later. Other
    days' amounts are not used, so only these days and those w days before are read.
    """
    first, last = _day(first), _day(last)
    shifts = (0, *windows)
    within = [F.col("day").between(F.lit(first - timedelta(s)), F.lit(last - timedelta(s))) for s in shifts]
    needed = within[0]
    for w in within[1:]:
        needed = needed | w
    each = F.array(*[F.when(i, F.struct(F.date_add("day", s).alias("at"), F.lit(s).alias("shift"))) for s, i in zip(shifts, within)])
    rows = amounts.where(needed).select("key", "amount", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m"))
    change = lambda w: F.when(F.col("m.shift") == 0, F.col("amount")).when(F.col("m.shift") == w, -F.col("amount")).otherwise(F.lit(0))
    return rows.groupBy("key", F.col("m.at").alias("day")).agg(*[F.sum(change(w)).alias(f"d{w}") for w in windows])


def advance_days(state: DataFrame, amounts: DataFrame, first: str | date, last: str | date, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(key, day, c<w>...) of the days first .. last from ``state`` (key, c<w>...), that of the day before ``first``.

    The totals of the day before are joined with the days' arrivals and expiring amounts. A key on either side has a
    row on every day; missing sides are 0. With first = last this is the step of one day.
    """
    first, last = _day(first), _day(last)
    moved = moves(amounts, first, last, windows)
    packed = moved.groupBy("key").agg(F.collect_list(F.struct("day", *[f"d{w}" for w in windows])).alias("moves"))  # at most one per day
    zero = F.lit(0).cast("long")
    joined = state.select("key", *[f"c{w}" for w in windows]).join(packed, "key", "full")
    days = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    rows = joined.select("key", "moves", *[F.coalesce(f"c{w}", zero).alias(f"c{w}") for w in windows], days)
    upto = lambda w: F.aggregate("moves", zero, lambda s, m: s + F.when(m["day"] <= F.col("day"), m[f"d{w}"]).otherwise(zero))
    return rows.select("key", "day", *[(F.col(f"c{w}") + F.coalesce(upto(w), zero)).alias(f"c{w}") for w in windows])


def reach(corrections: DataFrame, last: str | date, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(key, day, d<w>...): the dates up to ``last`` that late amounts (key, day, amount) reach, and by how much."""
    end = F.lit(_day(last))
    late = corrections.dropna(subset=["key", "day", "amount"]).groupBy("key", F.col("day").cast("date").alias("from_day")).agg(F.sum("amount").alias("amount"))
    return (
        late.where(F.col("from_day") <= end)
        .withColumn("day", F.explode(F.sequence("from_day", F.least(F.date_add("from_day", max(windows) - 1), end))))
        .groupBy("key", "day")
        .agg(*[F.sum(F.when(F.datediff("day", "from_day") < w, F.col("amount")).otherwise(F.lit(0))).alias(f"d{w}") for w in windows])
    )


@dataclass
class StateStore:
    """A folder with the tables ``amounts`` (key, day, amount) and ``states`` (key, day, c<w>..., version).

    ``key`` is the SQL type of the keys. The folder lies where all executors reach it; the caller removes it.
    """

    spark: SparkSession
    folder: str
    key: str
    windows: Sequence[int] = WINDOWS
    last: date | None = None

    @property
    def _totals(self) -> list[str]:
        return [f"c{w}" for w in self.windows]

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        # A batch is written as a whole, so a repeated job replaces its own. rebalance keeps a day's rows together but
        # cuts those of a crowded day into several files; sorted rows let readers of one day skip the others.
        df.hint("rebalance", F.col("day")).sortWithinPartitions("day").write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def amounts(self) -> DataFrame:
        """(key, amount, day) as stored; rows of one key and day add up."""
        return self.spark.read.schema(f"key {self.key}, day date, amount bigint, batch string").parquet(f"{self.folder}/amounts").drop("batch")

    def versions(self) -> DataFrame:
        """(key, day, c<w>..., version): every stored row."""
        totals = ", ".join(f"{c} bigint" for c in self._totals)
        rows = self.spark.read.schema(f"key {self.key}, day date, {totals}, version int, batch string").parquet(f"{self.folder}/states")
        return rows.select("key", "day", *self._totals, "version")

    def states(self) -> DataFrame:
        """(key, day, c<w>..., version): the rows that hold, those of the highest version."""
        best = self.versions().groupBy("key", "day").agg(F.max(F.struct("version", *self._totals)).alias("s"))
        return best.select("key", "day", *[f"s.{c}" for c in self._totals], "s.version")

    def begin(self, amounts: DataFrame, before: str | date, keys: DataFrame | None = None) -> None:
        """Stores daily amounts (key, day, amount) and the state of the day ``before``, from which advance goes on.

        Rows with a null in them are left out; several rows of one key and day add up. The first state has all keys
        of ``amounts`` and of ``keys`` (key), with what lies in their periods by then, mostly zeros.
        """
        before = _day(before)
        rows = amounts.select("key", F.col("day").cast("date").alias("day"), F.col("amount").cast("long").alias("amount")).dropna()
        self._write(rows.groupBy("key", "day").agg(F.sum("amount").alias("amount")), "amounts", "begin")
        every = self.amounts()
        held = [F.sum(F.when(F.col("day").between(F.lit(before - timedelta(w - 1)), F.lit(before)), F.col("amount")).otherwise(F.lit(0))).alias(f"c{w}") for w in self.windows]
        more = every.select("key", "day", "amount")
        if keys is not None:
            more = more.unionByName(keys.select("key").dropna().withColumns({"day": F.lit(before), "amount": F.lit(0).cast("long")}))
        self._write(more.groupBy("key").agg(*held).select("key", F.lit(before).alias("day"), *self._totals, F.lit(1).alias("version")), "states", "begin")
        self.last = before

    def advance(self, day: str | date, upto: str | date | None = None, arrivals: DataFrame | None = None) -> None:
        """Stores the states of ``day``, or of the days from it up to ``upto``; the day before must be stored.

        ``arrivals`` (key, day, amount) are stored first; a daily job brings the day's amounts this way.
        """
        first, last = _day(day), _day(upto or day)
        if self.last is None or first != self.last + timedelta(1):
            raise ValueError(f"{first} does not follow the last stored day {self.last}")
        if arrivals is not None:
            self._write(arrivals.select("key", F.col("day").cast("date").alias("day"), F.col("amount").cast("long").alias("amount")).dropna(), "amounts", str(first))
        yesterday = self.states().where(F.col("day") == F.lit(self.last))
        rows = advance_days(yesterday, self.amounts(), first, last, self.windows)
        self._write(rows.withColumn("version", F.lit(1)), "states", str(first))
        self.last = last

    def backfill(self, upto: str | date, block: int = BLOCK_DAYS) -> None:
        """Advances from the last stored day to ``upto``, ``block`` days at a time."""
        while self.last < _day(upto):
            self.advance(self.last + timedelta(1), min(self.last + timedelta(block), _day(upto)))

    def correct(self, corrections: DataFrame, batch: str = "late") -> None:
        """Takes late amounts (key, day, amount) of stored days into the amounts and into the states they reach.

        Only the dates a correction reaches are recomputed, and only for its key; their rows are stored with the next
        version, all others stay as they are. A key without a row on such a date gets one of version 1. Every set of
        corrections has a ``batch`` name of its own.
        """
        late = corrections.select("key", F.col("day").cast("date").alias("day"), F.col("amount").cast("long").alias("amount")).dropna()
        touched = reach(late, self.last, self.windows)
        zero = F.lit(0).cast("long")
        fixed = touched.join(self.states(), ["key", "day"], "left").select(
            "key", "day", *[(F.coalesce(f"c{w}", zero) + F.col(f"d{w}")).alias(f"c{w}") for w in self.windows], (F.coalesce("version", F.lit(0)) + 1).alias("version")
        )
        self._write(fixed, "states", batch)
        self._write(late, "amounts", batch)
