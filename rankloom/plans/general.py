"""Queries p1, p2, p4 and p7 and their SQL."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import asof_attributes, feature_table, heavy, rolling_state
from rankloom.operators.lineage import cut_lineage, new_folder
from rankloom.sources.tables import click_rows, clicks, in_log, table

FIRST_DAY, LAST_DAY = "2025-02-01", "2025-04-11"
#: First and last moment an event can have.
LOG_SPAN = (datetime(2025, 2, 1), datetime(2025, 4, 12))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """First five readers of every clicked article. Copies of a row cannot change a first click, so none are merged."""
    rows = click_rows(table(spark, folder, "behaviors").where("user_id <> 0"), "user_id", "impression_time")
    return heavy.first_members(rows, "article_id", "user_id", "impression_time").select("article_id", "user_id")


def p1_article_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks, different readers, first and last click of every clicked article."""
    rows = clicks(table(spark, folder, "behaviors"))
    reader = F.when(F.col("user_id") != 0, F.col("user_id"))
    return heavy.key_totals(rows.select("article_id", reader.alias("user_id"), "impression_time"), "article_id", "user_id", "impression_time")


def rolling_store(spark: SparkSession, folder: str) -> rolling_state.StateStore:
    """Stored state of every clicked article on every day of the log.

    The days are run on the clicks that were logged by the end of their day; the others are corrections.
    """
    rows = clicks(table(spark, folder, "behaviors"))
    day = F.to_date("impression_time")
    late = F.coalesce(F.to_date("logged_time") > day, F.lit(True))
    daily = cut_lineage(rows.groupBy(F.col("article_id").alias("key"), day.alias("day"), late.alias("late")).agg(F.count("*").alias("amount")))
    store = rolling_state.StateStore(spark, new_folder(spark, "rolling"), "int")
    store.begin(daily.where("NOT late"), date.fromisoformat(FIRST_DAY) - timedelta(1), daily.select("key").distinct())
    store.backfill(LAST_DAY)
    store.correct(daily.where("late"))
    return store


def rolling_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The states that hold, of the days of the log."""
    return rolling_store(spark, folder).states().where(F.col("day") >= F.lit(FIRST_DAY).cast("date"))


def p2_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored version of every article's totals on every day."""
    rows = rolling_store(spark, folder).versions().where(F.col("day") >= F.lit(FIRST_DAY).cast("date"))
    return rows.select(F.col("key").alias("article_id"), F.date_format("day", "yyyy-MM-dd").alias("click_day"), "version", "c7", "c30")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which an article's clicks rose or fell silent."""
    state = rolling_clicks(spark, folder).where(F.col("day") >= F.lit("2025-03-02").cast("date"))
    rise = (F.col("c7") >= 6) & (F.col("c30") > F.col("c7")) & (12 * F.col("c7") >= 7 * F.col("c30"))
    quiet = (F.col("c7") == 0) & (F.col("c30") >= 12)
    kind = F.when(rise, "rise").when(quiet, "quiet")
    return state.select(F.col("key").alias("article_id"), F.date_format("day", "yyyy-MM-dd").alias("click_day"), kind.alias("kind")).where("kind IS NOT NULL")


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and daily means of the last 7 and 30 days, of every clicked article on every day."""
    return rolling_clicks(spark, folder).select(
        F.col("key").alias("article_id"), F.date_format("day", "yyyy-MM-dd").alias("click_day"), "c7", "c30", (F.col("c7") / 7.0).alias("mean7"), (F.col("c30") / 30.0).alias("mean30"), "version"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The version of the clicked article that held, and was known, at every click."""
    log = table(spark, folder, "behaviors")
    rows = clicks(log).select("impression_id", "article_id", "impression_time")
    hot = heavy.heavy_keys(click_rows(log), "article_id")
    known = asof_attributes.as_known(rows, table(spark, folder, "article_versions"), "article_id", "impression_time", ["version_no"], keys=hot, span=LOG_SPAN)
    return known.where("has_version_no").select("impression_id", "article_id", F.col("known_version_no").alias("version_no"))


def p4_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every click with category and premium flag of its article as known then."""
    log = table(spark, folder, "behaviors")
    rows = clicks(log).select("impression_id", "user_id", "article_id", "impression_time")
    hot = heavy.heavy_keys(click_rows(log), "article_id")
    known = asof_attributes.as_known(rows, table(spark, folder, "article_versions"), "article_id", "impression_time", ["category_str", "premium"], keys=hot, span=LOG_SPAN)
    return known.select("impression_id", "user_id", "article_id", "impression_time", "known_category_str", "known_premium", F.col("has_premium").alias("known"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readers' event types with enough events and a recent last one."""
    log = in_log(table(spark, folder, "behaviors"))
    events, _ = feature_table.entity_events(log, feature_table.article_types(table(spark, folder, "articles")))
    enough = F.when(F.col("event_type").startswith("view:"), F.col("n") >= 6).otherwise(F.col("n") >= 3)
    recent = F.col("last_time") >= F.lit("2025-04-05 00:00:00").cast("timestamp_ntz")
    return events.where(enough & recent).select("user_id", "event_type")


def p7_features(spark: SparkSession, folder: str) -> DataFrame:
    """One wide feature row per reader, with columns for every event type there can be."""
    log = in_log(table(spark, folder, "behaviors"))
    lookup = feature_table.article_types(table(spark, folder, "articles"))
    events, _ = feature_table.entity_events(log, lookup)
    return feature_table.wide_rows(events, feature_table.event_types(lookup), "2025-04-12 00:00:00")


def p7_reader_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per reader with number and last time of the views and clicks of every article category."""
    log = in_log(table(spark, folder, "behaviors"))
    events, _ = feature_table.entity_events(log, feature_table.article_types(table(spark, folder, "articles")))
    return feature_table.type_rows(events)


QUERIES = {f.__name__: f for f in (p1_found, p1_article_totals, p2_found, p2_rolling, p2_state, p4_found, p4_attributes, p7_found, p7_features, p7_reader_rows)}

_LOG = """log AS (SELECT impression_id, user_id, impression_time, any_value(article_ids_inview) AS iv, any_value(article_ids_clicked) AS cl, min(logged_time) AS logged_time
  FROM behaviors WHERE impression_time >= TIMESTAMP '2025-02-01' AND impression_time < TIMESTAMP '2025-04-12' GROUP BY 1, 2, 3),
click AS (SELECT * FROM (SELECT impression_id, user_id, impression_time, logged_time, unnest(list_distinct(list_intersect(cl, iv))) AS article_id FROM log) WHERE article_id IS NOT NULL)"""

_ROLL = f"""WITH {_LOG},
daily AS (SELECT article_id, CAST(impression_time AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE logged_time IS NULL OR CAST(logged_time AS DATE) > CAST(impression_time AS DATE)) AS late FROM click GROUP BY 1, 2),
days AS (SELECT CAST(x AS DATE) AS d FROM range(TIMESTAMP '2025-02-01', TIMESTAMP '2025-04-12', INTERVAL 1 DAY) t(x)),
grid AS (SELECT article_id, d FROM (SELECT DISTINCT article_id FROM daily), days),
roll AS (SELECT g.article_id, g.d, CAST(coalesce(sum(n) FILTER (WHERE y.d > g.d - 7), 0) AS BIGINT) AS c7, CAST(coalesce(sum(n), 0) AS BIGINT) AS c30, CAST(coalesce(sum(late), 0) AS BIGINT) AS late
  FROM grid g LEFT JOIN daily y ON y.article_id = g.article_id AND y.d <= g.d AND y.d > g.d - 30 GROUP BY 1, 2)"""

_EVENTS = f"""WITH {_LOG},
kinds AS (SELECT article_id, min(lower(trim(category_str))) AS kind FROM articles WHERE trim(category_str) <> '' GROUP BY 1),
seen AS (SELECT user_id, impression_time, unnest(list_distinct(iv)) AS article_id FROM log WHERE user_id <> 0),
ev AS (SELECT user_id, 'view:' || coalesce(kind, 'none') AS event_type, impression_time FROM seen LEFT JOIN kinds USING (article_id)
  UNION ALL SELECT user_id, 'click:' || coalesce(kind, 'none'), impression_time FROM click LEFT JOIN kinds USING (article_id) WHERE user_id <> 0),
feat AS (SELECT user_id, event_type, count(*) AS n, max(impression_time) AS last_time FROM ev GROUP BY 1, 2)"""


def _known(columns: str) -> str:
    return f"""WITH {_LOG},
c AS (SELECT row_number() OVER () AS id, * FROM click),
v AS (SELECT DISTINCT * FROM article_versions WHERE recorded_time IS NOT NULL AND valid_from IS NOT NULL),
m AS (SELECT c.*, v.version_no, v.category_str, v.premium, v.article_id AS hit, row_number() OVER (PARTITION BY c.id ORDER BY v.valid_from DESC NULLS LAST, v.recorded_time DESC NULLS LAST, v.version_no DESC NULLS LAST) AS rn
  FROM c LEFT JOIN v ON v.article_id = c.article_id AND v.valid_from <= c.impression_time AND v.recorded_time <= c.impression_time)
SELECT {columns}"""


SQL = {
    "p1_found": f"""WITH {_LOG}, f AS (SELECT article_id, user_id, min(impression_time) AS t FROM click WHERE user_id <> 0 GROUP BY 1, 2)
SELECT article_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY t, user_id) AS rn FROM f) WHERE rn <= 5""",
    "p1_article_totals": f"""WITH {_LOG} SELECT article_id, count(*) AS n_rows, count(DISTINCT CASE WHEN user_id <> 0 THEN user_id END) AS n_members,
  min(impression_time) AS first_time, max(impression_time) AS last_time FROM click GROUP BY 1""",
    "p2_found": f"""{_ROLL} SELECT * FROM (SELECT article_id, strftime(d, '%Y-%m-%d') AS click_day,
  CASE WHEN c7 >= 6 AND c30 > c7 AND 12 * c7 >= 7 * c30 THEN 'rise' WHEN c7 = 0 AND c30 >= 12 THEN 'quiet' END AS kind
  FROM roll WHERE d >= DATE '2025-03-02') WHERE kind IS NOT NULL""",
    "p2_rolling": f"""{_ROLL} SELECT article_id, strftime(d, '%Y-%m-%d') AS click_day, c7, c30, c7 / 7.0::DOUBLE AS mean7, c30 / 30.0::DOUBLE AS mean30,
  CASE WHEN late > 0 THEN 2 ELSE 1 END AS version FROM roll""",
    "p2_state": f"""{_ROLL}, late_days AS (SELECT g.article_id, g.d, CAST(coalesce(sum(y.late) FILTER (WHERE y.d > g.d - 7), 0) AS BIGINT) AS l7, CAST(coalesce(sum(y.late), 0) AS BIGINT) AS l30
  FROM grid g LEFT JOIN daily y ON y.article_id = g.article_id AND y.d <= g.d AND y.d > g.d - 30 GROUP BY 1, 2)
SELECT article_id, strftime(d, '%Y-%m-%d') AS click_day, 1 AS version, c7 - l7 AS c7, c30 - l30 AS c30 FROM roll JOIN late_days USING (article_id, d)
UNION ALL SELECT article_id, strftime(d, '%Y-%m-%d'), 2, c7, c30 FROM roll WHERE late > 0""",
    "p4_found": _known("impression_id, article_id, version_no FROM m WHERE rn = 1 AND hit IS NOT NULL"),
    "p4_attributes": _known("impression_id, user_id, article_id, impression_time, category_str AS known_category_str, premium AS known_premium, hit IS NOT NULL AS known FROM m WHERE rn = 1"),
    "p7_found": f"""{_EVENTS} SELECT user_id, event_type FROM feat
  WHERE n >= CASE WHEN event_type LIKE 'view:%' THEN 6 ELSE 3 END AND last_time >= TIMESTAMP '2025-04-05'""",
    "p7_features": f"""{_EVENTS},
types AS (SELECT e || kind AS event_type FROM (SELECT DISTINCT kind FROM kinds UNION SELECT 'none'), (SELECT unnest(['view:', 'click:']) AS e)),
who AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_all, count(*) AS n_types, max(last_time) AS last_time FROM feat GROUP BY 1),
grid AS (SELECT w.user_id, replace(t.event_type, ':', '_') AS stem, coalesce(f.n, 0) AS n, (epoch_us(TIMESTAMP '2025-04-12') - epoch_us(f.last_time)) / 86400000000.0::DOUBLE AS days
  FROM who w CROSS JOIN types t LEFT JOIN feat f ON f.user_id = w.user_id AND f.event_type = t.event_type)
SELECT * FROM (PIVOT grid ON stem USING CAST(sum(n) AS BIGINT) AS n, max(days) AS days GROUP BY user_id) JOIN who USING (user_id)""",
    "p7_reader_rows": f"""{_EVENTS} SELECT user_id, list(event_type ORDER BY event_type) AS event_types, list(n ORDER BY event_type) AS counts,
  list(last_time ORDER BY event_type) AS last_times, CAST(sum(n) AS BIGINT) AS n_all, count(*) AS n_types, max(last_time) AS last_time FROM feat GROUP BY user_id""",
}
