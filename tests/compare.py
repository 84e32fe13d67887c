"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings behaviors articles article_versions document_vector candidate_scores history mix_targets".split()


def tidy(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(tidy(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(tidy(r[i]) for i in order) for r in rows)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(spark, folder: str, query, sql: str) -> str:
    """Empty if the query and the SQL agree."""
    df = query(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected, want = oracle(folder, sql)
    if names != expected:
        return f"columns {names} != {expected}"
    if got != want:
        return f"{sum(got.values())} rows, wanted {sum(want.values())}; only here {list((got - want).items())[:4]}, only there {list((want - got).items())[:4]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "/tmp/rankloom-check").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    for name, f in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in e.oracle_sql():
                said = differences(spark, folder, f, e.oracle_sql()[name])
                n = ""
            else:
                said, n = "", f"{f(spark, folder).count()} rows, no SQL"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        print(name, "ok" if not said else "DIFFERS " + said, n if not said else "", f"{time.time() - t:.1f}s", flush=True)
