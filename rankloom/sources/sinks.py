"""Writers: feature tables, manifests, metrics, prediction files."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, store: str, name: str, *, partition_by: tuple[str, ...] = ()) -> str:
    """Overwrites one table of a feature store and returns its path."""
    path = f"{store}/{name}.parquet"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)
    return path


def write_json(path: str | Path, content: dict) -> None:
    """A manifest or a set of metrics; times and other objects are written as text."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True, default=str))


def manifest(rows: DataFrame, boundaries, cutoff, seed: int, ts: str = "ts") -> dict:
    """What a feature build was made from: seed, split boundaries, cutoff, and the numbers of impressions and of each split.

    ``boundaries`` has data_min, val_start, test_start and data_max. Rows without a time are in no split.
    """
    at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    t = F.col(ts)
    val, test = at(boundaries.val_start), at(boundaries.test_start)
    n = rows.agg(F.count("*").alias("impressions"), F.count(F.when(t < val, 1)).alias("train"), F.count(F.when((t >= val) & (t < test), 1)).alias("val"), F.count(F.when(t >= test, 1)).alias("test")).first()
    limits = {k: str(getattr(boundaries, k)) for k in ("data_min", "val_start", "test_start", "data_max")}
    return {"seed": seed, "boundaries": limits, "cutoff": str(cutoff), "counts": n.asDict()}


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Prediction lines as text in the order of the source rows: parts of the folder, read by name, are in order."""
    lines.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def zip_lines(folder: str | Path, target: str | Path, name: str = "prediction.txt") -> Path:
    """Zips the parts of a text folder as one file at the archive's root, piece by piece."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(name, "w", force_zip64=True) as out:
        for part in sorted(Path(folder).glob("part-*")):
            with part.open("rb") as piece:
                while block := piece.read(1 << 20):
                    out.write(block)
    return Path(target)
