"""Rows that need many items of a table at once, without shipping an item for every pair.

Items are held in memory a block at a time: all of them, broadcast, where their number is within a bound; else cut
into blocks by a hash of their id. Rows carry lists of the ids they need, one row per block they touch, so a row is
shipped once per block it has ids in and an item once per split of its block, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_for(n_items: int, most: int) -> int:
    """Blocks of about ``most`` items at most."""
    return max(1, -(-n_items // most))


def block_of(item: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")


def meet(
    rows: DataFrame, items: DataFrame, blocks: int, hold: Callable[[pa.Table], object], kernel: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, spread: Sequence[str],
) -> DataFrame:
    """``kernel(held, batch)`` over all ``rows``, held being what ``hold`` makes of the items of the rows' block.

    ``rows`` has a column block (int), ``items`` a column id and, where ids alone do not tell it, block. With one
    block the items are collected and broadcast, so ``blocks`` must be 1 only where their size is bounded. With more, a
    block's rows are split by a hash of the columns ``spread`` so that there is work for all tasks; every split gets
    the block's items once and streams its rows. Rows of a block without items are given what ``hold`` makes of none.
    """
    spark = rows.sparkSession
    names = [c for c in items.columns if c != "block"]
    if blocks == 1:
        held = spark.sparkContext.broadcast(hold(items.select(*names).toArrow()))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from kernel(held.value, b)

        return rows.mapInArrow(local, schema)

    splits = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    block = F.col("block") if "block" in items.columns else block_of(F.col("id"), blocks)
    whole = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    copies = items.select(block.alias("block"), whole(names).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    given = copies.select((F.col("block") * splits + F.col("split")).alias("cell"), F.lit(0).alias("part"), "item")
    asked = rows.select((F.col("block") * splits + F.pmod(F.xxhash64(*spread), F.lit(splits))).cast("int").alias("cell"), F.lit(1).alias("part"), whole(rows.columns).alias("row"))
    both = given.unionByName(asked, allowMissingColumns=True).repartitionById(blocks * splits, F.col("cell")).sortWithinPartitions("cell", "part")
    item_schema = items.select(*names).limit(0).toArrow().schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, held = None, [], None
        for b in batches:
            mark = b.column("cell").to_numpy(zero_copy_only=False) * 2 + b.column("part").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                piece, cell, part = b.slice(s, e - s), int(mark[s]) // 2, int(mark[s]) % 2
                if cell != now:
                    now, pieces, held = cell, [], None
                if part == 0:
                    pieces.append(_fields(piece.column("item")))
                else:
                    if held is None:
                        held, pieces = hold(pa.Table.from_batches(pieces) if pieces else item_schema.empty_table()), []
                    yield from kernel(held, _fields(piece.column("row")))

    return both.mapInArrow(stream, schema)


def _fields(structs: pa.StructArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(structs.flatten(), [f.name for f in structs.type])


def lengths(lists: pa.ListArray) -> np.ndarray:
    """Lengths of the lists of a column, 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a column of lists of ``dim`` numbers; null lists must be filtered out before."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit_rows(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """As matrix, in double; vectors of floats are packed ones and are scaled to length 1."""
    x = matrix(lists, dim)
    if x.dtype != np.float32:
        return x
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Vectors:
    """Items (id, v) in memory, sorted by id."""

    def __init__(self, table: pa.Table, dim: int):
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], (unit_rows(table["v"], dim)[order] if len(ids) else np.zeros((0, dim)))

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids, and which of them are there."""
        if not len(self.ids):
            return np.zeros(len(want), int), np.zeros(len(want), bool)
        place = np.searchsorted(self.ids, want).clip(max=len(self.ids) - 1)
        return place, self.ids[place] == want


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k highest of each row, ties by smaller id; ids must be sorted."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        out_id, out_s = np.empty((len(score), k), ids.dtype), np.empty((len(score), k))
        for i in range(len(score)):
            found = np.flatnonzero(score[i] >= edge[i])
            found = found[np.argsort(-score[i][found], kind="stable")[:k]]
            out_id[i], out_s[i] = ids[found], score[i][found]
        return out_id, out_s
    order = np.argsort(-score, axis=1, kind="stable")
    return ids[order], np.take_along_axis(score, order, 1)
