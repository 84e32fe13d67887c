"""Vectors of readers, searches over article vectors, and latent semantic vectors of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.cells import Vectors, best_of, block_of, blocks_for, lengths, matrix, meet, unit_rows
from rankloom.operators.lineage import cut_lineage, new_folder

#: Newest-first decay of clicks in the recency pooling.
TAU = 5.0
#: Most vectors that one task holds or that are broadcast (300 doubles each are 60 MB).
HELD = 25_000
#: Vectors of one piece of an inverted list.
LIST_BLOCK = 10_000
#: Most ids of rows that one task compares with the stored vectors at a time.
HELD_IDS = 2_000_000
#: Most repeated ids that are broadcast; beyond, all vectors are shuffled to find them.
REPEATED = 1_000_000


def unit_vectors(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(id, v ARRAY<DOUBLE>): usable vectors scaled to length 1; of repeated ids one row, unusable ones left out.

    Usable are vectors of exactly ``dim`` finite components that are not all zero. Of a repeated id's vectors the
    smallest is taken.
    """
    return _once(vectors, key, column, dim, packed=False)


def packed_vectors(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """As unit_vectors, but vectors of floats stay as they are, at half the size; they are scaled where they are used.

    Every function here takes them in place of unit vectors and gives the same results.
    """
    return _once(vectors, key, column, dim, packed=True)


def _once(vectors: DataFrame, key: str, column: str, dim: int, packed: bool) -> DataFrame:
    """Vectors are not shuffled where ids are not repeated: repeated ids are found on the ids alone."""
    kind = vectors.schema[key].dataType.simpleString()
    packed = packed and vectors.schema[column].dataType.simpleString() == "array<float>"
    raw = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"

    def usable(scaled: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                good = np.flatnonzero((lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim) & b.column(0).is_valid().to_numpy(zero_copy_only=False))
                if not len(good):
                    continue
                flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float32 if raw == "array<float>" else np.float64, copy=False)
                x = flat[lists.offsets.to_numpy(zero_copy_only=False)[good][:, None] + np.arange(dim)]
                fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                if fit.any():
                    yield _lists(b.column(0).take(pa.array(good[fit])), _unit(x[fit]) if scaled else x[fit])

        return keep

    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast(raw).alias("v")).where("id IS NOT NULL")
    mapped = lambda df, scaled: df.mapInArrow(usable(scaled), f"id {kind}, v {'array<double>' if scaled else raw}")
    least = lambda df: mapped(df, False).groupBy("id").agg(F.min("v").alias("v"))
    again = rows.groupBy("id").count().where("count > 1").select("id")
    n = again.count()
    if n > REPEATED:
        return least(rows) if packed else mapped(least(rows), True)
    once = mapped(rows.join(F.broadcast(again), "id", "left_anti") if n else rows, not packed)
    if not n:
        return once
    some = least(rows.join(F.broadcast(again), "id", "left_semi"))
    return once.unionByName(some if packed else mapped(some, True))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(ids: pa.Array, x: np.ndarray, *more: tuple[str, pa.Array], name: str = "id") -> pa.RecordBatch:
    """A batch of ids with the rows of a matrix as lists."""
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), *[a for _, a in more]], [name, "v", *[n for n, _ in more]])


def pooled(histories: DataFrame, units: DataFrame, key: str, dim: int, tau: float | None = None, n_units: int | None = None) -> DataFrame:
    """(key, v, n): unit vector of a history (key, article_ids, oldest first), the mean of its articles' unit vectors.

    Articles without a vector are left out first; with ``tau`` one of the others weighs exp(-age / tau), the newest of
    them having age 0. A history without any known article has no row; an article that occurs twice counts twice. A
    mean of length 0 stays zero. One row per key is expected; null keys are left out.

    Where the vectors fit into one block they are broadcast; beyond, they are stored once and every task reads them
    past its histories (_past). Either way a history is pooled where it lies, and no reader's vector is shipped.
    """
    kind, item = histories.schema[key].dataType.simpleString(), units.schema["id"].dataType.simpleString()
    rows = histories.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.filter(F.col("article_ids").cast(f"array<{item}>"), lambda x: x.isNotNull()).alias("ids"))
    decay = 0.0 if tau is None else 1.0 / tau
    schema = f"k {kind}, v array<double>, n bigint"

    def add(held: Vectors, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = lengths(b.column("ids"))
        row = np.repeat(np.arange(b.num_rows), size)
        place, hit = held.find(b.column("ids").flatten().to_numpy(zero_copy_only=False))
        place, row = place[hit], row[hit]
        if not len(row):
            return
        w = np.exp(-_ages(row) * decay)
        names, start, count = np.unique(row, return_index=True, return_counts=True)
        sums = np.empty((len(names), dim))
        for s in range(len(names)):
            at = slice(start[s], start[s] + count[s])
            sums[s] = w[at] @ held.x[place[at]]
        yield _lists(b.column("k").take(pa.array(names)), _direction(sums), ("n", pa.array(count)), name="k")

    if blocks_for(units.count() if n_units is None else n_units, HELD) == 1:
        return meet(rows.withColumn("block", F.lit(0)), units, 1, lambda table: Vectors(table, dim), add, schema, ["k"]).withColumnRenamed("k", key)
    path = _stored(units)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held_rows(batches, ["ids"]):
            sums, n = _sums(path, b.column("ids"), dim, decay)
            known = np.flatnonzero(n)
            yield _lists(b.column("k").take(pa.array(known)), _direction(sums[known]), ("n", pa.array(n[known])), name="k")

    return rows.mapInArrow(stream, schema).withColumnRenamed("k", key)


def _ages(row: np.ndarray) -> np.ndarray:
    """Of every place of the sorted rows, how many places of its row come after it."""
    return np.searchsorted(row, row, "right") - 1 - np.arange(len(row))


def _direction(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def _stored(units: DataFrame) -> str:
    """Folder of the vectors as a table that every task can read, in the shared folder; it stays until removed."""
    path = new_folder(units.sparkSession, "vectors")
    units.select("id", "v").write.parquet(path)
    return path


def _read(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    files, at = pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    yield from pa.dataset.dataset(at, filesystem=files, format="parquet").to_batches(columns=columns, batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False)


def _held_rows(batches: Iterator[pa.RecordBatch], lists: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most HELD rows and, but for single rows beyond, HELD_IDS ids in their lists.

    For every such batch the stored vectors are read again, so it should be as large as memory allows.
    """
    kept, rows, ids = [], 0, 0
    for b in batches:
        ends = np.cumsum(sum(lengths(b.column(c)) for c in lists))
        s = 0
        while s < b.num_rows:
            before = ends[s - 1] if s else 0
            e = min(s + HELD - rows, int(np.searchsorted(ends, before + HELD_IDS - ids, "right")))
            if e <= s and not rows:
                e = s + 1
            if e > s:
                kept.append(b.slice(s, e - s))
                rows, ids, s = rows + e - s, ids + int(ends[e - 1] - before), e
            if s < b.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, rows, ids = [], 0, 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


class _Asked:
    """Ids that rows ask for, in the order in which stored vectors come."""

    def __init__(self, ids: np.ndarray):
        self.names, inverse = np.unique(ids, return_inverse=True)
        self.inverse = inverse
        self.order = np.argsort(inverse, kind="stable")
        self.first = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(self.names)))]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the names of those ids that are asked for, and which these are."""
        if not len(self.names):
            return np.empty(0, int), np.empty(0, int)
        place = np.searchsorted(self.names, ids).clip(max=len(self.names) - 1)
        hit = np.flatnonzero(self.names[place] == ids)
        return place[hit], hit

    def past(self, path: str, dim: int, step: int = 4_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the ids, unit vectors there), over all stored vectors, at most ``step`` places at a time."""
        for b in _read(path, ["id", "v"]):
            place, hit = self.find(b.column("id").to_numpy(zero_copy_only=False))
            if not len(hit):
                continue
            x = unit_rows(b.column("v").take(pa.array(hit)), dim)
            count = self.first[place + 1] - self.first[place]
            own = np.repeat(np.arange(len(hit)), count)
            at = self.order[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[place], count)]
            for s in range(0, len(own), step):
                yield at[s : s + step], x[own[s : s + step]]

    def known(self, path: str) -> np.ndarray:
        """Which of the ids have a stored vector."""
        there = np.zeros(len(self.names), bool)
        for b in _read(path, ["id"]):
            there[self.find(b.column("id").to_numpy(zero_copy_only=False))[0]] = True
        return there[self.inverse]


def _sums(path: str, lists: pa.Array, dim: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of the stored vectors of every list, and how many of its ids have one."""
    row, ids = np.repeat(np.arange(len(lists)), lengths(lists)), lists.flatten().to_numpy(zero_copy_only=False)
    asked = _Asked(ids)
    known = asked.known(path)
    n = np.bincount(row[known], minlength=len(lists))
    w = np.ones(len(ids))
    w[known] = np.exp(-_ages(row[known]) * decay)
    sums = np.zeros((len(lists), dim))
    for at, x in asked.past(path, dim):
        to = row[at]
        order = np.argsort(to, kind="stable")
        names, start = np.unique(to[order], return_index=True)
        sums[names] += np.add.reduceat((x * w[at][:, None])[order], start, axis=0)
    return sums, n


def history_cosine(slates: DataFrame, histories: DataFrame, units: DataFrame, key: str, dim: int, items: str = "candidates", item: str = "article_id") -> DataFrame:
    """(key, item, cosine) of the distinct pairs of a reader and an item of their slates (key, items: lists).

    As slate_cosine with the readers' vectors that pooled makes of ``histories`` (key, article_ids), but these vectors
    exist only where the reader's slates are scored: lists of ids are shipped, by reader, and the stored vectors are
    read past them twice. 0.0 where reader or item has no vector; null keys and items are left out.
    """
    kind, what, own = slates.schema[key].dataType.simpleString(), slates.schema[items].dataType.elementType.simpleString(), units.schema["id"].dataType.simpleString()
    lists = slates.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(items).alias("l")).repartition("k")
    wanted = lists.select("k", F.explode("l").alias("id")).where("id IS NOT NULL").dropDuplicates(["k", "id"]).groupBy("k").agg(F.collect_list("id").alias("ids"))
    reads = histories.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("k"), F.filter(F.col("article_ids").cast(f"array<{own}>"), lambda x: x.isNotNull()).alias("read"))
    rows = wanted.join(reads, "k", "left").select("k", F.coalesce("read", F.array().cast(f"array<{own}>")).alias("read"), "ids")
    path = _stored(units)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held_rows(batches, ["read", "ids"]):
            y = _direction(_sums(path, b.column("read"), dim, 0.0)[0])
            ids = b.column("ids").flatten()
            row = np.repeat(np.arange(b.num_rows), lengths(b.column("ids")))
            out = np.zeros(len(ids))
            for at, x in _Asked(ids.to_numpy(zero_copy_only=False)).past(path, dim):
                out[at] = np.einsum("ij,ij->i", x, y[row[at]])
            for s in range(0, len(ids), 100_000):
                e = min(s + 100_000, len(ids))
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row[s:e])), ids.slice(s, e - s), pa.array(out[s:e])], ["k", "id", "cosine"])

    return rows.mapInArrow(score, f"k {kind}, id {what}, cosine double").withColumnRenamed("k", key).withColumnRenamed("id", item)


def flat_search(queries: DataFrame, units: DataFrame, dim: int, k: int, key: str = "query", n_units: int | None = None) -> DataFrame:
    """(key, id, score, place): exact k nearest of every query vector (key, v) by inner product, ties by smaller id.

    Up to HELD queries are broadcast and multiplied with the collection's vectors where these lie. Beyond, every query
    meets every block of the collection. Either way k rows per query and block are merged. Queries are stated rows, not
    a share of the collection to pair up: all against all is the approximate search's work. A null query vector finds
    nothing. Scores are compared after rounding to 12 decimals.
    """
    few = _few(queries, key)
    if few is not None:
        near, sent = _nearest(dim, k), queries.sparkSession.sparkContext.broadcast(few)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _blocks_in(batches):
                yield from near(Vectors(table, dim), sent.value)

        return _merged(units.select("id", "v").mapInArrow(local, f"q {queries.schema[key].dataType.simpleString()}, id {units.schema['id'].dataType.simpleString()}, score double"), k, key)
    blocks = blocks_for(units.count() if n_units is None else n_units, HELD)
    kind, item = queries.schema[key].dataType.simpleString(), units.schema["id"].dataType.simpleString()
    rows = queries.where("v IS NOT NULL").select(F.col(key).alias("q"), "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    got = meet(rows, units, blocks, lambda table: Vectors(table, dim), _nearest(dim, k), f"q {kind}, id {item}, score double", ["q"])
    return _merged(got, k, key)


def _few(queries: DataFrame, key: str) -> pa.RecordBatch | None:
    """The queries (q, v) if they are at most HELD, else None."""
    got = queries.where("v IS NOT NULL").select(F.col(key).alias("q"), "v").limit(HELD + 1).toArrow()
    if got.num_rows > HELD:
        return None
    return pa.RecordBatch.from_arrays([got[c].combine_chunks() for c in ("q", "v")], ["q", "v"])


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of at most HELD."""
    kept, n = [], 0
    for b in batches:
        for s in range(0, b.num_rows, HELD):
            part = b.slice(s, HELD)
            if n + part.num_rows > HELD:
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
            kept.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(kept)


def _nearest(dim: int, k: int):
    def near(held: Vectors, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(held.ids):
            return
        for s in range(0, b.num_rows, 500):
            part = b.slice(s, 500)
            ids, score = best_of(np.round(unit_rows(part.column("v"), dim) @ held.x.T, 12), held.ids, k)
            yield pa.RecordBatch.from_arrays([part.column("q").take(pa.array(np.repeat(np.arange(part.num_rows), ids.shape[1]))), pa.array(ids.ravel()), pa.array(score.ravel())], ["q", "id", "score"])

    return near


def _merged(got: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumnRenamed("q", key)


def slate_cosine(pairs: DataFrame, readers: DataFrame, units: DataFrame, key: str, dim: int, item: str = "article_id", n_units: int | None = None) -> DataFrame:
    """(key, item, cosine) of distinct pairs; 0.0 where the reader or the article has no vector. Null keys are left out.

    A reader's articles are gathered per block of vectors (different ids, so at most a block of them and those without
    a vector), joined with the reader's vector once, and scored where the block's vectors are held.
    """
    wanted = pairs.select(F.col(key).alias("k"), F.col(item).alias("id")).dropna().distinct()
    kind, what = wanted.schema["k"].dataType.simpleString(), wanted.schema["id"].dataType.simpleString()
    blocks = blocks_for(units.count() if n_units is None else n_units, HELD)
    own = units.schema["id"].dataType.simpleString()
    lists = wanted.groupBy("k", block_of(F.col("id").cast(own), blocks).alias("block")).agg(F.collect_list("id").alias("ids"))
    rows = lists.join(readers.select(F.col(key).cast(kind).alias("k"), "v"), "k", "left")

    def score(held: Vectors, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = lengths(b.column("ids"))
        ids = b.column("ids").flatten()
        place, hit = held.find(ids.to_numpy(zero_copy_only=False))
        has = b.column("v").is_valid().to_numpy(zero_copy_only=False)
        y = unit_rows(b.column("v").drop_null(), dim)
        out, at, j = np.zeros(len(ids)), 0, 0
        for i in range(b.num_rows):
            if has[i]:
                mine = at + np.flatnonzero(hit[at : at + size[i]])
                out[mine] = held.x[place[mine]] @ y[j]
                j += 1
            at += size[i]
        yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(np.repeat(np.arange(b.num_rows), size))), ids, pa.array(out)], ["k", "id", "cosine"])

    got = meet(rows, units, blocks, lambda table: Vectors(table, dim), score, f"k {kind}, id {what}, cosine double", ["k"])
    return got.withColumnRenamed("k", key).withColumnRenamed("id", item)


def covered(units: DataFrame, corpus: DataFrame, item: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """(vectors of the corpus's items (id, v), one row: items, with_vector, coverage); vectors of other items are left out.

    ``corpus`` has the items, each counted once, nulls not at all; coverage is 0 for an empty corpus.
    """
    wanted = corpus.select(F.col(item).alias("id")).dropna().distinct()
    marked = wanted.join(units.select("id").withColumn("has", F.lit(1)), "id", "left")
    figures = marked.agg(F.count("*").alias("items"), F.count("has").alias("with_vector"))
    share = F.when(F.col("items") > 0, F.col("with_vector") / F.col("items")).otherwise(F.lit(0.0))
    return units.join(wanted, "id", "left_semi"), figures.withColumn("coverage", share)


def ivf_lists(units: DataFrame, nlist: int | None = None, seed: int = 0, sample: int = 20_000, n_units: int | None = None):
    """(lists, centres): every vector with the list of its nearest centre (id, v, list), and the unit centres.

    Centres are fitted by k-means on at most about ``sample`` vectors; every vector is put into a list. nlist defaults
    to min(256, max(1, n // 40)).
    """
    n = units.count() if n_units is None else n_units
    nlist = min(256, max(1, n // 40)) if nlist is None else nlist
    part = units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)) + 1)).toArrow()
    dim = len(part["v"][0]) if part.num_rows else 1
    centres = _k_means(unit_rows(part["v"], dim) if part.num_rows else np.zeros((1, 1)), max(1, nlist), seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nearest = (unit_rows(b.column("v"), dim) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(nearest, pa.int32())], ["id", "v", "list"])

    return units.select("id", "v").mapInArrow(assign, f"id {units.schema['id'].dataType.simpleString()}, v {units.schema['v'].dataType.simpleString()}, list int"), centres


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means; a centre without vectors keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        names, start = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[names] = np.where(size > 0, sums / np.where(size == 0, 1, size), centres[names])
    return centres


def ivf_search(queries: DataFrame, lists: DataFrame, centres: np.ndarray, k: int, nprobe: int = 16, key: str = "query") -> DataFrame:
    """(key, id, score, place): k best among the ``nprobe`` lists nearest to each query; approximate.

    Up to HELD queries are broadcast, and the vectors are multiplied where they lie with the queries that probe their
    list. Beyond, lists larger than LIST_BLOCK vectors are cut into pieces by a hash of the id, and a query is sent to
    every piece of its lists, so a list that holds many of the vectors is not one task's work. k rows per query and
    piece are merged.
    """
    dim, probes = centres.shape[1], min(nprobe, len(centres))
    probed = lambda v: np.argsort(-(unit_rows(v, dim) @ centres.T), axis=1, kind="stable")[:, :probes]
    few = _few(queries, key)
    if few is not None:
        near, sent = _nearest(dim, k), queries.sparkSession.sparkContext.broadcast(few)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            lists_of = probed(asked.column("v")) if asked.num_rows else np.empty((0, probes), int)
            who = np.argsort(lists_of.ravel(), kind="stable")
            edge = np.searchsorted(lists_of.ravel()[who], np.arange(len(centres) + 1))
            for table in _blocks_in(batches):
                own = table["list"].to_numpy()
                got = []
                for i in np.unique(own):
                    mine = who[edge[i] : edge[i + 1]] // probes
                    if len(mine):
                        held = Vectors(table.filter(pa.array(own == i)), dim)
                        b = pa.RecordBatch.from_arrays([pa.array(mine), asked.column("v").take(pa.array(mine))], ["q", "v"])
                        got += [[c.to_numpy(zero_copy_only=False) for c in x.columns] for x in near(held, b)]
                if got:
                    q, ids, score = (np.concatenate(c) for c in zip(*got))
                    order = np.lexsort((ids, -score, q))
                    q = q[order]
                    best = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
                    q = np.concatenate([x[0] for x in got])[best]
                    yield pa.RecordBatch.from_arrays([asked.column("q").take(pa.array(q)), pa.array(ids[best]), pa.array(score[best])], ["q", "id", "score"])

        return _merged(lists.select("id", "v", "list").mapInArrow(local, f"q {queries.schema[key].dataType.simpleString()}, id {lists.schema['id'].dataType.simpleString()}, score double"), k, key)
    kind, item = queries.schema[key].dataType.simpleString(), lists.schema["id"].dataType.simpleString()
    sizes = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}  # at most nlist rows
    pieces = [max(1, -(-sizes.get(i, 0) // LIST_BLOCK)) for i in range(len(centres))]
    first = np.r_[0, np.cumsum(pieces)].tolist()
    table = F.array(*[F.lit(i) for i in first])
    at, many = F.element_at(table, F.col("list") + 1), F.element_at(table, F.col("list") + 2)
    items = lists.select("id", "v", (at + F.pmod(F.xxhash64("id"), many - at)).cast("int").alias("block"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                blocks = [[c for i in row for c in range(first[i], first[i + 1])] for row in probed(b.column("v"))]
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(blocks, pa.list_(pa.int32()))], ["q", "v", "blocks"])

    rows = queries.where("v IS NOT NULL").select(F.col(key).alias("q"), "v").mapInArrow(probe, f"q {kind}, v {queries.schema['v'].dataType.simpleString()}, blocks array<int>")
    got = meet(rows.select("q", "v", F.explode("blocks").alias("block")), items, max(2, first[-1]), lambda t: Vectors(t, dim), _nearest(dim, k), f"q {kind}, id {item}, score double", ["q"])
    return _merged(got, k, key)


def latent_vectors(texts: DataFrame, doc: str, text: Column, components: int = 128, min_df: int = 2, max_terms: int = 200_000, iterations: int = 4, seed: int = 0):
    """(vectors, explained): latent semantic unit vectors (id, v), and the share of variance they explain.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1; terms in fewer than ``min_df``
    texts are left out and the ``max_terms`` most frequent kept. The decomposition is a randomised one: a matrix of
    terms x (components + 10) is the only thing gathered, bounded by max_terms; texts are split into terms once and
    their sparse rows, which are checkpointed, passed over once per iteration. Texts without a kept term get a zero vector.
    """
    words = texts.where(F.col(doc).isNotNull()).select(F.col(doc).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    counted = cut_lineage(words.select("id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("w", F.array().cast("array<string>")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")))
    n = counted.where("term IS NULL").count()
    tf = counted.where("term IS NOT NULL")
    top = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.col("cf").desc(), "term").limit(max_terms).toArrow()
    terms = top["term"].to_pylist()
    m = len(terms)
    k = max(1, min(components, m - 1, n - 1)) if m > 1 and n > 1 else 1
    spark = texts.sparkSession
    idf = np.log((1 + n) / (1 + top["df"].to_numpy())) + 1 if m else np.empty(0)
    place = spark.createDataFrame(pd.DataFrame({"term": terms, "i": np.arange(m, dtype=np.int32), "idf": idf}), "term string, i int, idf double")
    # every text as one sparse row of unit length, written once and read by each pass
    weighted = counted.join(F.broadcast(place), "term", "left").select("id", "i", ((1 + F.ln("tf")) * F.col("idf")).alias("x"))
    sparse = weighted.groupBy("id").agg(F.filter(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "x"))), lambda e: e.isNotNull()).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    rows = cut_lineage(sparse.select("id", F.col("e.i").alias("i"), F.transform("e", lambda e: e["x"] / size).alias("x")))

    def of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        edge = np.r_[0, np.cumsum(lengths(b.column("i")))]
        index, x = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "x"))
        for r in np.flatnonzero(np.diff(edge)):
            yield r, index[edge[r] : edge[r + 1]], x[edge[r] : edge[r + 1]]

    def passed(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Sums over all texts of x (x basis), of x, of (x basis)(x basis), and of |x|^2, added up in a tree."""
        held = spark.sparkContext.broadcast(basis)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = held.value
            y = np.zeros_like(q)
            mean = np.zeros(len(q))
            gram = np.zeros((q.shape[1], q.shape[1]))
            square = 0.0
            for b in batches:
                inner = []
                for _, index, x in of(b):
                    p = x @ q[index]
                    y[index] += x[:, None] * p
                    mean[index] += x
                    square += float(x @ x)
                    inner.append(p)
                if inner:
                    inner = np.stack(inner)
                    gram += inner.T @ inner
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (y, mean, gram, np.array([square]))], ["y", "m", "g", "s"])

        parts = rows.select("i", "x").mapInArrow(add, "y binary, m binary, g binary, s binary").rdd
        sums = parts.map(lambda r: [np.frombuffer(v) for v in r]).treeReduce(lambda a, b: [x + z for x, z in zip(a, b)])
        return sums[0].reshape(basis.shape), sums[1], sums[2].reshape(basis.shape[1], -1), float(sums[3][0])

    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(max(m, 1), min(max(m, 1), k + 10))))[0]
    for _ in range(iterations if m else 0):
        basis = np.linalg.qr(passed(basis)[0])[0]
    if m:
        _, mean, gram, square = passed(basis)
        values, turn = np.linalg.eigh(gram)
        order = np.argsort(-values)[:k]
        basis = basis @ turn[:, order]
        centre = mean / n
        total = square / n - float(centre @ centre)
        explained = float((values[order] / n - (centre @ basis) ** 2).sum() / total) if total > 0 else 0.0
    else:
        basis, explained = np.zeros((1, 1)), 0.0
    final = spark.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = final.value
        for b in batches:
            x = np.zeros((b.num_rows, q.shape[1]))
            for r, index, w in of(b):
                x[r] = w @ q[index]
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(size == 0, 1.0, size)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], ["id", "v"])

    return rows.mapInArrow(project, f"id {texts.schema[doc].dataType.simpleString()}, v array<double>"), explained
