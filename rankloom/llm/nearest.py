"""The k most similar vectors of every vector, by shifted space-filling curves.

Every vector is projected several times onto a few random directions; a Hilbert curve through the cells of each
projection, with cell borders shifted at random, gives it a key per curve. Records of a key, an id and a sketch of
sign bits are range-partitioned by (curve, key). Within a range they are sorted, each is compared with the window of
records behind it by the Hamming distance of the sketches, and the best pairs are kept. The pairs of all curves are
merged and reranked by the exact cosine of the vectors.

Cost per vector is curves * window sketch comparisons, whatever the number of vectors. Cell borders are fitted on a
sample of about ``SAMPLE`` vectors, range borders on ``RANGE_SAMPLE`` keys a range; every vector is indexed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.heavy import heaviest, join_on_skewed_key
from rankloom.operators.lineage import cut_lineage
from rankloom.operators.vectors import flat_search, unit_vectors

#: Curves, projected directions of each, and bits of a direction: 16 * 2 bits make a key of 32 bits.
CURVES, DIRECTIONS, BITS = 24, 16, 2
#: Sketch words of 64 sign bits. The first WORDS_FIRST of them are compared first.
WORDS, WORDS_FIRST = 6, 2
#: Records behind a record that it is compared with, on every curve.
WINDOW = 1280
#: Vectors the cell borders are fitted on, records of one range, and sampled keys that place a range's border.
SAMPLE, RANGE_RECORDS, RANGE_SAMPLE = 4096, 50_000, 48
#: Most ids that are broadcast to thin out the vectors before the rerank (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 1_000_000
RECORD = np.dtype([("key", "<u4"), ("id", "<i8"), ("s", "<u8", (WORDS,))])


def _usable(ids: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (float32) of the rows with exactly ``dim`` finite components that are not all zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((sizes == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # null components turn NaN
    starts = lists.offsets.to_numpy(zero_copy_only=False)[good]
    x = values[starts[:, None] + np.arange(dim)] if len(good) else np.empty((0, dim), np.float32)
    keep = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.to_numpy(zero_copy_only=False)[good][keep].astype(np.int64), x[keep]


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every cell (n x d coordinates of ``bits`` bits, d * bits <= 64) on the Hilbert curve of its grid.

    Coordinates become the curve's transposed index by undoing excess work bit by bit and Gray-encoding the rest,
    after Skilling, "Programming the Hilbert curve" (2004).
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint32(level)) & np.uint32(1) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.uint64)
    return key


class Curves:
    """Projections, borders and sketch directions, fitted on a sample of usable vectors."""

    def __init__(self, sample: np.ndarray, dim: int, n: int, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.curves = curves
        self.parts = max(1, math.ceil(n / RANGE_RECORDS))
        self.mean = _unit(sample).mean(axis=0) if len(sample) else np.zeros(dim, np.float32)
        frames = [np.linalg.qr(rng.normal(size=(max(dim, DIRECTIONS), DIRECTIONS)))[0][:dim] for _ in range(curves)]
        self.directions = np.concatenate(frames, axis=1).astype(np.float32)
        self.signs = rng.normal(size=(dim, WORDS * 64)).astype(np.float32)
        steps = 1 << BITS
        shift = rng.uniform(-0.5, 0.5, size=curves * DIRECTIONS)
        levels = np.clip((np.arange(1, steps)[:, None] + shift) / steps, 0.02, 0.98)
        self.borders = np.zeros(levels.shape, np.float32)
        self.ranges = np.zeros((curves, self.parts - 1), np.uint64)
        if len(sample):
            y = np.sort((_unit(sample) - self.mean) @ self.directions, axis=0)
            rows = (levels * (len(y) - 1)).astype(int)
            self.borders = y[rows, np.arange(y.shape[1])]
            self.place_ranges(self.orders(sample))

    @staticmethod
    def order(key: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """Sort key: the Hilbert key, then sketch bits, so that crowded cells are ordered and cut too."""
        return (key.astype(np.uint64) << np.uint64(32)) | (sketch[:, 0] >> np.uint64(32))

    def orders(self, x: np.ndarray) -> np.ndarray:
        """Sort keys of vectors on every curve (n x curves)."""
        keys, sketch = self.encode(x)
        return np.stack([self.order(keys[:, c], sketch) for c in range(self.curves)], axis=1)

    def place_ranges(self, orders: np.ndarray) -> None:
        """Range borders of every curve at equal shares of the sampled sort keys."""
        if len(orders):
            whole = np.sort(orders, axis=0)
            self.ranges = np.ascontiguousarray(whole[(np.arange(1, self.parts) * len(whole)) // self.parts].T)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hilbert keys (n x curves) and sketches (n x WORDS) of usable vectors."""
        u = _unit(x)
        y = (u - self.mean) @ self.directions
        cells = np.zeros(y.shape, np.uint8)
        for b in self.borders:
            cells += y > b
        keys = np.stack([hilbert_keys(cells[:, c * DIRECTIONS : (c + 1) * DIRECTIONS], BITS) for c in range(self.curves)], axis=1).astype(np.uint32)
        sketch = np.packbits((u @ self.signs) > 0, axis=1).view(np.uint64)
        return keys, sketch


def _window_pairs(x: np.ndarray, window: int, most: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a sorted range within ``window`` and Hamming distance ``most``; of each record its ``keep`` best."""
    words = [np.ascontiguousarray(x["s"][:, w]) for w in range(WORDS)]
    share = WORDS_FIRST / WORDS
    first = int(most * share + 3 * math.sqrt(64 * WORDS_FIRST * 0.25 * (1 - share)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        i, j, h = (np.concatenate([f[k] for f in found]) for k in range(3))
        ok = np.zeros(len(i), bool)
        for one, other in ((i, j), (j, i)):
            order = np.lexsort((x["id"][other], h, one))
            start = np.flatnonzero(np.r_[True, one[order][1:] != one[order][:-1]]) if len(order) else np.empty(0, int)
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
            ok[order[place < keep]] = True
        return i[ok], j[ok], h[ok]

    for d in range(1, min(window, len(x) - 1) + 1):
        near = np.bitwise_count(words[0][:-d] ^ words[0][d:])
        for w in words[1:WORDS_FIRST]:
            near = near + np.bitwise_count(w[:-d] ^ w[d:])
        i = np.flatnonzero(near <= first)
        if not len(i):
            continue
        h = near[i].astype(np.int64)
        for w in words[WORDS_FIRST:]:
            h += np.bitwise_count(w[i] ^ w[i + d])
        ok = h <= most
        if ok.any():
            found.append((i[ok], i[ok] + d, h[ok]))
            held += int(ok.sum())
            if held > 2_000_000:
                found[:] = [best()]
                held = len(found[0][0])
    return best()


def _pack_records(r: np.ndarray) -> bytes:
    """Records as planes of bytes of equal weight, in order of their keys: ids and leading key bytes then form runs that shuffles compress."""
    r = r[np.argsort(r["key"], kind="stable")]
    return b"".join(np.ascontiguousarray(r[f]).view(np.uint8).reshape(len(r), -1).T.tobytes() for f in ("key", "id")) + r["s"].tobytes()


def _unpack_records(blob: bytes) -> np.ndarray:
    n = len(blob) // RECORD.itemsize
    out, at = np.empty(n, RECORD), 0
    for field, width in (("key", 4), ("id", 8)):
        plane = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        out[field] = np.ascontiguousarray(plane).view(RECORD[field]).ravel()
        at += n * width
    out["s"] = np.frombuffer(blob, np.uint64, n * WORDS, at).reshape(n, WORDS)
    return out


def _pack_vectors(x: np.ndarray) -> list[bytes]:
    """Single-precision components, byte by byte of equal weight: rounded vectors then hold runs that shuffles compress."""
    planes = np.ascontiguousarray(x.astype("<f4")).view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)
    return [p.tobytes() for p in planes]


def _unpack_vectors(packed: pa.Array, dim: int) -> np.ndarray:
    planes = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, 4, dim).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view("<f4").reshape(-1, dim).astype(np.float64)


def _copies(rows: DataFrame, dim: int) -> tuple[DataFrame, int, int]:
    """(id, digest) of the usable vectors, how many there are, and how many share their components with another."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _usable(b.column(0), b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())], ["id", "digest"])

    marks = rows.mapInArrow(digests, "id bigint, digest binary").groupBy("id").agg(F.min("digest").alias("digest"))
    groups = marks.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sums = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra")).first()
    return marks, int(sums["n"] or 0), int(sums["extra"] or 0)


def nearest(
    df: DataFrame, vec_id: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.5, curves: int = CURVES, window: int = WINDOW, keep: int | None = None
) -> DataFrame:
    """(id, neighbour, cosine, place): of every usable vector its ``k`` nearest with cosine >= min_cosine, ties by smaller id.

    Usable are vectors of exactly ``dim`` finite components that are not all zero, with an id; all others are left
    out. Repeated rows are one; of several vectors of one id one is taken, the same in every run. Copies of one
    vector are searched once, as the smallest of their ids, and every copy gets its own k rows. The result is
    approximate: a near pair is missed if no curve brings it into one window, or if its sketches lie more than two
    standard deviations further apart than their cosine says. ``keep`` (8 * k) pairs of a record are kept per curve.
    ``nearest_exact`` misses none.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    keep = 8 * k if keep is None else keep
    marks, n, extra = _copies(rows, dim)
    groups = hot = None
    if extra:
        first = marks.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        groups = cut_lineage(join_on_skewed_key(marks, first.select("digest", "rep"), "digest", heaviest(first, "digest", "n"), "inner").select("id", "rep"))
        hot = heaviest(first, "rep", "n")
        rows = rows.join(groups.where("id <> rep").select("id"), "id", "left_anti")
    # samples are shares of the ids by hash; they only place borders
    sampled = lambda most: rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.25 * most / max(n, 1)) * (1 << 30)) + 1)) & (F.size("v") == dim))
    part = sampled(SAMPLE).limit(2 * SAMPLE).toArrow()
    curve = Curves(_usable(part["id"].combine_chunks(), part["v"], dim)[1], dim, n, curves)
    if RANGE_SAMPLE * curve.parts > SAMPLE:
        # Many ranges need more keys than the sample of vectors has. Only sort keys are gathered: 8 bytes per curve for
        # RANGE_SAMPLE vectors a range, that is 200 bytes for every thousand vectors.
        kept = spark.sparkContext.broadcast(curve)

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x = _usable(b.column(0), b.column(1), dim)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([kept.value.orders(x).tobytes()], pa.binary())], ["o"])

        found = sampled(RANGE_SAMPLE * curve.parts).mapInArrow(keys_of, "o binary").toArrow()["o"].to_pylist()
        curve.place_ranges(np.concatenate([np.frombuffer(o, np.uint64).reshape(-1, curves) for o in found] or [np.empty((0, curves), np.uint64)]))
    fitted = spark.sparkContext.broadcast(curve)
    angle = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    bits = 64 * WORDS
    most = int(bits * angle + 2 * math.sqrt(bits * angle * (1 - angle)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = fitted.value
        for b in batches:
            ids, x = _usable(b.column(0), b.column(1), dim)
            if not len(ids):
                continue
            keys, sketch = fit.encode(x)
            where, blobs = [], []
            for c in range(fit.curves):
                record = np.empty(len(ids), RECORD)
                record["key"], record["id"], record["s"] = keys[:, c], ids, sketch
                piece = np.searchsorted(fit.ranges[c], fit.order(keys[:, c], sketch), side="right")
                order = np.argsort(piece, kind="stable")
                for chunk in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                    where.append(c * fit.parts + int(piece[chunk[0]]))
                    blobs.append(_pack_records(record[chunk]))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["part", "records"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [_unpack_records(r.as_py()) for b in batches for r in b.column(1)]
        if not raw:
            return
        x = np.concatenate(raw)
        x = x[np.lexsort((x["id"], Curves.order(x["key"], x["s"])))]
        x = x[np.r_[True, x["id"][1:] != x["id"][:-1]]]
        i, j, h = _window_pairs(x, window, most, keep)
        a, b = np.minimum(x["id"][i], x["id"][j]), np.maximum(x["id"][i], x["id"][j])
        for s in range(0, len(a), 100_000):
            e = s + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(a[s:e]), pa.array(b[s:e])], ["a", "b"])

    pieces = rows.mapInArrow(encode, "part int, records binary").repartitionById(fitted.value.curves * fitted.value.parts, F.col("part"))
    pairs = cut_lineage(pieces.mapInArrow(search, "a bigint, b bigint").where("a <> b").distinct())

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(needed), "id", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _usable(b.column(0), b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_pack_vectors(x), pa.binary())], ["id", "v"])

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _unpack_vectors(b.column(2), dim), _unpack_vectors(b.column(3), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            y /= np.abs(y).max(axis=1, keepdims=True)
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c, pa.float64())], ["a", "b", "cosine"])

    vectors = rows.mapInArrow(pack, "id bigint, v binary").groupBy("id").agg(F.min("v").alias("v"))
    halves = pairs.join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    whole = halves.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").select("a", "b", "va", "vb")
    links = whole.mapInArrow(cosines, "a bigint, b bigint, cosine double").where(F.col("cosine") >= min_cosine)
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine"), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour"), "cosine"))).alias("l")).select("l.*")
    rank = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    top = both.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    if groups is not None:
        top = _expand(top, groups, hot, k)
    return top


def _expand(top: DataFrame, groups: DataFrame, hot: list, k: int) -> DataFrame:
    """Rows of every copy from those of its representative; a copy's own siblings are neighbours of cosine 1.

    Of a group only its k + 1 smallest ids can be anyone's neighbours among the first k; every task prunes a group to
    those before it shuffles. A representative's list, at most 2k + 1 long, is one row, which its copies are joined
    with: those of the ``hot`` representatives by broadcast, so a vector with very many copies is not one task's work.
    """
    few = groups.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    few = few.select(F.col("rep").alias("neighbour"), F.col("id").alias("copy"))
    own = groups.where("id = rep").select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    wide = top.select("id", "neighbour", "cosine").unionByName(own).join(few, "neighbour", "left")
    wide = wide.select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
    rank = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    wide = wide.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= 2 * k + 1)
    packed = wide.groupBy(F.col("id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("place", "neighbour", "cosine"))).alias("near"))
    copies = join_on_skewed_key(groups, packed, "rep", hot, "inner")
    single = packed.join(groups.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), "near")
    each = copies.select("id", "near").unionByName(single)
    lists = each.select("id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    out = lists.select("id", F.posexplode("near").alias("p", "n"))
    return out.select("id", "n.neighbour", "n.cosine", (F.col("p") + 1).alias("place"))


def nearest_exact(df: DataFrame, vec_id: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.5) -> DataFrame:
    """As ``nearest`` without loss: every vector is multiplied with every block of vectors.

    The work grows with the square of the number of vectors; it is the way for collections or parts of them where no
    near pair may be missed, and what recall is measured against.
    """
    units = cut_lineage(unit_vectors(df, vec_id, vector, dim))
    found = flat_search(units.select(F.col("id").alias("query"), "v"), units, dim, k + 1)
    near = found.where("query <> id").select(F.col("query").cast("long").alias("id"), F.col("id").cast("long").alias("neighbour"), F.col("score").alias("cosine"))
    rank = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return near.where(F.col("cosine") >= min_cosine).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
