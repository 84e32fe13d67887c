"""Filling sequences of a fixed number of tokens with whole documents.

Only sizes are packed, never texts. Documents larger than a sequence give full sequences of their own and a rest.
All other items are dealt to shards by a hash of their id, so every shard holds a like mix of sizes and at most about
``shard_items`` items; within a shard vector best-fit places items from large to small. A bin has three residual
capacities (tokens, documents, attention cost); of the open bins that fit an item under all of them it takes the one
whose weighted residual is smallest afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents one sequence may hold.
MAX_DOCUMENTS = 512
SHARD_ITEMS = 20_000


def byte_tokens(text: Column) -> Column:
    """Tokens of the public ByT5 tokenizer without special tokens: one per UTF-8 byte."""
    return F.octet_length(text).cast("long")


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float, weights: Sequence[float] | None = None) -> np.ndarray:
    """Bin of every item, for items sorted from large to small.

    An item's cost is the square of its size. An item that breaks a bound by itself still gets a bin of its own.
    ``weights`` are those of the residual shares of tokens, documents and cost; by default they follow from how many
    bins each bound alone would need, falling steeply for a bound that does not bind.
    """
    n = len(sizes)
    if weights is None:
        wide = sizes.astype(float)
        need = np.array([wide.sum() / capacity, n / max_documents, (wide * wide).sum() / max_cost])
        weights = (need / max(need.max(), 1e-300)) ** 8
    bins = np.empty(n, dtype=np.int64)
    room = np.empty((3, 1024))
    names = np.empty(1024, dtype=np.int64)
    open_bins = made = 0
    scale = np.array([weights[0] / capacity**2, weights[1] / max_documents**2, weights[2] / max_cost**2])
    least = float(sizes[-1]) if n else 0.0
    for i in range(n):
        size = float(sizes[i])
        cost = size * size
        tokens, docs, attention = room[0, :open_bins], room[1, :open_bins], room[2, :open_bins]
        fits = np.flatnonzero((tokens >= size) & (docs >= 1) & (attention >= cost))
        if len(fits):
            left = scale[0] * (tokens[fits] - size) ** 2 + scale[1] * (docs[fits] - 1) ** 2 + scale[2] * (attention[fits] - cost) ** 2
            b = fits[int(left.argmin())]
        else:
            if open_bins == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            b = open_bins
            room[:, b] = capacity, max_documents, max_cost
            names[b] = made
            open_bins += 1
            made += 1
        room[0, b] -= size
        room[1, b] -= 1
        room[2, b] -= cost
        bins[i] = names[b]
        if room[0, b] < least or room[1, b] < 1:  # no later item fits: close it
            open_bins -= 1
            room[:, b] = room[:, open_bins]
            names[b] = names[open_bins]
    return bins


def pack(
    documents: DataFrame, doc: str, tokens: Column, capacity: int = 4096, max_documents: int = MAX_DOCUMENTS, max_cost: float | None = None,
    weights: Sequence[float] | None = None, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(sequence STRING, doc, piece, first_token, n_tokens): where every document lies, each token exactly once.

    Documents of at most ``capacity`` tokens are never cut; a larger one gives full pieces and at most one rest,
    which is packed like any item. Null ids and documents without tokens (null or empty) lie in no sequence.
    Repeated rows are repeated items. ``max_cost`` bounds the sum of squared sizes in a sequence (default: that of
    one full piece, which never binds); an item beyond it alone gets its own sequence.
    """
    max_cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    sizes = documents.select(F.col(doc).alias("doc"), tokens.cast("long").alias("n")).where("doc IS NOT NULL AND n > 0")
    shards = max(1, -(-sizes.count() // shard_items))
    full = F.expr(f"CAST(n DIV {capacity} AS INT)")
    rest = F.col("n") % capacity
    whole = (
        sizes.where(F.col("n") >= capacity)
        .select("doc", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
        .select(
            F.concat(F.lit("f"), F.col("doc").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("sequence"),
            "doc", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"),
        )
    )
    items = sizes.where(rest > 0).select("doc", full.alias("piece"), rest.alias("n"), F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(shards)).cast("int").alias("shard"))

    def place(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n", "doc"], ascending=[False, True], kind="stable")
        bins = best_fit(x["n"].to_numpy(), capacity, max_documents, max_cost, weights)
        return pd.DataFrame({
            "sequence": "s" + x["shard"].astype(str) + "-" + pd.Series(bins, index=x.index).astype(str),
            "doc": x["doc"], "piece": x["piece"], "first_token": x["piece"].astype("int64") * capacity, "n_tokens": x["n"],
        })

    schema = f"sequence string, doc {documents.schema[doc].dataType.simpleString()}, piece int, first_token bigint, n_tokens bigint"
    return whole.unionByName(items.groupBy("shard").applyInPandas(place, schema)).withColumnRenamed("doc", doc)


def fill(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, tokens, and the share of all room that is filled."""
    return packed.groupBy("sequence").agg(F.sum("n_tokens").alias("t")).agg(
        F.count("*").alias("n_sequences"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * F.lit(float(capacity)))).alias("filled"), F.max("t").alias("largest")
    )
