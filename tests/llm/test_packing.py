"""Packing keeps every token once, cuts only what must be cut, and leaves little room."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120), st.integers(1, 9), st.sampled_from([10_000.0, 6_000.0, 300.0]))
def test_bins_hold_all_bounds(sizes, documents, cost):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins = packing.best_fit(sizes, 100, documents, cost)
    for b in set(bins.tolist()):
        own = sizes[bins == b]
        assert own.sum() <= 100 and len(own) <= documents
        assert (own**2).sum() <= cost or len(own) == 1


def test_pack(spark):
    sizes = [0, 1, 5, 40, 60, 99, 100, 101, 250, 300, 7, 7, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(None, 5)], "doc_id bigint, n bigint").withColumn("sequence", F.lit("clash"))
    got = packing.pack(df, "doc_id", F.col("n"), 100).collect()
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    for i, n in enumerate(sizes):
        pieces = sorted(per.get(i, []))
        assert sum(x for _, x in pieces) == (n or 0) and len(pieces) == -(-(n or 0) // 100)
        assert [a for a, _ in pieces] == [100 * k for k in range(len(pieces))]
    fill = defaultdict(int)
    for r in got:
        fill[r["sequence"]] += r["n_tokens"]
    assert max(fill.values()) <= 100 and len(fill) == -(-sum(n or 0 for n in sizes) // 100)


def test_shards_and_fill(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).alias("n"))
    packed = packing.pack(df, "doc_id", F.col("n"), 100, shard_items=700)
    assert packed.groupBy("doc_id").count().count() == 3000
    got = packing.fill(packed, 100).first()
    assert got["filled"] > 0.99 and got["largest"] <= 100


def test_attention_bound(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([90, 30, 30, 30])], "doc_id bigint, n bigint")
    packed = packing.pack(df, "doc_id", F.col("n"), 100, max_cost=2000.0)
    assert packing.fill(packed, 100).first()["n_sequences"] == 3


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, n bigint")
    assert packing.pack(none, "doc_id", F.col("n"), 100).count() == 0


def test_byte_tokens(spark):
    got = spark.createDataFrame([("abc",), ("æ",), ("",), (None,)], "t string").select(packing.byte_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 2, 0, None]


@pytest.mark.parametrize("n", [0, 1])
def test_few_items(n):
    assert len(packing.best_fit(np.full(n, 5), 10, 2, 100.0)) == n
