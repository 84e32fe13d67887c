"""Term weights against a plain count."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.llm import distinctive as di

TEXTS = {1: "the harbour the boat", 2: "the boat race", 3: "the the tram tram", 4: None, 5: "", 6: "a b", 7: "harbour boat " * 3000, 8: "ÆBLE æble the"}


def counts(spark):
    df = spark.createDataFrame([*TEXTS.items(), *list(TEXTS.items())[:2], (None, "the lost")], "id int, title string")
    return di.term_counts(df.withColumn("term", F.lit("clash")), "id", di.joined_text("title"))


def test_weights(spark):
    tf = {i: Counter(w for w in (t or "").lower().split() if len(w) > 1) for i, t in TEXTS.items()}
    tf = {i: c for i, c in tf.items() if c}
    df, cf = Counter(w for c in tf.values() for w in c), sum(tf.values(), Counter())
    total, n = sum(cf.values()), len(tf)
    for score in ("tf_idf", "divergence"):
        got = {(r["id"], r["term"]): r["weight"] for r in di.term_weights(counts(spark), score).collect()}
        assert set(got) == {(i, w) for i, c in tf.items() for w in c if 2 <= df[w] < n}
        for (i, w), v in got.items():
            p = cf[w] / total
            q = (tf[i][w] + 50 * p) / (sum(tf[i].values()) + 50)
            assert v == pytest.approx(tf[i][w] * math.log(n / df[w]) if score == "tf_idf" else q * math.log(q / p))


def test_top_and_ties(spark):
    w = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0), (2, "z", 0.5)], "id int, term string, weight double")
    assert [(r["id"], r["term"]) for r in sorted(di.top_terms(w, 2).collect(), key=lambda r: (r["id"], r["place"]))] == [(1, "c"), (1, "a"), (2, "z")]


def test_empty_and_unknown(spark):
    none = counts(spark).limit(0)
    assert di.term_weights(none).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        di.term_weights(counts(spark), "other")
