"""Tokens, index and BM25 on a small corpus with known values."""

import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankloom.functions.text import STOPWORDS, field_tokens, tokens
from rankloom.operators import lexical

TOY = {"D0": "cat cat dog", "D1": "cat bird", "D2": "dog dog dog bird", "D3": "fish", "D4": "cat dog bird fish"}


def index(spark, docs=TOY):
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    return lexical.build_index(df, "id", tokens(F.col("text"), None))


def queries(spark, **words):
    return spark.createDataFrame([(q, t, c) for q, w in words.items() for t, c in Counter(w.split()).items()], "q string, term string, q_ int").selectExpr("q query", "term", "q_ q")


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("Dog BITES Man", None, "dog bites man"), ("the cat and the dog", "en", "cat dog"), ("Røde Kors på Fyn", None, "røde kors på fyn"), ("Røde Kors på Fyn", "da", "røde kors fyn"),
        ("der som", "da", ""), ("a b cd", None, "cd"), (None, "en", ""), ("", "en", ""), ("det er en test af noget", "da", "test"), ("snake_case x1", "xx", "snake_case x1"),
    ],
)
def test_tokens(spark, text, lang, want):
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), lang)).first()[0]
    assert got == want.split()


def test_fields_and_stop_words(spark):
    df = spark.createDataFrame([("Cat news", "About a dog"), ("Cat news", None)], "t string, a string")
    assert [r[0] for r in df.select(field_tokens(F.col("t"), F.col("a"), lang=None)).collect()] == [["cat", "news", "about", "dog"], ["cat", "news"]]
    assert len(STOPWORDS["en"]) == 38 and len(set(STOPWORDS["da"])) == 90


def test_index(spark):
    ix = index(spark)
    assert (ix.n, ix.avgdl) == (5, pytest.approx(2.8))
    assert rows(ix.postings.where("term = 'cat'").select("id", "tf")) == [("D0", 2), ("D1", 1), ("D4", 1)]
    assert tuple(lexical.index_stats(ix).first()) == (5, 4, 11, 2.8)
    with pytest.raises(ValueError, match="more than once"):
        lexical.build_index(spark.createDataFrame([("a", "x y")] * 2, "id string, text string"), "id", tokens(F.col("text"), None))


def test_known_score_and_okapi(spark):
    ix = index(spark)
    got = lexical.search(queries(spark, a="fish", b="dog", c="nothing"), lexical.impacts(ix), "query", 10)
    by = {(r["query"], r["id"]): r for r in got.collect()}
    assert by["a", "D3"]["score"] == pytest.approx(1.1879, abs=1e-4) and by["b", "D2"]["place"] == 1 and not [k for k in by if k[0] == "c"]
    idf = {r["term"]: r["idf"] for r in lexical.idf(ix, "okapi").collect()}
    raw = {t: math.log(5 - d + 0.5) - math.log(d + 0.5) for t, d in {"cat": 3, "dog": 3, "bird": 3, "fish": 2}.items()}
    mean = sum(raw.values()) / 4
    assert all(idf[t] == pytest.approx(v if v > 0 else 0.25 * mean) for t, v in raw.items())
    with pytest.raises(ValueError, match="variant"):
        lexical.idf(ix, "other")


@pytest.mark.parametrize("block", [50_000, 20])
def test_random_corpus(spark, block, monkeypatch):
    """Search and slate scores agree with a plain sum, however queries and documents are cut into blocks."""
    monkeypatch.setattr(lexical, "DOC_BLOCK", block)
    r = random.Random(7)
    docs = {f"d{i:03d}": " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(2, 60))) for i in range(60)}
    asked = {f"q{i}": " ".join(f"w{r.randrange(45)}" for _ in range(r.randrange(1, 8))) for i in range(12)}
    ix = index(spark, docs)
    tf = {d: Counter(t.split()) for d, t in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    avg = sum(sum(c.values()) for c in tf.values()) / len(tf)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    plain = lambda q, d: sum(idf[w] * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * sum(tf[d].values()) / avg)) for w in asked[q].split() if w in tf[d])
    weights = lexical.impacts(ix)
    got = lexical.search(queries(spark, **asked), weights, "query", 5).collect()
    for q in asked:
        best = sorted(((-round(plain(q, d), 9), d) for d in docs if set(asked[q].split()) & set(tf[d])))[:5]
        assert [x["id"] for x in sorted((x for x in got if x["query"] == q), key=lambda x: x["place"])] == [d for _, d in best]
    pairs = spark.createDataFrame([(q, d) for q in [*asked, "none"] for d in ["d000", "d001", "missing"]] * 2, "query string, article_id string")
    scored = {(x["query"], x["article_id"]): x["score"] for x in lexical.slate_scores(pairs, queries(spark, **asked), weights, "query").collect()}
    assert len(scored) == 39 and all(v == pytest.approx(plain(q, d) if q in asked and d in tf else 0.0) for (q, d), v in scored.items())


def test_query_terms_cut_before_lookup(spark):
    h = spark.createDataFrame([(1, [10, 11, 99]), (2, [11, 11]), (3, None), (4, [])], "u int, article_ids array<int>")
    texts = spark.createDataFrame([(10, "ten"), (11, "eleven eleven")], "article_id int, text string")
    got = rows(lexical.query_terms(h, texts, "u", tokens(F.col("text"), None), 2))
    assert got == [(1, "eleven", 2), (2, "eleven", 4)]
    with pytest.raises(ValueError, match="at least 1"):
        lexical.query_terms(h, texts, "u", tokens(F.col("text")), 0)


def test_recall(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 60), (2, "c", 1)], "query int, id string, place int")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x"), (1, "a"), (3, "z")], "query int, id string")
    got = {r["k"]: tuple(r)[1:] for r in lexical.recall_at(found, want, "query").collect()}
    assert got[50] == (1, 3, 1, 1, pytest.approx(1 / 3)) and got[100] == (2, 3, 1, 1, pytest.approx(2 / 3))


def test_empty_index(spark):
    ix = index(spark, {"D": ""})
    assert ix.n == 1 and lexical.search(queries(spark, a="x"), lexical.impacts(ix), "query", 5).count() == 0
