"""Inverted index and BM25 as tables: postings(term, id, dl, tf), docs(id, dl), idf(term, df, idf)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.cells import block_of, blocks_for, lengths, meet
from rankloom.operators.heavy import heaviest, join_on_skewed_key
from rankloom.operators.lineage import cut_lineage

K1, B = 1.2, 0.75
#: Share of the mean IDF that replaces an Okapi IDF of 0 or less.
OKAPI_FLOOR = 0.25
RECALL_AT = (50, 100, 200)
#: Documents that one task holds or that are broadcast (at 100 terms of 16 bytes, 40 MB).
DOC_BLOCK = 25_000


@dataclass(frozen=True)
class Index:
    """An index and its collection figures."""

    postings: DataFrame
    docs: DataFrame
    n: int
    avgdl: float


def build_index(texts: DataFrame, doc: str, tokens: Column) -> Index:
    """Index of one row per document. A document id that occurs twice raises; null ids are left out.

    A document without tokens counts in n and in the mean length. Postings are checkpointed, so texts are tokenised
    once however many figures are drawn from them.
    """
    docs = texts.where(F.col(doc).isNotNull()).select(F.col(doc).alias("id"), tokens.alias("w"))
    # One row per term of a document, and one without a term for the document itself.
    term = F.explode(F.concat(F.array(F.lit(None).cast("string")), "w"))
    counted = cut_lineage(docs.select("id", F.size("w").alias("dl"), term.alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    own = counted.where("term IS NULL")
    figures = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.max("tf").alias("most"), F.count_distinct("id").alias("ids")).first()
    if (figures["most"] or 0) > 1 or figures["ids"] < figures["n"]:
        raise ValueError("a document id occurs more than once")
    return Index(counted.where("term IS NOT NULL").select("term", "id", "dl", "tf"), own.select("id", "dl"), figures["n"], figures["avgdl"] or 0.0)


def index_stats(index: Index) -> DataFrame:
    """One row: documents, unique_terms, postings, avgdl (two decimals)."""
    per_term = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return per_term.agg(F.count("*").alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).select(
        F.lit(index.n).cast("long").alias("documents"), "unique_terms", "postings", F.round(F.lit(index.avgdl), 2).alias("avgdl")
    )


def idf(index: Index, variant: str = "lucene") -> DataFrame:
    """(term, df, idf). lucene: ln(1 + (N - df + .5) / (df + .5)). okapi: ln(N - df + .5) - ln(df + .5), values <= 0
    replaced by a quarter of the mean over all terms."""
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(index.n))
    if variant == "lucene":
        return df.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if variant != "okapi":
        raise ValueError(f"unknown variant {variant}")
    raw = df.withColumn("raw", F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") <= 0, F.lit(OKAPI_FLOOR * mean)).otherwise(F.col("raw")).alias("idf"))


def impacts(index: Index, variant: str = "lucene", k1: float = K1, b: float = B) -> DataFrame:
    """(term, id, impact): what one occurrence of the term in a query adds to the document's score."""
    terms = idf(index, variant)
    rows = join_on_skewed_key(index.postings, terms, "term", heaviest(terms, "term", "df"), "inner")
    length = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl or 1.0)
    return rows.select("term", "id", (F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * length)).alias("impact"))


def query_terms(histories: DataFrame, texts: DataFrame, query: str, tokens: Column, n_recent: int = 5) -> DataFrame:
    """(query, term, q): terms of the last ``n_recent`` articles of each history (query, article_ids), with counts.

    The history is cut before ids are looked up; unknown ids add nothing; an article that occurs twice counts twice.
    """
    if n_recent < 1:
        raise ValueError("n_recent must be at least 1")
    tail = F.reverse(F.slice(F.reverse("article_ids"), 1, n_recent))
    reads = histories.select(query, F.explode(tail).alias("article_id")).groupBy(query, "article_id").agg(F.count("*").alias("c"))
    words = texts.select("article_id", tokens.alias("w"))
    return reads.join(words, "article_id").select(query, "c", F.explode("w").alias("term")).groupBy(query, "term").agg(F.sum("c").alias("q"))


def _documents(weights: DataFrame) -> DataFrame:
    """(id, terms, impacts): a document's terms, as hashes of 64 bits, with their impacts: one row per document."""
    one = F.collect_list(F.struct(F.xxhash64("term").alias("t"), "impact"))
    return weights.groupBy("id").agg(one.alias("d")).select("id", F.col("d.t").alias("terms"), F.col("d.impact").alias("impacts"))


def _asked(queries: DataFrame, query: str) -> DataFrame:
    """(k, terms, counts): one row per query."""
    one = F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("q").cast("double").alias("q")))
    return queries.where(F.col(query).isNotNull()).groupBy(F.col(query).alias("k")).agg(one.alias("d")).select("k", F.col("d.t").alias("terms"), F.col("d.q").alias("counts"))


class _Held:
    """Documents in memory: postings sorted by term, and every document's terms in a row, as numbers of the terms."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.ids = table["id"].to_numpy()
        whole = [table[c].combine_chunks() for c in ("terms", "impacts")]
        self.size = lengths(whole[0])
        self.start = np.r_[0, np.cumsum(self.size)]
        hashes, self.impact = whole[0].flatten().to_numpy(zero_copy_only=False), whole[1].flatten().to_numpy(zero_copy_only=False)
        self.terms, self.code = np.unique(hashes, return_inverse=True)
        self.doc = np.repeat(np.arange(len(self.ids)), self.size)
        self.by_term = np.argsort(self.code, kind="stable")
        self.edge = np.r_[0, np.cumsum(np.bincount(self.code, minlength=len(self.terms)))]

    def query(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the query's terms that occur here."""
        if not len(self.terms):
            return np.zeros(0, int), np.zeros(0)
        at = np.searchsorted(self.terms, terms).clip(max=len(self.terms) - 1)
        ok = self.terms[at] == terms
        return at[ok], counts[ok]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start .. start + size - 1 of every run, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _each_query(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    edge = np.r_[0, np.cumsum(lengths(b.column("terms")))]
    terms, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
    for i in range(b.num_rows):
        yield i, terms[edge[i] : edge[i + 1]], counts[edge[i] : edge[i + 1]]


def search(queries: DataFrame, weights: DataFrame, query: str, k: int, n_docs: int | None = None) -> DataFrame:
    """(query, id, score, place): the k best documents that share a term with the query, ties by smaller id.

    ``queries`` is (query, term, q), ``weights`` comes from ``impacts``. Joining them on the term would shuffle a row
    for every query, term and document that meet; instead every query meets every block of documents, walks the
    postings of its terms there and keeps k documents. Terms meet by a hash of 64 bits. Scores are compared after
    rounding to 9 decimals. ``n_docs`` spares counting the documents.
    """
    kind, what = queries.schema[query].dataType.simpleString(), weights.schema["id"].dataType.simpleString()
    blocks = blocks_for(weights.select("id").distinct().count() if n_docs is None else n_docs, DOC_BLOCK)
    rows = _asked(queries, query).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(held: _Held, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, ids, scores = [], [], []
        for i, terms, counts in _each_query(b):
            t, q = held.query(terms, counts)
            size = held.edge[t + 1] - held.edge[t]
            hit = held.by_term[_runs(held.edge[t], size)]
            if not len(hit):
                continue
            docs = held.doc[hit]
            score = np.bincount(docs, held.impact[hit] * np.repeat(q, size), len(held.ids))
            found = np.flatnonzero(np.bincount(docs, minlength=len(held.ids)))
            value = np.round(score[found], 9)
            if len(found) > k:
                edge = np.partition(value, len(value) - k)[len(value) - k]
                found, value = found[value >= edge], value[value >= edge]
            found = found[np.argsort(-value, kind="stable")[:k]]
            at.append(np.full(len(found), i))
            ids.append(held.ids[found])
            scores.append(score[found])
        if at:
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["q", "id", "score"])

    got = meet(rows, _documents(weights), blocks, _Held, best, f"q {kind}, id {what}, score double", ["k"])
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumnRenamed("q", query)


def slate_scores(pairs: DataFrame, queries: DataFrame, weights: DataFrame, query: str, doc: str = "article_id", n_docs: int | None = None) -> DataFrame:
    """(query, doc, score) of given pairs, 0.0 where nothing is shared or the document is not indexed.

    Pairs are made distinct first, so a pair that occurs in many slates is scored once; pairs with a null are left
    out. A query's documents are gathered per block of documents, joined with the query's terms once, and scored where
    the block's documents are held, so neither postings nor terms are shipped for a pair.
    """
    what, kind = weights.schema["id"].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    blocks = blocks_for(weights.select("id").distinct().count() if n_docs is None else n_docs, DOC_BLOCK)
    wanted = pairs.select(F.col(query).cast(kind).alias("k"), F.col(doc).cast(what).alias("id")).dropna().distinct()
    lists = wanted.groupBy("k", block_of(F.col("id"), blocks).alias("block")).agg(F.collect_list("id").alias("ids"))
    rows = lists.join(_asked(queries, query), "k", "left")

    def score(held: _Held, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = lengths(b.column("ids"))
        ids = b.column("ids").flatten()
        want = ids.to_numpy(zero_copy_only=False)
        out = np.zeros(len(want))
        edge = np.r_[0, np.cumsum(size)]
        if len(held.ids):
            place = np.searchsorted(held.ids, want).clip(max=len(held.ids) - 1)
            hit = held.ids[place] == want
            weight = np.zeros(len(held.terms))
            for i, terms, counts in _each_query(b):
                t, q = held.query(terms, counts)
                mine = edge[i] + np.flatnonzero(hit[edge[i] : edge[i + 1]])
                if len(t) and len(mine):
                    weight[t] = q
                    docs = place[mine]
                    at = _runs(held.start[docs], held.size[docs])
                    out[mine] = np.bincount(np.repeat(np.arange(len(mine)), held.size[docs]), held.impact[at] * weight[held.code[at]], len(mine))
                    weight[t] = 0.0
        yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(np.repeat(np.arange(b.num_rows), size))), ids, pa.array(out)], ["query", "id", "score"])

    got = meet(rows, _documents(weights), blocks, _Held, score, f"query {kind}, id {what}, score double", ["k"])
    return got.withColumnRenamed("query", query).withColumnRenamed("id", doc)


def recall_at(retrieved: DataFrame, relevant: DataFrame, query: str, at: tuple[int, ...] = RECALL_AT, case: str | None = None) -> DataFrame:
    """(k, hits, relevant, scored, skipped, recall): micro recall over cases whose query has results.

    ``retrieved`` is (query, id, place) at the largest k; ``relevant`` (query, id) and, where several cases share a
    query, ``case``, say an impression; without it a query is its own case. Cases without results are skipped and
    counted; without relevant rows recall is null.
    """
    wanted = relevant.select(query, F.col(case or query).alias("__case"), "id").distinct()
    served = retrieved.select(query).distinct().withColumn("served", F.lit(True))
    marked = wanted.join(served, query, "left").join(retrieved.select(query, "id", "place"), [query, "id"], "left")
    per = marked.groupBy("__case").agg(F.max("served").alias("served"), F.count("*").alias("n"), *[F.count(F.when(F.col("place") <= k, 1)).alias(f"h{k}") for k in at])
    sums = per.agg(
        F.coalesce(F.sum(F.when(F.col("served"), F.col("n"))), F.lit(0)).alias("relevant"), F.count(F.when(F.col("served"), 1)).alias("scored"),
        F.count(F.when(F.col("served").isNull(), 1)).alias("skipped"), *[F.coalesce(F.sum(F.when(F.col("served"), F.col(f"h{k}"))), F.lit(0)).alias(f"h{k}") for k in at],
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in at]))
    return sums.select(each.alias("x"), "relevant", "scored", "skipped").select("x.k", "x.hits", "relevant", "scored", "skipped", F.when(F.col("relevant") > 0, F.col("x.hits") / F.col("relevant")).alias("recall"))
