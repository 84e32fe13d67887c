"""Queries p3, p5, p6, p8, p9 and p10 and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import distinctive, mixing, nearest, packing, rank_fusion, sentences
from rankloom.operators.lineage import cut_lineage
from rankloom.sources.tables import table

SCORES = ("bm25", "semantic", "pop_total")
UNKNOWN = {"pop_total": -1}
SEQUENCE = 4096
#: Bounds of p8_vector: documents of a sequence, and the sum of their squared sizes.
VECTOR_DOCUMENTS, VECTOR_COST = 6, 0.3 * SEQUENCE**2
#: Parts over which documents without an article are spread.
NO_ARTICLE_PARTS = 10_000
#: White characters, as a class both engines know.
WHITE_CLASS = "[ \\t\\n\\r\\x{00A0}\\x{3000}]"


def _ranks(spark: SparkSession, folder: str, hot: list | None = None) -> DataFrame:
    return rank_fusion.rank_scores(table(spark, folder, "candidate_scores"), "impression_id", "pos", SCORES, UNKNOWN, hot=hot)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """First three candidates of every slate by the sum of their reciprocal ranks."""
    best = rank_fusion.fuse_reciprocal(_ranks(spark, folder), SCORES, top=3)
    return best.select(F.col("grp").alias("impression_id"), "pos")


def p3_principal(spark: SparkSession, folder: str) -> DataFrame:
    """Order of every slate by the first principal component of the rank-transformed scores."""
    hot = rank_fusion.hot_groups(table(spark, folder, "candidate_scores"), "impression_id")
    best = rank_fusion.fuse_principal(_ranks(spark, folder, hot), SCORES, hot=hot)
    return best.select(F.col("grp").alias("impression_id"), "pos", F.round("projection", 5).alias("projection"), F.col("place").cast("long").alias("place"))


def p3_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Every score's rank within its slate."""
    return _ranks(spark, folder).select(F.col("grp").alias("impression_id"), "pos", *[F.col(f"rank_{s}").cast("long").alias(f"rank_{s}") for s in SCORES])


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.term_counts(table(spark, folder, "articles"), "article_id", distinctive.joined_text("title", "abstract"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The term of every article with the highest tf * ln(n / df)."""
    top = distinctive.top_terms(distinctive.term_weights(_terms(spark, folder), "tf_idf"), 1)
    return top.select(F.col("id").alias("article_id"), "term")


def p5_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every article with its part of the article's divergence from the collection."""
    weights = distinctive.term_weights(_terms(spark, folder), "divergence")
    return weights.select(F.col("id").alias("article_id"), "term", F.round("weight", 8).alias("weight"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of articles with cosine 0.65 or more of which one is among the other's five nearest."""
    near = nearest.nearest(table(spark, folder, "document_vector"), "article_id", "document_vector", 300, 5, 0.65)
    pair = near.select(F.least("id", "neighbour").cast("int").alias("article_id_a"), F.greatest("id", "neighbour").cast("int").alias("article_id_b"))
    return pair.distinct()


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", packing.byte_tokens(F.col("text")), SEQUENCE)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lie in more than one sequence."""
    places = _packed(spark, folder).groupBy("doc_id").agg(F.count_distinct("sequence").alias("n"))
    return places.where("n > 1").select("doc_id")


def p8_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document its pieces and tokens, whether they cover it once from end to end, and whether its sequences keep the bound."""
    return _whole(_packed(spark, folder), SEQUENCE, 512, None)


def _whole(packed: DataFrame, capacity: int, documents: int, cost: float | None) -> DataFrame:
    held = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("c"))
    kept = (F.col("t") <= capacity) & (F.col("d") <= documents)
    kept = kept if cost is None else kept & ((F.col("c") <= cost) | (F.col("d") == 1))
    rows = packed.join(held.select("sequence", kept.alias("kept")), "sequence")
    per = rows.groupBy("doc_id").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.min("first_token").alias("lo"), F.max(F.col("first_token") + F.col("n_tokens")).alias("hi"),
        F.count_distinct("piece").alias("different"), F.min("kept").alias("within"),
    )
    covered = (F.col("lo") == 0) & (F.col("hi") == F.col("tokens")) & (F.col("different") == F.col("pieces"))
    return per.select("doc_id", "pieces", "tokens", covered.alias("covered"), "within")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens in sequences, the least number of sequences that could hold them, and whether hardly more are used."""
    row = packing.fill(_packed(spark, folder), SEQUENCE)
    least = F.ceil(F.col("n_tokens") / F.lit(float(SEQUENCE)))
    return row.select("n_tokens", least.alias("least_sequences"), (F.col("largest") <= SEQUENCE).alias("bound_kept"), (F.col("n_sequences") <= 1.001 * least + 2).alias("nearly_full"))


def p8_vector(spark: SparkSession, folder: str) -> DataFrame:
    """As p8_sequences with bounds on documents and attention cost that bind beside the tokens."""
    docs = table(spark, folder, "documents")
    packed = packing.pack(docs, "doc_id", packing.byte_tokens(F.col("text")), SEQUENCE, VECTOR_DOCUMENTS, VECTOR_COST)
    return _whole(packed, SEQUENCE, VECTOR_DOCUMENTS, VECTOR_COST)


def p8_vector_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Packing under three bounds: the sequences each bound alone would need, and whether hardly more than the most are used."""
    docs = table(spark, folder, "documents")
    packed = packing.pack(docs, "doc_id", packing.byte_tokens(F.col("text")), SEQUENCE, VECTOR_DOCUMENTS, VECTOR_COST)
    row = packed.agg(
        F.ceil(F.sum("n_tokens") / F.lit(float(SEQUENCE))).alias("by_tokens"), F.ceil(F.count("*") / F.lit(float(VECTOR_DOCUMENTS))).alias("by_documents"),
        F.ceil(F.sum(F.least(F.col("n_tokens") * F.col("n_tokens"), F.lit(VECTOR_COST))) / F.lit(VECTOR_COST)).alias("by_cost"), F.count_distinct("sequence").alias("used"),
    )
    most = F.greatest("by_tokens", "by_documents", "by_cost")
    return row.select("by_tokens", "by_documents", "by_cost", (F.col("used") <= 1.5 * most + 2).alias("near_the_bounds"))


def _mix_input(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the main section of their article as topic."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "article_id", packing.byte_tokens(F.col("text")).alias("size"))
    section = F.substring_index(F.lower(F.trim("category_str")), "_", 1)
    topics = table(spark, folder, "articles").where("article_id IS NOT NULL").groupBy("article_id").agg(F.min(F.when(section != "", section)).alias("topic"))
    # part spreads the documents without an article, two in five; it is 0 for others, written so that it stays a key of the join
    part = F.pmod(F.col("article_id"), F.lit(1)).cast("long")
    docs = docs.withColumn("part", F.coalesce(part, F.pmod(F.xxhash64("doc_id"), F.lit(NO_ARTICLE_PARTS))))
    return docs.join(topics.withColumn("part", part), ["article_id", "part"], "left").drop("part")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which the mix uses every document as often as it may and still has less than their share."""
    got = mixing.reach(_mix_input(spark, folder), table(spark, folder, "mix_targets"), F.col("size"), F.col("topic"))
    return got.where("used_up AND drawn < wanted").select("source")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _mix_input(spark, folder)
    sizes = mixing.source_sizes(docs, table(spark, folder, "mix_targets"), F.col("size"))
    return sizes, mixing.mix(docs, table(spark, folder, "mix_targets"), F.col("size"), F.col("topic"), sizes)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document whose source has a target, with its tokens and whether its uses lie between 0 and the source's cap."""
    docs = _mix_input(spark, folder)
    sizes, mixed = _mix(spark, folder)
    caps = sizes.groupBy("key").agg(F.min("source").alias("source"), F.max("max_repeats").alias("cap"))  # one row per target
    rows = docs.where("size > 0").withColumn("key", mixing.same_source(F.col("source"))).drop("source").join(F.broadcast(caps), "key")
    both = rows.join(mixed.select("doc_id", "uses"), "doc_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return both.select("doc_id", "source", F.col("size").alias("n_tokens"), F.col("uses").between(0, F.col("cap")).alias("within"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every margin of the mix with its tokens in the corpus and whether the mix reaches its target.

    A reachable source must have its wanted tokens within 3 % or 4,096 tokens, an unreachable one all it may give; a
    language's or topic's share must lie within 0.03 or 4,096 tokens of its share in the corpus. The allowance in
    tokens is for small corpora, where whole documents cannot come nearer.
    """
    docs = _mix_input(spark, folder)
    sizes, mixed = _mix(spark, folder)
    mixed = cut_lineage(mixed)
    report = mixing.mix_report(sizes, mixed)
    slack = F.greatest(F.lit(0.03) * F.col("wanted"), F.lit(float(SEQUENCE)))
    full = F.col("drawn") == F.col("size") * F.greatest("max_repeats", F.lit(0))
    sources = report.select(F.lit("source").alias("margin"), F.col("source").alias("name"), F.col("size").cast("long").alias("n_tokens"), F.when(F.col("reachable"), F.abs(F.col("drawn") - F.col("wanted")) <= slack).otherwise(full).alias("reached"))
    keys = sizes.select("key").distinct()
    used = docs.where("size > 0").withColumn("key", mixing.same_source(F.col("source"))).join(F.broadcast(keys), "key", "left_semi")
    rows = mixing.margins(used, mixed, F.col("topic"))
    total = rows.where("margin = 'lang'").agg(F.sum("n_tokens").alias("t"), F.sum("drawn").alias("d"))
    others = rows.crossJoin(F.broadcast(total)).select("margin", "name", F.col("n_tokens").cast("long").alias("n_tokens"), (F.abs(F.col("n_tokens") / F.col("t") - F.col("drawn") / F.col("d")) <= F.greatest(F.lit(0.03), F.lit(float(SEQUENCE)) / F.col("t"))).alias("reached"))
    return sources.unionByName(others)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every document."""
    return sentences.split_sentences(table(spark, folder, "documents"))


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document with sentences its non-white characters, how many lie in a sentence, and whether sentences lie in order."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = p10_found(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("spans"))  # of one text
    rows = docs.join(spans, "doc_id")
    solid = lambda x: F.length(F.regexp_replace(x, WHITE_CLASS, ""))
    inside = F.aggregate("spans", F.lit(0), lambda n, x: n + solid(F.col("text").substr(x["start_pos"] + 1, x["end_pos"] - x["start_pos"])))
    last = F.aggregate("spans", F.lit(0), lambda at, x: F.when((at >= 0) & (x["start_pos"] >= at) & (x["end_pos"] > x["start_pos"]), x["end_pos"]).otherwise(F.lit(-1)))
    return rows.select("doc_id", solid(F.col("text")).cast("long").alias("n_solid"), inside.cast("long").alias("n_covered"), (last >= 0).alias("in_order"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_principal, p3_ranks, p5_found, p5_divergence, p6_found, p8_found, p8_sequences, p8_fill, p8_vector, p8_vector_fill, p9_found, p9_mix, p9_report, p10_found, p10_coverage,
    )
}

_RANKED = """WITH s AS (SELECT DISTINCT * FROM candidate_scores WHERE impression_id IS NOT NULL AND pos IS NOT NULL),
v AS (SELECT impression_id, pos, CASE WHEN NOT isnan(bm25) THEN bm25 END AS a, CASE WHEN NOT isnan(semantic) THEN semantic END AS b, CASE WHEN pop_total <> -1 THEN pop_total END AS c FROM s),
r AS (SELECT impression_id, pos, CASE WHEN a IS NOT NULL THEN row_number() OVER (PARTITION BY impression_id ORDER BY a DESC NULLS LAST, pos) END AS rank_bm25,
  CASE WHEN b IS NOT NULL THEN row_number() OVER (PARTITION BY impression_id ORDER BY b DESC NULLS LAST, pos) END AS rank_semantic,
  CASE WHEN c IS NOT NULL THEN row_number() OVER (PARTITION BY impression_id ORDER BY c DESC NULLS LAST, pos) END AS rank_pop_total FROM v)"""

_COUNTED = r"""WITH a AS (SELECT DISTINCT article_id AS id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS text FROM articles WHERE article_id IS NOT NULL),
w AS (SELECT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM a),
tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
dl AS (SELECT id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY 1),
df AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf FROM tf GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, sum(dl) AS c FROM dl)"""

SQL = {
    "p3_found": f"""{_RANKED}, f AS (SELECT impression_id, pos, round(coalesce(1.0::DOUBLE / (60 + rank_bm25), 0) + coalesce(1.0::DOUBLE / (60 + rank_semantic), 0) + coalesce(1.0::DOUBLE / (60 + rank_pop_total), 0), 10) AS worth
  FROM r WHERE coalesce(rank_bm25, rank_semantic, rank_pop_total) IS NOT NULL)
SELECT impression_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY worth DESC, pos) AS rn FROM f) WHERE rn <= 3""",
    "p3_ranks": f"{_RANKED} SELECT * FROM r",
    "p3_principal": f"""{_RANKED.replace("WITH s", "WITH RECURSIVE s")},
h AS (SELECT *, count(rank_bm25) OVER w AS h0, count(rank_semantic) OVER w AS h1, count(rank_pop_total) OVER w AS h2 FROM r WINDOW w AS (PARTITION BY impression_id)),
u AS (SELECT impression_id, pos, coalesce(1 - (rank_bm25 - 0.5::DOUBLE) / h0, 0.5) AS x, coalesce(1 - (rank_semantic - 0.5::DOUBLE) / h1, 0.5) AS y, coalesce(1 - (rank_pop_total - 0.5::DOUBLE) / h2, 0.5) AS z FROM h),
m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM u),
step AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c UNION ALL
  SELECT i + 1, (a + xy * b + xz * c) / l, (xy * a + b + yz * c) / l, (xz * a + yz * b + c) / l FROM
  (SELECT *, sqrt(pow(a + xy * b + xz * c, 2) + pow(xy * a + b + yz * c, 2) + pow(xz * a + yz * b + c, 2)) AS l FROM step, m) WHERE i < 2000),
p AS (SELECT impression_id, pos, round((x - mx) / sx * a + (y - my) / sy * b + (z - mz) / sz * c, 9) AS projection FROM u, m, step WHERE i = 2000)
SELECT impression_id, pos, round(projection, 5) AS projection, row_number() OVER (PARTITION BY impression_id ORDER BY projection DESC, pos) AS place FROM p""",
    "p5_found": f"""{_COUNTED} SELECT id AS article_id, term FROM (SELECT tf.id, tf.term, row_number() OVER (PARTITION BY tf.id ORDER BY tf.tf * ln(n / df.df) DESC, tf.term) AS rn
  FROM tf JOIN df USING (term), n WHERE df.df >= 2 AND df.df < n) WHERE rn = 1""",
    "p5_divergence": f"""{_COUNTED}, q AS (SELECT tf.id, tf.term, df.cf / n.c AS p, (tf.tf + {distinctive.DIRICHLET_MU}::DOUBLE * (df.cf / n.c)) / (dl.dl + {distinctive.DIRICHLET_MU}::DOUBLE) AS q
  FROM tf JOIN df USING (term) JOIN dl ON dl.id = tf.id, n WHERE df.df >= 2 AND df.df < n)
SELECT id AS article_id, term, round(q * ln(q / p), 8) AS weight FROM q""",
    "p6_found": """WITH u AS (SELECT DISTINCT article_id AS id, CAST(document_vector AS DOUBLE[]) AS v FROM document_vector
  WHERE len(document_vector) = 300 AND len(list_filter(document_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(document_vector, lambda x: x <> 0)) > 0),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rn FROM c)
SELECT DISTINCT least(a, b) AS article_id_a, greatest(a, b) AS article_id_b FROM r WHERE rn <= 5 AND cosine >= 0.65""",
    "p8_found": f"SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > {SEQUENCE}",
    "p8_sequences": f"SELECT doc_id, CAST(ceil(strlen(text) / {SEQUENCE}.0) AS BIGINT) AS pieces, strlen(text) AS tokens, true AS covered, true AS within FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 0",
    "p8_vector": f"SELECT doc_id, CAST(ceil(strlen(text) / {SEQUENCE}.0) AS BIGINT) AS pieces, strlen(text) AS tokens, true AS covered, true AS within FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 0",
    "p8_fill": f"SELECT CAST(sum(strlen(text)) AS BIGINT) AS n_tokens, CAST(ceil(sum(strlen(text)) / {SEQUENCE}.0) AS BIGINT) AS least_sequences, true AS bound_kept, true AS nearly_full FROM documents WHERE doc_id IS NOT NULL",
    "p8_vector_fill": f"""WITH d AS (SELECT strlen(text) AS n FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 0),
p AS (SELECT unnest(list_concat(list_transform(range(n // {SEQUENCE}), lambda i: {SEQUENCE}), CASE WHEN n % {SEQUENCE} > 0 THEN [n % {SEQUENCE}] ELSE [] END)) AS n FROM d)
SELECT CAST(ceil(sum(n) / {SEQUENCE}.0) AS BIGINT) AS by_tokens, CAST(ceil(count(*) / {VECTOR_DOCUMENTS}.0) AS BIGINT) AS by_documents, CAST(ceil(sum(least(n * n, {VECTOR_COST})) / {VECTOR_COST}) AS BIGINT) AS by_cost, true AS near_the_bounds FROM p""",
    "p9_mix": """WITH t AS (SELECT lower(trim(source)) AS key, min(source) AS source FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
SELECT doc_id, t.source, strlen(text) AS n_tokens, true AS within FROM documents d JOIN t ON t.key = lower(trim(d.source)) WHERE strlen(text) > 0""",
    "p9_report": f"""WITH t AS (SELECT DISTINCT lower(trim(source)) AS key, source FROM mix_targets WHERE source IS NOT NULL),
sec AS (SELECT article_id, min(nullif(split_part(lower(trim(category_str)), '_', 1), '')) AS topic FROM articles WHERE article_id IS NOT NULL GROUP BY 1),
code AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in mixing.LONG_CODES.items())}) v(long, short)),
d AS (SELECT lower(trim(source)) AS key, split_part(lower(trim(lang)), '-', 1) AS l, article_id, strlen(text) AS n FROM documents WHERE strlen(text) > 0 AND lower(trim(source)) IN (SELECT key FROM t)),
x AS (SELECT key, coalesce(short, nullif(l, ''), 'unknown') AS lang, coalesce(topic, 'none') AS topic, n FROM d LEFT JOIN code ON code.long = d.l LEFT JOIN sec USING (article_id))
SELECT 'source' AS margin, t.source AS name, CAST(coalesce((SELECT sum(n) FROM x WHERE x.key = t.key), 0) AS BIGINT) AS n_tokens, true AS reached FROM t
UNION ALL SELECT 'lang', lang, CAST(sum(n) AS BIGINT), true FROM x GROUP BY lang UNION ALL SELECT 'topic', topic, CAST(sum(n) AS BIGINT), true FROM x GROUP BY topic""",
    "p10_coverage": f"""SELECT doc_id, length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) AS n_solid, length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) AS n_covered, true AS in_order
FROM documents WHERE length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) > 0""",
    "p9_found": """WITH t AS (SELECT DISTINCT * FROM mix_targets WHERE source IS NOT NULL),
d AS (SELECT lower(trim(source)) AS key, sum(strlen(text)) AS size FROM documents GROUP BY 1),
s AS (SELECT t.*, coalesce(d.size, 0)::DOUBLE AS size FROM t LEFT JOIN d ON d.key = lower(trim(t.source)))
SELECT source FROM s WHERE size * max_repeats < (SELECT sum(size) FROM s) * target_weight / (SELECT sum(target_weight) FROM s)""",
}
