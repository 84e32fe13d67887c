"""Queries of the ranking operators over the click log, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import STOPWORDS, field_tokens, join_fields
from rankloom.functions.vectors import dot, norm, usable
from rankloom.operators import beyond_accuracy, bootstrap, counts, lexical, ranker, ranking, splits, submission, vectors
from rankloom.operators.heavy import heavy_keys
from rankloom.operators.lineage import cut_lineage
from rankloom.plans.general import _LOG
from rankloom.sources import sinks
from rankloom.sources.tables import article_texts, candidate_rows, clicks, impressions, in_log, labels_of, publish_times, recent_history, table

CUTOFF = "2025-03-15 00:00:00"
KEY = ("impression_id", "user_id", "ts")
SLATE = ("impression_id",)
ALL_HISTORY = 1_000_000
HOURS = {"all": None, "24h": 86_400, "1h": 3_600}
DIM = 300
#: Lengths of history that searches are compared with.
N_RECENT = (1, 5, 20)
#: Angles of the cosine waves that readers' vectors are multiplied with.
PROBES = (0.37, 1.13, 2.71)


# --- inputs -----------------------------------------------------------------------------------------------------


def _impressions(spark: SparkSession, folder: str) -> DataFrame:
    return impressions(table(spark, folder, "behaviors"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_rows(_impressions(spark, folder), *KEY)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return article_texts(table(spark, folder, "articles"))


def _tokens(lang: str = "da"):
    return field_tokens(F.col("title"), F.col("abstract"), lang=lang)


def _index(spark: SparkSession, folder: str) -> lexical.Index:
    return lexical.build_index(_texts(spark, folder), "article_id", _tokens())


def _history(spark: SparkSession, folder: str, n: int = ALL_HISTORY) -> DataFrame:
    return recent_history(table(spark, folder, "history"), n)


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.lower(F.trim("category_str"))
    return table(spark, folder, "articles").where(F.col("article_id").isNotNull() & (kind != "")).groupBy("article_id").agg(F.min(kind).alias("category"))


def _slates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of scored slates with labels; missing scores count as 0."""
    rows = table(spark, folder, "candidate_scores").where("impression_id IS NOT NULL AND pos IS NOT NULL").dropDuplicates()
    clean = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0))
    hits = clicks(table(spark, folder, "behaviors")).where("impression_id <> 0").select("impression_id", "article_id").distinct().withColumn("label", F.lit(1))
    scored = rows.select("impression_id", "pos", "article_id", clean("bm25").alias("bm25"), clean("semantic").alias("semantic"), F.greatest(clean("pop_total"), F.lit(0.0)).alias("pop_total"))
    return scored.join(hits, ["impression_id", "article_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.unit_vectors(table(spark, folder, "document_vector"), "article_id", "document_vector", DIM)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.packed_vectors(table(spark, folder, "document_vector"), "article_id", "document_vector", DIM)


def _most_units(spark: SparkSession, folder: str) -> int:
    """At least as many as there are vectors; a count of rows reads no vector."""
    return table(spark, folder, "document_vector").count()


def _twentieth(df: DataFrame, key: str) -> DataFrame:
    """The stated query set: ids divisible by 20."""
    return df.where(F.col(key) % 20 == 0)


# --- counts and features ----------------------------------------------------------------------------------------


def click_counts(spark, folder):
    return counts.click_counts(_labelled(spark, folder))


def listed_counts(spark, folder):
    return counts.listed_counts(_impressions(spark, folder), "clicked")


def article_popularity(spark, folder):
    return counts.popularity(_labelled(spark, folder), CUTOFF)


def user_activity(spark, folder):
    rows = _impressions(spark, folder).withColumn("labels", labels_of())
    return counts.user_activity(rows, _history(spark, folder), CUTOFF)


def latest_source(spark, folder):
    return counts.latest_source(_impressions(spark, folder), CUTOFF)


def split_boundaries(spark, folder):
    b = splits.boundaries(_impressions(spark, folder))
    return spark.createDataFrame([(b.data_min, b.val_start, b.test_start, b.data_max)], "data_min timestamp_ntz, val_start timestamp_ntz, test_start timestamp_ntz, data_max timestamp_ntz")


def temporal_split(spark, folder):
    rows = _impressions(spark, folder)
    return splits.split_ranges(rows.withColumn("split", splits.split_name(splits.boundaries(rows))))


def history_tail(spark, folder):
    return _history(spark, folder, 5).select("user_id", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ",").alias("last_five"))


def _events(spark, folder) -> DataFrame:
    """Views of candidates with their labels, as events."""
    return _labelled(spark, folder).select("article_id", "ts", "label")


def _rolling(spark, folder) -> DataFrame:
    rows = _labelled(spark, folder)
    return counts.asof_counts(rows.select("article_id", "ts", "label"), rows, "article_id", "ts", HOURS, {"clicks_": "label", "views_": ""}, _hot_candidates(spark, folder))


def _hot_candidates(spark, folder) -> list:
    """Articles that hold a large share of all candidates, found on the raw lists."""
    return heavy_keys(in_log(table(spark, folder, "behaviors")).select(F.explode("article_ids_inview").alias("article_id")), "article_id")


def rolling_counts(spark, folder):
    rows = _rolling(spark, folder)
    return rows.select(*KEY, "pos", *[f"{m}_{w}" for m in ("clicks", "views") for w in HOURS])


def rolling_ctr(spark, folder):
    rows = _rolling(spark, folder)
    return rows.select(*KEY, "pos", counts.rate("clicks_all", "views_all").alias("ctr_all"), counts.rate("clicks_24h", "views_24h").alias("ctr_24h"))


def frozen_counts(spark, folder):
    per = _labelled(spark, folder).groupBy("article_id").agg(F.sum("label").alias("clicks"), F.count("*").alias("views"))
    return per.select("article_id", "clicks", "views", counts.rate("clicks", "views").alias("ctr"))


def category_affinity(spark, folder):
    pairs = _impressions(spark, folder).where("user_id <> 0").select("user_id", F.explode("candidates").alias("article_id"))
    got = ranker.category_affinity(pairs, _history(spark, folder), _categories(spark, folder), "user_id")
    return got.select("user_id", "article_id", "cat_affinity")


def article_age(spark, folder):
    rows = _labelled(spark, folder).join(publish_times(table(spark, folder, "articles")), "article_id", "left")
    return rows.select(*KEY, "pos", ranker.article_age().alias("age_hours"))


def zero_fraction(spark, folder):
    rows = _slates(spark, folder)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("bm25", "semantic", "pop_total")]))
    return rows.select(each.alias("x")).groupBy("x.feature").agg(F.avg((F.col("x.v") == 0).cast("double")).alias("zero_fraction"))


# --- text -------------------------------------------------------------------------------------------------------


def token_counts(spark, folder):
    words = _texts(spark, folder).select("article_id", _tokens().alias("w"))
    return words.select("article_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


def index_stats(spark, folder):
    return lexical.index_stats(_index(spark, folder))


def idf_lucene(spark, folder):
    return lexical.idf(_index(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


def idf_okapi(spark, folder):
    return lexical.idf(_index(spark, folder), "okapi").select("term", "df", F.round("idf", 6).alias("idf"))


def _terms_of(spark, folder, histories: DataFrame, n_recent: int) -> DataFrame:
    return lexical.query_terms(histories, _texts(spark, folder), "user_id", _tokens(), n_recent)


def bm25_search(spark, folder):
    index = _index(spark, folder)
    terms = _terms_of(spark, folder, _twentieth(_history(spark, folder), "user_id"), 5)
    top = lexical.search(terms, lexical.impacts(index), "user_id", 50, index.n)
    return top.select("user_id", F.col("id").alias("article_id"), F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


def bm25_slate_scores(spark, folder):
    index = _index(spark, folder)
    pairs = _impressions(spark, folder).where("user_id <> 0").select("user_id", F.explode("candidates").alias("article_id"))
    terms = _terms_of(spark, folder, _history(spark, folder), 5)
    return lexical.slate_scores(pairs, terms, lexical.impacts(index), "user_id", n_docs=index.n).select("user_id", "article_id", F.round("score", 5).alias("score"))


def recall_ablation(spark, folder):
    """Recall of readers' later clicks by searches with their last 1, 5 and 20 articles, all in one pass over the index."""
    index = _index(spark, folder)
    return _recall(spark, folder, index, _reader_clicks(spark, folder))


def recall_by_impression(spark, folder):
    """As recall_ablation, but every impression with a click is a case of its own: its own clicks against its reader's search."""
    index = _index(spark, folder)
    rows = _impressions(spark, folder).where("user_id <> 0 AND user_id % 20 = 0").select(*KEY, F.explode(F.array_intersect("clicked", "candidates")).alias("id")).where("id IS NOT NULL")
    return _recall(spark, folder, index, rows.select("user_id", F.struct(*KEY).alias("case"), "id"))


def _reader_clicks(spark, folder) -> DataFrame:
    rows = _twentieth(clicks(table(spark, folder, "behaviors")).where("user_id <> 0"), "user_id")
    return rows.select("user_id", F.col("user_id").alias("case"), F.col("article_id").alias("id"))


def _recall(spark, folder, index: lexical.Index, relevant: DataFrame) -> DataFrame:
    asked = _twentieth(_history(spark, folder), "user_id")
    kinds = [_terms_of(spark, folder, asked, n).withColumn("query", F.struct("user_id", F.lit(n).alias("n"))) for n in N_RECENT]
    terms = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    named = terms.withColumn("query", F.concat_ws("/", "query.user_id", "query.n"))
    found = cut_lineage(lexical.search(named, lexical.impacts(index), "query", max(lexical.RECALL_AT), index.n))
    out = None
    for n in N_RECENT:
        mine = found.where(F.col("query").endswith(f"/{n}")).select(F.substring_index("query", "/", 1).cast("long").alias("user_id"), "id", "place")
        got = lexical.recall_at(mine, relevant, "user_id", case="case").select(F.lit(n).alias("n_recent"), "*")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("recall", F.round("recall", 6))


# --- rankings and metrics ---------------------------------------------------------------------------------------


def ranks_from_scores(spark, folder):
    return _slates(spark, folder).select("impression_id", "pos", ranking.rank(SLATE, "bm25").cast("long").alias("rank"))


def slate_top_k(spark, folder):
    return ranking.top_k(_slates(spark, folder), SLATE, "bm25", 10).select("impression_id", "pos", "article_id", F.col("place").cast("long").alias("place"))


def rrf(spark, folder):
    rows = ranking.reciprocal_rank_fusion(_slates(spark, folder), SLATE, ["bm25", "semantic", "pop_total"])
    return rows.select("impression_id", "pos", F.round("rrf", 9).alias("rrf"))


def weighted_sum(spark, folder):
    rows = ranking.weighted_sum(_slates(spark, folder), SLATE, ["bm25", "pop_total"], [0.7, 0.3])
    return rows.select("impression_id", "pos", F.round("fused", 8).alias("fused"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def slate_metrics(spark, folder):
    return _rounded(ranking.slate_metrics(_slates(spark, folder), SLATE, "bm25"))


def _models(spark, folder) -> DataFrame:
    """Metrics of every slate under every ranker, in long form over rankers."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("bm25", "semantic", "pop_total")]))
    rows = _slates(spark, folder).select("impression_id", "pos", "label", each.alias("m")).select("impression_id", "pos", "label", "m.*")
    return ranking.slate_metrics(rows, ("model", "impression_id"), "score")


def metric_means(spark, folder):
    return _rounded(ranking.metric_means(_models(spark, folder), ["model"]))


def metric_by_slice(spark, folder):
    rows = _slates(spark, folder)
    head = ranking.head_items(click_counts(spark, folder)).withColumn("h", F.lit(1))
    touched = rows.where("label = 1").join(head, "article_id").select("impression_id").distinct().withColumn("in_head", F.lit(True))
    users = clicks(table(spark, folder, "behaviors")).where("impression_id <> 0").groupBy("impression_id").agg(F.min("user_id").alias("user_id"))
    lengths = _history(spark, folder).select("user_id", F.size("article_ids").alias("history_len"))
    clicked = rows.groupBy("impression_id").agg(F.max("label").alias("any")).where("any = 1").select("impression_id")
    info = clicked.join(users, "impression_id", "left").join(lengths, "user_id", "left").join(touched, "impression_id", "left")
    info = info.select("impression_id", F.explode(ranking.slices(F.coalesce("history_len", F.lit(0)), F.coalesce("in_head", F.lit(False)))).alias("slice"))
    per = ranking.slate_metrics(rows, SLATE, "bm25")
    return _rounded(ranking.metric_means(per.join(info, "impression_id"), ["slice"]))


def leaky_probe(spark, folder):
    """Mean AUC with and without a column that only exists after the click."""
    later = table(spark, folder, "behaviors").where("impression_id <> 0").groupBy("impression_id").agg(F.max(F.coalesce("next_read_time", F.lit(0.0)) + F.coalesce("next_scroll_percentage", F.lit(0.0))).cast("double").alias("later"))
    rows = _slates(spark, folder).join(later, "impression_id", "left")
    rows = rows.withColumn("leaky", F.col("bm25") + F.when(F.col("label") == 1, F.coalesce("later", F.lit(0.0))).otherwise(0.0))
    each = [ranking.metric_means(ranking.slate_metrics(rows, SLATE, c)).select(F.lit(name).alias("score"), F.round("auc", 6).alias("auc"), "n_auc_defined") for c, name in (("bm25", "honest"), ("leaky", "leaky"))]
    return each[0].unionByName(each[1])


def bootstrap_ci(spark, folder):
    """95 % interval of the mean AUC and nDCG@10 of every ranker, by NumPy's generator, held against the normal one."""
    per = _models(spark, folder)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "ndcg10")]))
    rows = cut_lineage(per.select("model", "impression_id", each.alias("x")).select("model", "impression_id", "x.*"))
    return _against_normal(bootstrap.exact_intervals(rows, ["model", "metric"], order=["impression_id"]), rows, ["model", "metric"])


def poisson_ci(spark, folder):
    """As bootstrap_ci, by distributed Poisson resampling."""
    rows = cut_lineage(_models(spark, folder).select("model", "impression_id", F.col("auc").alias("value")))
    return _against_normal(bootstrap.poisson_intervals(rows, ["model"], ["impression_id"]), rows, ["model"])


def _against_normal(intervals: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and number of values, whether the interval holds the mean, and whether its width is within 15 % of 2 * 1.96 standard errors."""
    error = rows.groupBy(*by).agg((F.stddev("value") / F.sqrt(F.count("value"))).alias("error"))
    both = intervals.join(error, by)
    width = (F.col("hi") - F.col("lo")) / (2 * 1.96 * F.col("error"))
    return both.select(*by, F.round("mean", 6).alias("mean"), "n", F.col("mean").between(F.col("lo"), F.col("hi")).alias("brackets"), width.between(0.85, 1.15).alias("width_fits"))


def model_comparison(spark, folder):
    """Of every two rankers by AUC, whether one's 95 % interval lies above the other's, as its standard errors say too."""
    rows = cut_lineage(_models(spark, folder).select("model", "impression_id", F.col("auc").alias("value")))
    return bootstrap.compared(bootstrap.exact_intervals(rows, ["model"], order=["impression_id"]), "model").select("a", "b", F.coalesce("winner", F.lit("none")).alias("winner"))


# --- beyond accuracy --------------------------------------------------------------------------------------------


def _lists(spark, folder) -> DataFrame:
    return ranking.top_k(_slates(spark, folder), SLATE, "bm25", 10)


def diversity(spark, folder):
    named = _lists(spark, folder).join(_categories(spark, folder), "article_id", "left")
    return _rounded(beyond_accuracy.diversity(named, SLATE))


def novelty(spark, folder):
    items = beyond_accuracy.novelty(_lists(spark, folder), click_counts(spark, folder))
    return items.groupBy("impression_id").agg(F.round(F.avg("novelty"), 6).alias("novelty"))


def coverage_gini(spark, folder):
    size = _texts(spark, folder).count()
    return _rounded(beyond_accuracy.coverage_and_gini(_lists(spark, folder), size))


def candidate_coverage(spark, folder):
    return _rounded(beyond_accuracy.candidate_coverage(_labelled(spark, folder), article_popularity(spark, folder)))


# --- vectors ----------------------------------------------------------------------------------------------------


def l2_norms(spark, folder):
    rows = table(spark, folder, "document_vector").where(F.col("article_id").isNotNull() & usable(F.col("document_vector"), DIM)).dropDuplicates(["article_id"])
    return rows.select("article_id", F.round(norm(F.col("document_vector")), 5).alias("norm"))


def _pooled_all(spark, folder, tau: float | None) -> DataFrame:
    """Readers' vectors, with figures that hang on every component."""
    got = vectors.pooled(_history(spark, folder), _packed(spark, folder), "user_id", DIM, tau, _most_units(spark, folder))
    waves = [F.array(*[F.lit(math.cos(i * w)) for i in range(DIM)]) for w in PROBES]
    return got.select("user_id", "n", *[F.round(dot(F.col("v"), a), 6).alias(f"probe{i}") for i, a in enumerate(waves)], *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 150, 299)])


def user_vector_mean(spark, folder):
    return _pooled_all(spark, folder, None)


def user_vector_recency(spark, folder):
    return _pooled_all(spark, folder, vectors.TAU)


def ann_flat(spark, folder):
    units = _packed(spark, folder)
    asked = _twentieth(units, "id").select(F.col("id").alias("query"), "v")
    got = vectors.flat_search(asked, units, DIM, 10, n_units=_most_units(spark, folder))
    return got.select("query", F.col("id").alias("article_id"), F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


def ann_ivf(spark, folder):
    """How many of the exact ten nearest the inverted lists find, over the stated queries, and whether that is nine tenths."""
    units, n = _packed(spark, folder), _most_units(spark, folder)
    lists, centres = vectors.ivf_lists(units, n_units=n)
    asked = _twentieth(units, "id").select(F.col("id").alias("query"), "v")
    near = vectors.ivf_search(asked, lists, centres, 10).select("query", "id", F.lit(1).alias("found"))
    exact = vectors.flat_search(asked, units, DIM, 10, n_units=n).join(near, ["query", "id"], "left")
    return exact.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))


def embedding_coverage(spark, folder):
    """How many of the articles have a usable vector."""
    return vectors.covered(_units(spark, folder), _texts(spark, folder))[1]


def slate_cosine(spark, folder):
    slates = _impressions(spark, folder).where("user_id <> 0").select("user_id", "candidates")
    return vectors.history_cosine(slates, _history(spark, folder), _packed(spark, folder), "user_id", DIM).select("user_id", "article_id", F.round("cosine", 5).alias("cosine"))


def latent_vectors(spark, folder):
    got, explained = vectors.latent_vectors(_texts(spark, folder).withColumn("body", join_fields("title", "abstract")), "article_id", F.col("body"))
    return got.select("id", "v", F.lit(explained).alias("explained"))


# --- learned ranker ---------------------------------------------------------------------------------------------


def features(spark, folder, before: str | None = None, frozen: bool = False, vectors_for: str = "scores"):
    """Feature rows of the scored slates, in the wide form the ranker is fitted on.

    Counts come from events strictly before a slate's time, and before ``before`` if given. ``frozen`` counts are those
    of the end of the log for every slate; their windows of a day and an hour are empty then. ``vectors_for`` tells
    whether semantic is the scores' own column ("scores") or the cosine of the reader's pooled vector ("pooled").
    """
    slates = _slates(spark, folder)
    users = _impressions(spark, folder).where("impression_id <> 0").groupBy("impression_id").agg(F.min("user_id").alias("user_id"), F.min("ts").alias("ts"))
    rows = slates.join(users, "impression_id").drop("pop_total")
    events = _events(spark, folder)
    events = events if before is None else counts.before(events, before)
    if frozen:
        whole = events.groupBy("article_id").agg(F.sum("label").alias("c_all"), F.count("*").alias("v_all"))
        zero = F.lit(0).cast("long")
        rows = rows.join(whole, "article_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("c_all", "v_all")} | {c: zero for c in ("c_24h", "c_1h", "v_24h", "v_1h")})
    else:
        rows = counts.asof_counts(events, rows, "article_id", "ts", HOURS, {"c_": "label", "v_": ""}, _hot_candidates(spark, folder))
    rows = rows.withColumns({
        "pop_total": F.col("c_all"), "pop_24h": F.col("c_24h"), "pop_1h": F.col("c_1h"),
        "ctr_total": counts.rate("c_all", "v_all"), "ctr_24h": counts.rate("c_24h", "v_24h"),
    }).drop("c_all", "c_24h", "c_1h", "v_all", "v_24h", "v_1h")
    history = _history(spark, folder)
    sizes = slates.groupBy("impression_id").agg(F.count("*").alias("slate_size"))
    affinity = ranker.category_affinity(rows.where("user_id IS NOT NULL"), history, _categories(spark, folder), "user_id")
    lengths = history.select("user_id", F.size("article_ids").alias("history_len"))
    rows = rows.join(sizes, "impression_id").join(affinity, ["user_id", "article_id"], "left").join(lengths, "user_id", "left")
    rows = rows.join(publish_times(table(spark, folder, "articles")), "article_id", "left").withColumn("age_hours", ranker.article_age())
    clean = {c: F.coalesce(c, F.lit(0)) for c in ("history_len", "cat_affinity")}
    names = list(dict.fromkeys((*ranker.WITH_CATEGORY, *ranker.WITH_AGE)))
    rows = rows.withColumns(clean).select("impression_id", "user_id", "ts", "pos", "article_id", "label", *names)
    return _with_pooled(spark, folder, rows) if vectors_for == "pooled" else rows


def _with_pooled(spark, folder, rows: DataFrame) -> DataFrame:
    """Feature rows with the cosine of the reader's pooled vector as semantic."""
    slates = rows.select("user_id", F.array("article_id").alias("candidates"))
    cosines = vectors.history_cosine(slates, _history(spark, folder), _packed(spark, folder), "user_id", DIM).withColumnRenamed("cosine", "semantic")
    met = rows.drop("semantic").join(cosines, ["user_id", "article_id"], "left")
    return met.withColumn("semantic", F.coalesce("semantic", F.lit(0.0))).select(*rows.columns)


def feature_rows(spark, folder):
    return features(spark, folder).withColumn("age_hours", F.round("age_hours", 6))


#: Counts end and fitting begins, evaluation begins, evaluation ends.
CUTS = ("2025-02-15 00:00:00", "2025-03-25 00:00:00", "2025-04-12 00:00:00")


def _fit_and_test(spark, folder, made: dict | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and to evaluate on. Calls that share ``made`` and differ in vectors_for alone make the other features once."""
    if made is None:
        rows = cut_lineage(features(spark, folder, **how))
    else:
        pooled = how.pop("vectors_for") == "pooled"
        if "rows" not in made:
            made["rows"] = cut_lineage(features(spark, folder, **how))
        rows = cut_lineage(_with_pooled(spark, folder, made["rows"])) if pooled else made["rows"]
    parts = ranker.three_cutoffs(rows, "ts", *CUTS)
    return parts["fit"], parts["eval"]


def gbt_scores(spark, folder):
    """Every candidate of the later slates, and whether the trees fitted on the earlier ones give it a probability."""
    train, test = _fit_and_test(spark, folder)
    scored = ranker.score(ranker.fit(train, ranker.SKEW_RESISTANT), test, ranker.SKEW_RESISTANT)
    return scored.select("impression_id", "pos", "label", ((F.col("gbt") > 0) & (F.col("gbt") < 1)).alias("is_probability"))


def importance(spark, folder):
    """Every feature, and whether the loss of AUC when it is shuffled lies where losses can lie."""
    train, test = _fit_and_test(spark, folder)
    got = ranker.permutation_importance(ranker.fit(train, ranker.SKEW_RESISTANT), test, ranker.SKEW_RESISTANT)
    return got.select("feature", F.col("importance").between(-0.2, 0.7).alias("in_bounds"))


def _checked(compared: DataFrame) -> DataFrame:
    """Variants with both denominators, and whether their metrics are no worse than an order by chance would leave them."""
    fair = (F.col("auc") > 0.45) & (F.col("auc") <= 1) & F.col("ndcg10").between(F.col("ndcg5") - 1e-9, 1.0) & (F.col("mrr_first") >= F.col("mrr") - 1e-9)
    return compared.select("variant", "n_impressions", "n_auc_defined", fair.alias("fair"))


def feature_ablation(spark, folder):
    """The ranker with and without the size of the slate."""
    train, test = _fit_and_test(spark, folder)
    sets = {"with slate_size": ranker.SKEW_RESISTANT, "without slate_size": [f for f in ranker.SKEW_RESISTANT if f != "slate_size"]}
    return _checked(ranker.compare_features({name: (train, test, f) for name, f in sets.items()}, SLATE))


def count_ablation(spark, folder):
    """Both full feature sets, each with counts as of the slate and with those frozen at the end of the log."""
    kinds = {"rolling": _fit_and_test(spark, folder), "frozen": _fit_and_test(spark, folder, frozen=True)}
    sets = {"category": ranker.WITH_CATEGORY, "age": ranker.WITH_AGE}
    return _checked(ranker.compare_features({f"{k} {n}": (*kinds[k], f) for k in kinds for n, f in sets.items()}, SLATE))


def gap_aware(spark, folder):
    """Counts end before fitting begins: two feature sets, each with two representations of meaning."""
    made: dict = {}
    kinds = {v: _fit_and_test(spark, folder, made, before=CUTS[0], vectors_for=v) for v in ("scores", "pooled")}
    sets = {"category": ranker.WITH_CATEGORY, "skew resistant": ranker.SKEW_RESISTANT}
    return _checked(ranker.compare_features({f"{k} {n}": (*kinds[k], f) for k in kinds for n, f in sets.items()}, SLATE))


# --- submissions ------------------------------------------------------------------------------------------------


def submission_lines(spark, folder):
    ranks = submission.slate_ranks(_slates(spark, folder), SLATE, "bm25")
    return ranks.select("impression_id", submission.line().alias("line"))


def submission_check(spark, folder):
    lines = submission_lines(spark, folder).select(F.col("line").alias("value"))
    expected = _slates(spark, folder).groupBy("impression_id").agg(F.count("*").alias("n_candidates"))
    return submission.validate(lines, expected)


def submission_faults(spark, folder):
    """As submission_check on lines that were spoiled by rule: each id's remainder by 17 says how."""
    kind = F.col("impression_id") % 17
    line = F.col("line")
    spoiled = (
        F.when(kind == 1, F.regexp_replace(line, ",", ", ")).when(kind == 2, F.regexp_replace(line, r"\[1,", "[2,")).when(kind == 3, F.regexp_replace(line, r"\]$", ""))
        .when(kind == 5, F.regexp_replace(line, r"\[.*", "[1]")).when(kind == 6, F.concat(F.lit("9"), line)).otherwise(line)
    )
    times = F.when(kind == 4, F.lit(0)).when(kind == 7, F.lit(2)).otherwise(F.lit(1))
    rows = submission_lines(spark, folder).select(spoiled.alias("value"), F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("i"), times.alias("times")).where("times > 0")
    expected = _slates(spark, folder).groupBy("impression_id").agg(F.count("*").alias("n_candidates"))
    return submission.validate(rows, expected)


def users_remaining(spark, folder):
    """Readers with impressions from the cutoff on."""
    return counts.users_remaining(_impressions(spark, folder), CUTOFF)


def manifest(spark, folder):
    """The manifest of a feature build as one row."""
    rows = _impressions(spark, folder)
    borders = splits.boundaries(rows)
    built = sinks.manifest(rows, borders, CUTOFF, 0)
    n = built["counts"]
    row = (built["seed"], borders.data_min, borders.val_start, borders.test_start, borders.data_max, built["cutoff"], n["impressions"], n["train"], n["val"], n["test"])
    return spark.createDataFrame([row], "seed int, data_min timestamp_ntz, val_start timestamp_ntz, test_start timestamp_ntz, data_max timestamp_ntz, cutoff string, impressions bigint, train bigint, val bigint, test bigint")


def latent_check(spark, folder):
    """Components and length of every article's latent vector, and whether the share of variance they explain is one."""
    rows = latent_vectors(spark, folder)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(F.col("id").alias("article_id"), F.size("v").cast("long").alias("components"), F.round(size, 6).alias("length"), F.col("explained").between(0.05, 1.0 + 1e-9).alias("explained_fits"))


QUERIES = {
    f.__name__: f
    for f in (
        click_counts, listed_counts, article_popularity, user_activity, latest_source, split_boundaries, temporal_split, history_tail, rolling_counts,
        rolling_ctr, frozen_counts, category_affinity, article_age, zero_fraction, token_counts, index_stats, idf_lucene, idf_okapi, bm25_search,
        bm25_slate_scores, recall_ablation, recall_by_impression, ranks_from_scores, slate_top_k, rrf, weighted_sum, slate_metrics, metric_means, metric_by_slice, leaky_probe,
        bootstrap_ci, poisson_ci, model_comparison, diversity, novelty, coverage_gini, candidate_coverage, l2_norms, user_vector_mean, user_vector_recency, ann_flat, ann_ivf, embedding_coverage,
        slate_cosine, latent_vectors, feature_rows, gbt_scores, importance, feature_ablation, count_ablation, gap_aware, submission_lines, submission_check, submission_faults,
        users_remaining, manifest, latent_check,
    )
}

# --- SQL --------------------------------------------------------------------------------------------------------

_IMP = f"""{_LOG},
imp AS (SELECT impression_id, user_id, impression_time AS ts, iv, coalesce(cl, []) AS cl FROM log WHERE len(iv) > 0),
cand AS (SELECT impression_id, user_id, ts, cl, unnest(iv) AS article_id, unnest(range(len(iv))) AS pos FROM imp),
lab AS (SELECT impression_id, user_id, ts, CAST(pos AS INT) AS pos, article_id, CAST(list_contains(cl, article_id) AS INT) AS label FROM cand)"""
_HIST = "hist AS (SELECT DISTINCT user_id, coalesce(list_transform(list_sort(list_zip(impression_time_fixed, article_id_fixed)), lambda x: x[2]), []) AS ids FROM history WHERE user_id IS NOT NULL)"
_CUT = f"TIMESTAMP '{CUTOFF}'"
_COUNTS = "counts AS (SELECT article_id, count(*) AS click_count FROM lab WHERE label = 1 AND article_id IS NOT NULL GROUP BY 1)"
_CATS = "cats AS (SELECT article_id, min(lower(trim(category_str))) AS category FROM articles WHERE article_id IS NOT NULL AND trim(category_str) <> '' GROUP BY 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS["da"]) + "]"
_WORDS = rf"""txt AS (SELECT article_id AS id, min({{'title': title, 'abstract': abstract}}) AS t FROM articles WHERE article_id IS NOT NULL GROUP BY 1),
words AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(t.title, '')) || ' ' || lower(coalesce(t.abstract, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM txt),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) GROUP BY 1, 2),
dls AS (SELECT id, len(w) AS dl FROM words),
coll AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM dls),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
luc AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs, coll),
imp_w AS (SELECT term, id, idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS impact FROM post JOIN dls USING (id) JOIN luc USING (term), coll)"""


def _query_terms(n: int) -> str:
    return f"""qart_{n} AS (SELECT user_id, unnest(ids[-{n}:]) AS id FROM hist),
qterm_{n} AS (SELECT user_id, term, count(*) AS q FROM (SELECT user_id, unnest(w) AS term FROM qart_{n} JOIN words USING (id)) GROUP BY 1, 2)"""


def _hits(n: int, k: int) -> str:
    return f"""{_query_terms(n)},
hits_{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS place FROM
  (SELECT user_id, id, sum(impact * q) AS score FROM qterm_{n} JOIN imp_w USING (term) WHERE user_id % 20 = 0 GROUP BY 1, 2)) WHERE place <= {k})"""


def _recall_sql(log: str, relevant: str) -> str:
    each = [
        f"""SELECT {n} AS n_recent, {k} AS k, count(place) FILTER (WHERE place <= {k}) AS hits, count(*) FILTER (WHERE u.user_id IS NOT NULL) AS relevant, count(DISTINCT c) FILTER (WHERE u.user_id IS NOT NULL) AS scored,
  count(DISTINCT c) FILTER (WHERE u.user_id IS NULL) AS skipped, round(count(place) FILTER (WHERE place <= {k})::DOUBLE / nullif(count(*) FILTER (WHERE u.user_id IS NOT NULL), 0), 6) AS recall
FROM rel LEFT JOIN (SELECT DISTINCT user_id FROM hits_{n}) u USING (user_id) LEFT JOIN hits_{n} h ON h.user_id = rel.user_id AND h.id = rel.id"""
        for n in N_RECENT
        for k in lexical.RECALL_AT
    ]
    return f"WITH {log}, {_WORDS}, {_HIST}, {', '.join(_hits(n, 200) for n in N_RECENT)}, rel AS ({relevant})\n" + " UNION ALL ".join(each)


_SLATES = f"""{_LOG}, hit AS (SELECT DISTINCT impression_id, article_id, 1 AS label FROM click WHERE impression_id <> 0),
raw AS (SELECT DISTINCT * FROM candidate_scores WHERE impression_id IS NOT NULL AND pos IS NOT NULL),
slate AS (SELECT impression_id, pos, article_id, coalesce(CASE WHEN NOT isnan(bm25) THEN bm25 END, 0) AS bm25, coalesce(CASE WHEN NOT isnan(semantic) THEN semantic END, 0) AS semantic,
  greatest(coalesce(pop_total, 0), 0)::DOUBLE AS pop_total, coalesce(label, 0) AS label FROM raw LEFT JOIN hit USING (impression_id, article_id))"""


def _metrics(rows: str, key: str) -> str:
    """Per-slate metrics of rows (key, pos, label, score)."""
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, pos) AS rk, row_number() OVER (PARTITION BY {key} ORDER BY label DESC, pos) AS best FROM {rows}),
pairs AS (SELECT {", ".join(f"p.{k}" for k in key.split(", "))}, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS auc
  FROM {rows} p JOIN {rows} n ON {" AND ".join(f"p.{k} = n.{k}" for k in key.split(", "))} AND p.label = 1 AND n.label = 0 GROUP BY ALL),
base AS (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE label > 0) AS n_positive, CASE WHEN sum(label) > 0 THEN sum(label / rk) / sum(label) ELSE 0 END AS mrr, coalesce(1.0 / min(rk) FILTER (WHERE label > 0), 0)::DOUBLE AS mrr_first,
  {", ".join(f"CASE WHEN sum(label) > 0 THEN sum(CASE WHEN rk <= {k} THEN (pow(2, label) - 1) / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN best <= {k} THEN (pow(2, label) - 1) / log2(best + 1) ELSE 0 END) ELSE 0 END AS ndcg{k}" for k in (5, 10))}
  FROM placed GROUP BY {key}),
metrics AS (SELECT * FROM base LEFT JOIN pairs USING ({key}))"""


_MEANS = "count(*) AS n_impressions, count(auc) AS n_auc_defined, round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(mrr_first), 6) AS mrr_first, round(avg(ndcg5), 6) AS ndcg5, round(avg(ndcg10), 6) AS ndcg10"
_LIST = "lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY bm25 DESC, pos) AS place FROM slate) WHERE place <= 10)"
_UNITS = """good AS (SELECT DISTINCT article_id AS id, CAST(document_vector AS DOUBLE[]) AS raw FROM document_vector WHERE article_id IS NOT NULL AND len(document_vector) = 300
  AND len(list_filter(document_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(document_vector, lambda x: x <> 0)) > 0),
lengths AS (SELECT id, raw, sqrt(list_dot_product(raw, raw)) AS len FROM good),
unit AS (SELECT id, list_transform(raw, lambda x: x / len) AS v FROM lengths)"""


def _pooled(weight: str) -> str:
    return f"""read AS (SELECT user_id, id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY p) AS age FROM
  (SELECT user_id, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM hist) SEMI JOIN unit USING (id)),
comp AS (SELECT user_id, d, sum({weight} * x) AS s, count(*) AS n FROM (SELECT user_id, age, unnest(v) AS x, unnest(range(300)) AS d FROM read JOIN unit USING (id)) GROUP BY 1, 2),
reader AS (SELECT user_id, any_value(n) AS n, list(s ORDER BY d) AS s, sqrt(sum(s * s)) AS size FROM comp GROUP BY 1)"""


_PROBED = (
    "SELECT user_id, n, "
    + ", ".join(f"round(list_dot_product(s, list_transform(range(300), lambda i: cos(i * {w}::DOUBLE))) / CASE WHEN size = 0 THEN 1 ELSE size END, 6) AS probe{i}" for i, w in enumerate(PROBES))
    + ", "
    + ", ".join(f"round(s[{i + 1}] / CASE WHEN size = 0 THEN 1 ELSE size END, 6) AS v{i}" for i in (0, 150, 299))
    + " FROM reader"
)


def _asof(measure: str, frame: str) -> str:
    return f"(sum({measure}) OVER (PARTITION BY article_id ORDER BY ts RANGE BETWEEN {frame} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"


_FRAMES = {"all": "UNBOUNDED", "24h": "INTERVAL 24 HOURS", "1h": "INTERVAL 1 HOUR"}
_ROLLED = "rolled AS (SELECT *, " + ", ".join(f"CAST(coalesce({_asof(x, f)}, 0) AS BIGINT) AS {m}_{w}" for m, x in (("clicks", "label"), ("views", "1")) for w, f in _FRAMES.items()) + " FROM lab WHERE article_id IS NOT NULL)"
_READERS = "asked AS (SELECT DISTINCT user_id, article_id FROM cand WHERE user_id <> 0)"

_INTERVALS = (
    f"WITH {_SLATES}, sc AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model, impression_id, pos, label, {m} AS score FROM slate" for m in ("bm25", "semantic", "pop_total"))
    + f"), {_metrics('sc', 'model, impression_id')}"
).replace("{", "{{").replace("}", "}}") + " SELECT {keys}, round(avg(value), 6) AS mean, count(value) AS n, true AS brackets, true AS width_fits FROM ({rows}) WHERE value IS NOT NULL GROUP BY {keys}"
_EVALUATED = f"""{_IMP}, {_SLATES.removeprefix(_LOG + ",").strip()}, who AS (SELECT impression_id, min(ts) AS ts FROM imp WHERE impression_id <> 0 GROUP BY 1),
later AS (SELECT impression_id, pos, label FROM slate JOIN who USING (impression_id) WHERE ts >= TIMESTAMP '{CUTS[1]}' AND ts < TIMESTAMP '{CUTS[2]}')"""


def _variants(names) -> str:
    each = ", ".join(f"'{n}'" for n in names)
    return f"""WITH {_EVALUATED}, g AS (SELECT impression_id, min(label) < max(label) AS mixed FROM later GROUP BY 1)
SELECT variant, count(*) AS n_impressions, count(*) FILTER (WHERE mixed) AS n_auc_defined, true AS fair FROM g, (SELECT unnest([{each}]) AS variant) GROUP BY 1"""


SQL = {
    "click_counts": f"WITH {_IMP}, {_COUNTS} SELECT * FROM counts",
    "listed_counts": f"WITH {_IMP} SELECT article_id, count(*) AS click_count FROM (SELECT unnest(cl) AS article_id FROM imp) WHERE article_id IS NOT NULL GROUP BY 1",
    "article_popularity": f"WITH {_IMP} SELECT article_id, count(*) AS click_count, {_CUT} AS cutoff FROM lab WHERE label = 1 AND article_id IS NOT NULL AND ts < {_CUT} GROUP BY 1",
    "user_activity": f"""WITH {_IMP}, {_HIST}, per AS (SELECT user_id, count(DISTINCT (impression_id, ts)) AS n_impressions, sum(label)::BIGINT AS n_clicks, max(ts) AS last_seen FROM lab WHERE ts < {_CUT} GROUP BY 1)
SELECT per.*, coalesce(len(ids), 0)::INT AS history_len, {_CUT} AS cutoff FROM per LEFT JOIN hist USING (user_id)""",
    "latest_source": f"WITH {_IMP} SELECT max(ts) AS latest FROM imp WHERE ts < {_CUT}",
    "split_boundaries": f"WITH {_IMP} SELECT min(ts) AS data_min, date_trunc('day', max(ts))::TIMESTAMP - INTERVAL 1 DAY AS val_start, date_trunc('day', max(ts))::TIMESTAMP AS test_start, max(ts) AS data_max FROM imp",
    "temporal_split": f"""WITH {_IMP}, e AS (SELECT date_trunc('day', max(ts))::TIMESTAMP AS t FROM imp)
SELECT CASE WHEN ts < t - INTERVAL 1 DAY THEN 'train' WHEN ts < t THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM imp, e GROUP BY 1""",
    "history_tail": f"WITH {_HIST} SELECT user_id, array_to_string(ids[-5:], ',') AS last_five FROM hist",
    "rolling_counts": f"WITH {_IMP}, {_ROLLED} SELECT impression_id, user_id, ts, pos, {', '.join(f'{m}_{w}' for m in ('clicks', 'views') for w in HOURS)} FROM rolled",
    "rolling_ctr": f"""WITH {_IMP}, {_ROLLED} SELECT impression_id, user_id, ts, pos, CASE WHEN views_all = 0 THEN 0 ELSE clicks_all / (views_all + 10.0::DOUBLE) END AS ctr_all,
  CASE WHEN views_24h = 0 THEN 0 ELSE clicks_24h / (views_24h + 10.0::DOUBLE) END AS ctr_24h FROM rolled""",
    "frozen_counts": f"WITH {_IMP} SELECT article_id, sum(label)::BIGINT AS clicks, count(*) AS views, sum(label) / (count(*) + 10.0::DOUBLE) AS ctr FROM lab GROUP BY 1",
    "category_affinity": f"""WITH {_IMP}, {_HIST}, {_CATS}, {_READERS},
read AS (SELECT user_id, category, count(*) AS c FROM (SELECT user_id, unnest(ids) AS article_id FROM hist) JOIN cats USING (article_id) GROUP BY 1, 2),
tot AS (SELECT user_id, sum(c) AS n FROM read GROUP BY 1)
SELECT a.user_id, a.article_id, coalesce(c::DOUBLE / n, 0) AS cat_affinity FROM asked a LEFT JOIN cats USING (article_id)
  LEFT JOIN read ON read.user_id = a.user_id AND read.category = cats.category LEFT JOIN tot ON tot.user_id = a.user_id""",
    "article_age": f"""WITH {_IMP}, pub AS (SELECT article_id, min(published_time) AS p FROM articles WHERE article_id IS NOT NULL GROUP BY 1)
SELECT impression_id, user_id, ts, pos, coalesce((epoch_us(ts) - epoch_us(p)) / 3600000000.0::DOUBLE, -1) AS age_hours FROM lab LEFT JOIN pub USING (article_id)""",
    "zero_fraction": f"WITH {_SLATES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_fraction FROM slate" for c in ("bm25", "semantic", "pop_total")),
    "token_counts": f"WITH {_WORDS} SELECT id AS article_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM words",
    "index_stats": f"WITH {_WORDS} SELECT n::BIGINT AS documents, (SELECT count(*) FROM dfs) AS unique_terms, (SELECT count(*) FROM post) AS postings, round(avgdl, 2) AS avgdl FROM coll",
    "idf_lucene": f"WITH {_WORDS} SELECT term, df, round(idf, 6) AS idf FROM luc",
    "idf_okapi": f"""WITH {_WORDS}, o AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM dfs, coll), m AS (SELECT avg(r) AS m FROM o)
SELECT term, df, round(CASE WHEN r <= 0 THEN 0.25::DOUBLE * m ELSE r END, 6) AS idf FROM o, m""",
    "bm25_search": f"WITH {_WORDS}, {_HIST}, {_hits(5, 50)} SELECT user_id, id AS article_id, round(score, 5) AS score, place FROM hits_5",
    "bm25_slate_scores": f"""WITH {_IMP}, {_WORDS}, {_HIST}, {_query_terms(5)}, {_READERS}
SELECT a.user_id, a.article_id, round(coalesce(sum(impact * q), 0), 5) AS score FROM asked a LEFT JOIN (SELECT user_id, id, impact, q FROM qterm_5 JOIN imp_w USING (term)) s ON s.user_id = a.user_id AND s.id = a.article_id GROUP BY 1, 2""",
    "recall_ablation": _recall_sql(_LOG, "SELECT DISTINCT user_id, user_id AS c, article_id AS id FROM click WHERE user_id <> 0 AND user_id % 20 = 0"),
    "recall_by_impression": _recall_sql(_LOG, "SELECT DISTINCT user_id, {'i': impression_id, 't': impression_time} AS c, article_id AS id FROM click WHERE user_id <> 0 AND user_id % 20 = 0"),
    "ranks_from_scores": f"WITH {_SLATES} SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY bm25 DESC, pos) AS rank FROM slate",
    "slate_top_k": f"WITH {_SLATES}, {_LIST} SELECT impression_id, pos, article_id, place FROM lst",
    "rrf": f"WITH {_SLATES} SELECT impression_id, pos, round(" + " + ".join(f"1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY impression_id ORDER BY {s} DESC, pos))" for s in ("bm25", "semantic", "pop_total")) + ", 9) AS rrf FROM slate",
    "weighted_sum": f"WITH {_SLATES}, r AS (SELECT impression_id, min(bm25) AS b0, max(bm25) AS b1, min(pop_total) AS p0, max(pop_total) AS p1 FROM slate GROUP BY 1) "
    "SELECT impression_id, pos, round(CASE WHEN b1 > b0 THEN 0.7::DOUBLE * (bm25 - b0) / (b1 - b0) ELSE 0 END + CASE WHEN p1 > p0 THEN 0.3::DOUBLE * (pop_total - p0) / (p1 - p0) ELSE 0 END, 8) AS fused FROM slate JOIN r USING (impression_id)",
    "slate_metrics": f"WITH {_SLATES}, sc AS (SELECT impression_id, pos, label, bm25 AS score FROM slate), {_metrics('sc', 'impression_id')} SELECT impression_id, n, n_positive, round(auc, 6) AS auc, round(mrr, 6) AS mrr, round(mrr_first, 6) AS mrr_first, round(ndcg5, 6) AS ndcg5, round(ndcg10, 6) AS ndcg10 FROM metrics",
    "metric_means": f"WITH {_SLATES}, sc AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model, impression_id, pos, label, {m} AS score FROM slate" for m in ("bm25", "semantic", "pop_total"))
    + f"), {_metrics('sc', 'model, impression_id')} SELECT model, {_MEANS} FROM metrics GROUP BY 1",
    "metric_by_slice": f"""WITH {_SLATES}, sc AS (SELECT impression_id, pos, label, bm25 AS score FROM slate), {_metrics('sc', 'impression_id')}, {_HIST},
{_IMP.removeprefix(_LOG + ",").strip()}, {_COUNTS},
head AS (SELECT article_id FROM (SELECT article_id, row_number() OVER (ORDER BY click_count DESC, article_id) AS rn FROM counts) WHERE rn <= (SELECT greatest(1, count(*) // 5) FROM counts)),
who AS (SELECT impression_id, min(user_id) AS user_id FROM click WHERE impression_id <> 0 GROUP BY 1),
info AS (SELECT m.impression_id, coalesce(len(any_value(ids)), 0) AS hl, count(h.article_id) AS hd FROM metrics m LEFT JOIN who USING (impression_id) LEFT JOIN hist USING (user_id)
  LEFT JOIN slate s ON s.impression_id = m.impression_id AND s.label = 1 LEFT JOIN head h ON h.article_id = s.article_id WHERE m.n_positive > 0 GROUP BY 1),
sl AS (SELECT impression_id, unnest(['all', CASE WHEN hl <= 5 THEN 'cold_start' ELSE 'warm' END, CASE WHEN hd > 0 THEN 'head' ELSE 'tail' END]) AS slice FROM info)
SELECT slice, {_MEANS} FROM metrics JOIN sl USING (impression_id) GROUP BY 1""",
    "leaky_probe": f"""WITH {_SLATES}, later AS (SELECT impression_id, max(coalesce(next_read_time, 0::FLOAT) + coalesce(next_scroll_percentage, 0::FLOAT))::DOUBLE AS later FROM behaviors WHERE impression_id <> 0 GROUP BY 1),
two AS (SELECT 'honest' AS kind, impression_id, pos, label, bm25 AS score FROM slate UNION ALL SELECT 'leaky', impression_id, pos, label, bm25 + CASE WHEN label = 1 THEN coalesce(later, 0) ELSE 0 END FROM slate LEFT JOIN later USING (impression_id)),
{_metrics('two', 'kind, impression_id')} SELECT kind AS score, round(avg(auc), 6) AS auc, count(auc) AS n_auc_defined FROM metrics GROUP BY 1""",
    "diversity": f"""WITH {_SLATES}, {_LIST}, {_CATS}, nm AS (SELECT impression_id, place, coalesce(category, '?') AS c FROM lst LEFT JOIN cats USING (article_id))
SELECT a.impression_id, count(DISTINCT a.place) AS n, round(coalesce(avg(CASE WHEN a.c <> b.c THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE a.place <> b.place), 0), 6) AS diversity FROM nm a JOIN nm b USING (impression_id) GROUP BY 1""",
    "novelty": f"""WITH {_SLATES}, {_LIST}, {_IMP.removeprefix(_LOG + ",").strip()}, {_COUNTS}, t AS (SELECT sum(click_count)::DOUBLE AS t FROM counts)
SELECT impression_id, round(avg(-log2(coalesce(click_count, 1) / t)), 6) AS novelty FROM lst LEFT JOIN counts USING (article_id), t GROUP BY 1""",
    "coverage_gini": f"""WITH {_SLATES}, {_LIST}, x AS (SELECT article_id, count(*) AS v FROM lst WHERE article_id IS NOT NULL GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, sum(v) OVER () AS t FROM x)
SELECT any_value(n) AS n_items, round(any_value(n)::DOUBLE / (SELECT count(DISTINCT article_id) FROM articles), 6) AS coverage, round(2 * sum(i * v)::DOUBLE / (any_value(n) * any_value(t))::DOUBLE - (any_value(n) + 1)::DOUBLE / any_value(n), 6) AS gini FROM r""",
    "candidate_coverage": f"""WITH {_IMP}, known AS (SELECT DISTINCT article_id FROM lab WHERE label = 1 AND ts < {_CUT}), c AS (SELECT DISTINCT article_id FROM lab WHERE article_id IS NOT NULL)
SELECT count(*) AS n_candidates, count(k.article_id) AS n_known, round(count(k.article_id)::DOUBLE / count(*), 6) AS coverage FROM c LEFT JOIN known k USING (article_id)""",
    "l2_norms": f"WITH {_UNITS} SELECT id AS article_id, round(len, 5) AS norm FROM lengths",
    "user_vector_mean": f"WITH {_UNITS}, {_HIST}, {_pooled('1')} {_PROBED}",
    "user_vector_recency": f"WITH {_UNITS}, {_HIST}, {_pooled('exp(-age / 5.0::DOUBLE)')} {_PROBED}",
    "ann_ivf": f"WITH {_UNITS}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 20 = 0) AS q FROM unit) SELECT q AS n_queries, q * least(n, 10) AS n_neighbours, true AS recall_reached FROM n",
    "embedding_coverage": f"""WITH {_UNITS}, c AS (SELECT count(DISTINCT article_id) AS items, count(DISTINCT article_id) FILTER (WHERE article_id IN (SELECT id FROM unit)) AS with_vector FROM articles)
SELECT items, with_vector, with_vector::DOUBLE / items AS coverage FROM c""",
    "ann_flat": f"""WITH {_UNITS}, s AS (SELECT q.id AS query, u.id AS article_id, round(list_dot_product(q.v, u.v), 12) AS score FROM unit q, unit u WHERE q.id % 20 = 0)
SELECT query, article_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS place FROM s) WHERE place <= 10""",
    "slate_cosine": f"""WITH {_IMP}, {_UNITS}, {_HIST}, {_pooled('1')}, {_READERS}
SELECT a.user_id, a.article_id, round(coalesce(list_dot_product(v, s) / CASE WHEN size = 0 THEN 1 ELSE size END, 0), 5) AS cosine FROM asked a LEFT JOIN unit ON unit.id = a.article_id LEFT JOIN reader ON reader.user_id = a.user_id""",
    "submission_lines": f"""WITH {_SLATES}, r AS (SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY bm25 DESC, pos) AS rank FROM slate)
SELECT impression_id, impression_id || ' [' || string_agg(rank, ',' ORDER BY pos) || ']' AS line FROM r GROUP BY 1""",
    "submission_check": f"WITH {_SLATES} SELECT count(DISTINCT impression_id) AS lines, count(DISTINCT impression_id) AS impressions, 0::BIGINT AS duplicate_rows, 0::BIGINT AS bad_format, 0::BIGINT AS bad_ranks, 0::BIGINT AS bad_length, 0::BIGINT AS missing, 0::BIGINT AS extra, true AS ok FROM slate",
    "bootstrap_ci": _INTERVALS.format(keys="model, metric", rows="SELECT model, 'auc' AS metric, auc AS value FROM metrics UNION ALL SELECT model, 'ndcg10', ndcg10 FROM metrics"),
    "poisson_ci": _INTERVALS.format(keys="model", rows="SELECT model, auc AS value FROM metrics"),
    "model_comparison": _INTERVALS.format(keys="model", rows="SELECT model, auc AS value FROM metrics").replace("SELECT model, round(avg(value), 6) AS mean, count(value) AS n, true AS brackets, true AS width_fits", ", ci AS (SELECT model, avg(value) AS mean, 1.96 * stddev(value) / sqrt(count(value)) AS side")
    + """) SELECT a.model AS a, b.model AS b, CASE WHEN a.mean - a.side > b.mean + b.side THEN a.model WHEN b.mean - b.side > a.mean + a.side THEN b.model ELSE 'none' END AS winner FROM ci a JOIN ci b ON a.model < b.model""",
    "feature_rows": f"""WITH {_IMP}, {_HIST}, {_CATS}, {_SLATES.removeprefix(_LOG + ",").strip()},
who AS (SELECT impression_id, min(user_id) AS user_id, min(ts) AS ts FROM imp WHERE impression_id <> 0 GROUP BY 1),
pub AS (SELECT article_id, min(published_time) AS p FROM articles WHERE article_id IS NOT NULL GROUP BY 1),
base AS (SELECT impression_id, pos, article_id, bm25, semantic, label, user_id, ts, count(*) OVER (PARTITION BY impression_id) AS slate_size FROM slate JOIN who USING (impression_id)),
c AS (SELECT b.impression_id, b.pos, b.article_id, coalesce(sum(l.label), 0)::BIGINT AS pop_total, count(l.label) AS v_all, coalesce(sum(l.label) FILTER (WHERE l.ts >= b.ts - INTERVAL 24 HOURS), 0)::BIGINT AS pop_24h,
  count(l.label) FILTER (WHERE l.ts >= b.ts - INTERVAL 24 HOURS) AS v_24h, coalesce(sum(l.label) FILTER (WHERE l.ts >= b.ts - INTERVAL 1 HOURS), 0)::BIGINT AS pop_1h
  FROM (SELECT DISTINCT impression_id, pos, article_id, ts FROM base) b LEFT JOIN lab l ON l.article_id = b.article_id AND l.ts < b.ts GROUP BY 1, 2, 3),
read AS (SELECT user_id, category, count(*) AS k FROM (SELECT user_id, unnest(ids) AS article_id FROM hist) JOIN cats USING (article_id) GROUP BY 1, 2),
tot AS (SELECT user_id, sum(k) AS n FROM read GROUP BY 1)
SELECT b.impression_id, b.user_id, b.ts, b.pos, b.article_id, b.label, pop_total, pop_24h, pop_1h, CASE WHEN v_all = 0 THEN 0 ELSE pop_total / (v_all + 10.0::DOUBLE) END AS ctr_total,
  CASE WHEN v_24h = 0 THEN 0 ELSE pop_24h / (v_24h + 10.0::DOUBLE) END AS ctr_24h, bm25, semantic, slate_size, coalesce(k::DOUBLE / n, 0) AS cat_affinity, coalesce(len(ids), 0) AS history_len,
  round(coalesce((epoch_us(b.ts) - epoch_us(p)) / 3600000000.0::DOUBLE, -1), 6) AS age_hours
FROM base b JOIN c ON c.impression_id = b.impression_id AND c.pos = b.pos AND c.article_id IS NOT DISTINCT FROM b.article_id LEFT JOIN pub ON pub.article_id = b.article_id LEFT JOIN cats ON cats.article_id = b.article_id
  LEFT JOIN read ON read.user_id = b.user_id AND read.category = cats.category LEFT JOIN tot ON tot.user_id = b.user_id LEFT JOIN hist ON hist.user_id = b.user_id""",
    "gbt_scores": f"WITH {_EVALUATED} SELECT impression_id, pos, label, true AS is_probability FROM later",
    "importance": " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS in_bounds" for f in ranker.SKEW_RESISTANT),
    "feature_ablation": _variants(("with slate_size", "without slate_size")),
    "count_ablation": _variants([f"{k} {n}" for k in ("rolling", "frozen") for n in ("category", "age")]),
    "gap_aware": _variants([f"{k} {n}" for k in ("scores", "pooled") for n in ("category", "skew resistant")]),
    "submission_faults": f"""WITH {_SLATES}, s AS (SELECT impression_id, impression_id % 17 AS kind, count(*) AS n, CASE WHEN impression_id % 17 = 4 THEN 0 WHEN impression_id % 17 = 7 THEN 2 ELSE 1 END AS times,
  arg_min(rk, pos) AS head FROM (SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY bm25 DESC, pos) AS rk FROM slate) GROUP BY 1),
f AS (SELECT sum(times) AS lines, count(*) FILTER (WHERE times > 0 AND NOT (kind = 3 OR kind = 1 AND n > 1)) AS good, count(*) FILTER (WHERE times = 2) AS duplicate_rows,
  count(*) FILTER (WHERE kind = 3 OR kind = 1 AND n > 1) AS bad_format, count(*) FILTER (WHERE kind = 2 AND n > 1 AND head = 1) AS bad_ranks, count(*) FILTER (WHERE kind = 5 AND n > 1) AS bad_length,
  count(*) FILTER (WHERE kind IN (3, 4, 6) OR kind = 1 AND n > 1) AS missing, count(*) FILTER (WHERE kind = 6) AS extra FROM s)
SELECT CAST(lines AS BIGINT) AS lines, good AS impressions, duplicate_rows, bad_format, bad_ranks, bad_length, missing, extra, (duplicate_rows + bad_format + bad_ranks + bad_length + missing + extra) = 0 AS ok FROM f""",
    "users_remaining": f"WITH {_IMP} SELECT count(DISTINCT user_id) AS users FROM imp WHERE ts >= {_CUT}",
    "manifest": f"""WITH {_IMP}, e AS (SELECT date_trunc('day', max(ts))::TIMESTAMP AS t, min(ts) AS lo, max(ts) AS hi FROM imp)
SELECT 0 AS seed, lo AS data_min, t - INTERVAL 1 DAY AS val_start, t AS test_start, hi AS data_max, '{CUTOFF}' AS cutoff, (SELECT count(*) FROM imp) AS impressions,
  (SELECT count(*) FROM imp WHERE ts < t - INTERVAL 1 DAY) AS train, (SELECT count(*) FROM imp WHERE ts >= t - INTERVAL 1 DAY AND ts < t) AS val, (SELECT count(*) FROM imp WHERE ts >= t) AS test FROM e""",
    "latent_check": r"""WITH txt AS (SELECT article_id AS id, min({'title': title, 'abstract': abstract}) AS t FROM articles WHERE article_id IS NOT NULL GROUP BY 1),
w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(t.title, '') || ' ' || coalesce(t.abstract, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM txt),
good AS (SELECT term FROM (SELECT DISTINCT id, term FROM w) GROUP BY 1 HAVING count(*) >= 2), m AS (SELECT least(count(*), 200000) AS m FROM good)
SELECT id AS article_id, greatest(1, least(128, m - 1, (SELECT count(*) FROM txt) - 1)) AS components, CASE WHEN id IN (SELECT id FROM w SEMI JOIN good USING (term)) THEN 1.0::DOUBLE ELSE 0 END AS length, true AS explained_fits FROM txt, m""",
}
