"""Text similarity of a query to its candidates from four signals, and the filters built on it.

Inputs are candidate rows (query_id, query, doc_id, content, score, rank). Weights are fitted on each query's own
candidates (and the query itself, for TF-IDF and keywords), so every statistic is a window or aggregation per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.ranking import by_score, min_max_or_same, top_k
from lodestone.functions.text import hash_similarity, tokens
from lodestone.saved import saved, small

FEATURES, KEYWORDS = 1000, 10
K1, B = 1.5, 0.75
THRESHOLD, ALPHA = 0.1, 0.5


@dataclass(frozen=True)
class Terms:
    """The terms of a set of candidates, split and counted once for all signals.

    rows: query_id, doc_id (null for the query itself), len (tokens of the text), term, pair (whether it is two tokens), tf, total and df (over the
    query's candidates and itself), held (candidates that have the term), asked (its count in the query), n (texts), docs, avgdl.
    """

    candidates: DataFrame
    rows: DataFrame


def terms_of(candidates: DataFrame) -> Terms:
    own = candidates.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.col("query").alias("text")).distinct()
    every = candidates.select("query_id", F.col("doc_id").cast("bigint"), F.col("content").alias("text")).unionByName(own)
    texts = saved(every.select("query_id", "doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens")), "texts")
    size = F.size("tokens")
    sets = texts.groupBy("query_id").agg(F.count("*").alias("n"), F.count("doc_id").alias("docs"), F.avg(F.when(F.col("doc_id").isNotNull(), size)).alias("avgdl"))
    pairs = F.when(size > 1, F.zip_with(F.slice("tokens", F.lit(1), size - 1), F.slice("tokens", F.lit(2), size - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    each = texts.select("query_id", "doc_id", size.alias("len"), F.explode(F.concat("tokens", pairs)).alias("term")).groupBy("query_id", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    w = Window.partitionBy("query_id", "term")
    rows = each.withColumns({
        "pair": F.contains("term", F.lit(" ")), "total": F.sum("tf").over(w), "df": F.count("*").over(w), "held": F.count("doc_id").over(w),
        "asked": F.max(F.when(F.col("doc_id").isNull(), F.col("tf"))).over(w),
    })
    return Terms(candidates.select("query_id", F.col("doc_id").cast("bigint")), saved(rows.join(small(sets), "query_id"), "terms"))


def _share(name: str, terms: Terms, sums: DataFrame, value: Column) -> DataFrame:
    """value of (mine, own: the same of the query's own row) for each candidate, 0 where either is missing."""
    own = Window.partitionBy("query_id")
    each = sums.withColumn("own", F.max(F.when(F.col("doc_id").isNull(), F.col("mine"))).over(own)).where("doc_id is not null")
    out = terms.candidates.join(each.select("query_id", "doc_id", value.alias(name)), ["query_id", "doc_id"], "left")
    return out.select("query_id", "doc_id", F.coalesce(name, F.lit(0.0)).alias(name))


def _terms(candidates: DataFrame | Terms) -> Terms:
    return candidates if isinstance(candidates, Terms) else terms_of(candidates)


def tfidf_cosine(candidates: DataFrame | Terms) -> DataFrame:
    """(query_id, doc_id, tfidf) of every candidate, over the FEATURES most frequent terms and pairs of a query's set."""
    terms = _terms(candidates)
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "term"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1))
    kept = terms.rows.withColumn("place", place).where(F.col("place") <= FEATURES).select("query_id", "doc_id", (F.col("tf") * idf).alias("w"), (F.col("asked") * idf).alias("qw"))
    sums = kept.groupBy("query_id", "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("mine"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return _share("tfidf", terms, sums, F.col("dot") / F.nullif(F.col("mine") * F.col("own"), F.lit(0.0)))


def keyword_overlap(candidates: DataFrame | Terms) -> DataFrame:
    """(query_id, doc_id, keyword): shared share of the ten heaviest terms of query and candidate."""
    terms = _terms(candidates)
    weight = F.round(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 9)
    best = top_k(terms.rows.where("not pair").select("query_id", "doc_id", "term", weight.alias("w")), KEYWORDS, ["query_id", "doc_id"], F.desc("w"), "term")
    best = best.withColumn("also", F.max(F.col("doc_id").isNull()).over(Window.partitionBy("query_id", "term")))
    sums = best.groupBy("query_id", "doc_id").agg(F.count("*").alias("mine"), F.count_if("also").alias("shared"))
    return _share("keyword", terms, sums, F.col("shared") / F.greatest("mine", "own"))


def candidate_bm25(candidates: DataFrame | Terms) -> DataFrame:
    """(query_id, doc_id, bm25): BM25 over the query's own candidates, scaled to 0..1 (left as it is where all are equal)."""
    terms = _terms(candidates)
    weight = F.log((F.col("docs") - F.col("held") + 0.5) / (F.col("held") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    sums = terms.rows.where("not pair and doc_id is not null and asked is not null").groupBy("query_id", "doc_id").agg(F.sum(F.col("asked") * weight).alias("bm25"))
    out = terms.candidates.join(sums, ["query_id", "doc_id"], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9))
    return out.select("query_id", "doc_id", min_max_or_same(F.col("bm25"), ["query_id"]).alias("bm25"))


#: Each text feature by name: what a candidate gets from it.
METHODS = {"tfidf": tfidf_cosine, "keyword": keyword_overlap, "bm25": candidate_bm25}


def features(candidates: DataFrame, method: str) -> DataFrame:
    """(query_id, doc_id, features map<string, double>) of a method by name: a candidate's own weights of its terms.

    tfidf: the FEATURES most frequent terms and pairs; keyword: the ten heaviest terms; bm25: the query's terms that it has; hash: the
    text's MD5 digest as the one key. Another name is an error. A candidate without terms has an empty map.
    """
    if method == "hash":
        return candidates.select("query_id", F.col("doc_id").cast("bigint"), F.create_map(F.md5("content"), F.lit(1.0)).alias("features"))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join([*METHODS, 'hash'])}")
    terms = terms_of(candidates)
    rows = terms.rows.withColumn("w", F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)))
    if method == "tfidf":
        rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "term"))).where(F.col("place") <= FEATURES)
    elif method == "keyword":
        rows = top_k(rows.where("not pair"), KEYWORDS, ["query_id", "doc_id"], F.round("w", 9).desc(), F.col("term"))
    else:
        idf = F.log((F.col("docs") - F.col("held") + 0.5) / (F.col("held") + 0.5))
        rows = rows.where("not pair and asked is not null").withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))))
    maps = rows.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("features"))
    return terms.candidates.join(maps, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("features", F.create_map().cast("map<string,double>")).alias("features"))


SIGNALS = ("tfidf", "keyword", "hash", "bm25")


def text_similarity(candidates: DataFrame) -> DataFrame:
    """candidates with the four signals and raw_similarity: their mean, a signal that doesn't vary over a query's candidates counting 0."""
    candidates = saved(candidates, "candidates")  # a few rows a query
    terms = terms_of(candidates)
    out = candidates.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("hash", hash_similarity(F.col("query"), F.col("content")))
    for signal in METHODS.values():
        out = out.join(signal(terms), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id")

    def used(signal: str) -> Column:
        return F.when(F.round(F.stddev_pop(F.round(signal, 9)).over(w), 9) > 0, F.col(signal)).otherwise(0.0)

    return out.withColumn("raw_similarity", sum(used(s) for s in SIGNALS[1:]).__add__(used("tfidf")) / 4)


def blend(rows: DataFrame, score: str, similarity: str, alpha: float = ALPHA) -> DataFrame:
    """Adds blended: (1 - alpha) of the scaled score and alpha of the scaled similarity."""
    return rows.withColumn("blended", (1 - alpha) * min_max_or_same(F.round(score, 9), ["query_id"]) + alpha * min_max_or_same(F.round(similarity, 9), ["query_id"]))


def similarity_filter(rows: DataFrame, similarity: str = "raw_similarity", threshold: float = THRESHOLD, alpha: float = ALPHA, kind: str = "text") -> DataFrame:
    """Blends, keeps rows whose raw similarity reaches the threshold and ranks them; filtered_by names the signal."""
    kept = blend(rows, "score", similarity, alpha).where(F.round(similarity, 6) >= threshold).withColumn("filtered_by", F.lit(kind))
    return top_k(kept, None, ["query_id"], *by_score("blended", "doc_id"), name="new_rank")


def multimodal_filter(rows: DataFrame, weight: float = 0.3, **options) -> DataFrame:
    """The text filter with the weighted similarity that the multimodal score reports."""
    return similarity_filter(rows, kind="multimodal", **options).withColumn("multimodal_score", weight * F.col("raw_similarity"))


def filter_results(rows: DataFrame, kind: str, **options) -> DataFrame:
    """Dispatch: text and image filter by their similarity column, multimodal by text; another kind leaves rows unchanged."""
    if kind == "text":
        return similarity_filter(rows, **options)
    if kind == "image":
        return similarity_filter(rows, "image_similarity", kind="image", **options)
    if kind == "multimodal":
        return multimodal_filter(rows, **options)
    return rows


def filter_stats(rows: DataFrame) -> DataFrame:
    """One row: totals by filter, mean and range of the similarity."""
    counts = [F.count_if(F.col("filtered_by") == k).alias(f"{k}_filtered") for k in ("text", "image", "multimodal")]
    s = F.col("raw_similarity")
    return rows.agg(F.count("*").alias("total"), *counts, F.round(F.avg(s), 6).alias("mean_similarity"), F.round(F.min(s), 6).alias("min_similarity"), F.round(F.max(s), 6).alias("max_similarity"))


def perceptual_fusion(distance: Column, structure: Column, wavelet: Column) -> Column:
    """Image similarity from a perceptual distance and two similarities of an injected image model; nulls count as nothing."""
    return 0.4 * F.coalesce(1 - distance, F.lit(0.0)) + 0.3 * F.coalesce(structure, F.lit(0.0)) + 0.3 * F.coalesce(wavelet, F.lit(0.0))
