"""Merging result lists: weighted hybrid fusion, unions across modalities, keep-best."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.ranking import by_score, keep_best, min_max, top_k


def combine(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score, rank): full outer merge of two lists (query_id, doc_id, score, rank) after min-max scaling of each.

    Ties: dense rows first, in their order, then sparse ones.
    """
    side = lambda df, w, name: df.select("query_id", "doc_id", (min_max(F.col("score"), ["query_id"]) * w).alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    both = side(dense, dense_weight, "dense").join(side(sparse, sparse_weight, "sparse"), ["query_id", "doc_id"], "full")
    both = both.withColumn("score", F.coalesce("dense_score", F.lit(0.0)) + F.coalesce("sparse_score", F.lit(0.0)))
    order = [F.round("score", 6).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()]
    return top_k(both, None, ["query_id"], *order).select("query_id", "doc_id", "score", "rank")


def unified(lists: list[DataFrame], k: int) -> DataFrame:
    """Union of result lists (query_id, doc_id, score, ...), the best score of each document, the k best of each query."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    best = keep_best(every, ["query_id", "doc_id"], *by_score("score"))
    return top_k(best, k, ["query_id"], *by_score("score", "doc_id"))


def merge_modalities(text: DataFrame, image: DataFrame) -> DataFrame:
    """Text and image hits (query_id, doc_id, score, retrieval_type) in one list by score; scales aren't reconciled."""
    return top_k(text.unionByName(image), None, ["query_id"], *by_score("score", "retrieval_type", "doc_id"))


def weighted_full_outer(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float) -> DataFrame:
    """(query_id, doc_id, score): weighted sum of two similarity lists, 0 where one is missing."""
    both = a.select("query_id", "doc_id", F.col("score").alias("a")).join(b.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", (weight_a * F.coalesce("a", F.lit(0.0)) + weight_b * F.coalesce("b", F.lit(0.0))).alias("score"))
