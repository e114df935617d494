"""Rerankers over (query_id, query, doc_id, content, score, rank): rules, a scoring model, a model's permutation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.ranking import by_score, top_k
from lodestone.functions.text import length_score, overlap, parse_order, position_bonus, raw_tokens
from lodestone.models import LanguageModel, with_replies
from lodestone.operators.answers import rerank_prompts

OVERLAP, LENGTH, POSITION = 0.3, 0.1, 0.1


def rule_rerank(results: DataFrame) -> DataFrame:
    """Adds overlap, length_score, position_bonus and the blended score; ranks anew, ties by the old rank."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    scored = results.withColumns({
        "overlap": overlap(raw_tokens(F.col("query")), raw_tokens(F.col("content"))),
        "length_score": length_score(F.col("content")),
        "position_bonus": position_bonus(F.col("rank") - 1, n),
    })
    scored = scored.withColumn("new_score", (1 - OVERLAP - LENGTH - POSITION) * F.col("score") + OVERLAP * F.col("overlap") + LENGTH * F.col("length_score") + POSITION * F.col("position_bonus"))
    return top_k(scored, None, ["query_id"], *by_score("new_score", "rank"), name="new_rank")


def model_rerank(results: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Scores by a model, a function of the query and content columns (a pandas UDF in production); token overlap stands in."""
    score = score or (lambda q, c: overlap(raw_tokens(q), raw_tokens(c)))
    return top_k(results.withColumn("new_score", score(F.col("query"), F.col("content"))), None, ["query_id"], *by_score("new_score", "rank"), name="new_rank")


def order_rerank(results: DataFrame, replies: DataFrame) -> DataFrame:
    """Reorders each query's results by a model's reply (query_id, reply); an unusable reply keeps the order and scores."""
    sizes = results.groupBy("query_id").agg(F.count("*").alias("n"))
    orders = replies.join(sizes, "query_id").select("query_id", "n", F.posexplode(parse_order(F.col("reply"), F.col("n"))).alias("place", "index"))
    given = orders.select("query_id", (F.col("index") + 1).alias("rank"), (F.col("place") + 1).alias("place"), ((F.col("n") - F.col("place")) / F.col("n")).alias("order_score"))
    out = results.join(given, ["query_id", "rank"], "left")
    return out.withColumn("new_rank", F.coalesce("place", "rank")).withColumn("new_score", F.coalesce("order_score", "score")).drop("place", "order_score")


def llm_rerank(results: DataFrame, make: Callable[[], LanguageModel], kind: str = "auto") -> DataFrame:
    """order_rerank by a language model that is asked once per query, with the prompt of its kind."""
    return order_rerank(results, with_replies(rerank_prompts(results, kind), make).select("query_id", "reply"))


def rerank(results: DataFrame, kind: str = "rule", **options) -> DataFrame:
    """Dispatch by name: rule, model, order (replies given) or llm (replies asked for)."""
    return {"rule": rule_rerank, "model": model_rerank, "order": order_rerank, "llm": llm_rerank}[kind](results, **options)
