"""Whole search plans: many questions at once, one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lodestone.conf import Config
from lodestone.functions.ranking import by_score, top_k
from lodestone.functions.text import captions, full_path, image_content
from lodestone.models import LanguageModel
from lodestone.operators import evaluation, images
from lodestone.operators.answers import answer_images, answers, context_budget, context_budgets, model_answers, pack_context, responses
from lodestone.operators.dense import dense_search
from lodestone.operators.fusion import combine, merge_modalities
from lodestone.operators.lexical import bm25_search
from lodestone.operators.lexical_store import LexicalStore
from lodestone.operators.rerank import rerank
from lodestone.operators.similarity import filter_results, text_similarity
from lodestone.saved import saved


def hybrid_search(docs: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 10, dense_weight: float = 0.7, sparse_weight: float = 0.3, reranker: str | None = None, index: LexicalStore | None = None, **options) -> DataFrame:
    """(query_id, rank, doc_id, score): docs (doc_id, text), vectors (doc_id, embedding), questions (query_id, query, vector).

    Each side gives 2k hits, both are scaled and merged; a reranker by name sees the whole merged list before the cut to k.
    index: a stored index of docs; without one their texts are read and split here.
    """
    dense = dense_search(vectors, questions.select("query_id", "vector"), 2 * k, "doc_id").withColumnRenamed("id", "doc_id")
    sparse = index.search(questions, 2 * k) if index else bm25_search(docs, questions, 2 * k)
    merged = combine(dense, sparse, dense_weight, sparse_weight)
    if reranker:
        rows = with_content(merged, questions, docs)
        merged = rerank(rows, reranker, **options).select("query_id", "doc_id", F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def with_content(hits: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with their query and content: what rerankers and filters take."""
    return hits.join(questions.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")


def caption_images(text_hits: DataFrame, matches: DataFrame) -> DataFrame:
    """Image hits of the captions named in text hits: matches (caption, image_path, score) has each caption's best image; the first hit of an image stays."""
    named = text_hits.select("query_id", "rank", F.posexplode(captions(F.col("content"))).alias("at", "caption"))
    found = named.join(matches, "caption")
    first = top_k(found, 1, ["query_id", "image_path"], F.col("rank"), F.col("at"), name="_first")
    return first.select("query_id", "image_path", "caption", "score")


def all_image_hits(text_hits: DataFrame, questions: DataFrame, collection: DataFrame, embed_captions: Callable[[DataFrame], DataFrame], base: str = "", n: int = 10) -> DataFrame:
    """(query_id, doc_id, content, score, retrieval_type): the three image searches of each question, in one table.

    image_to_image: for questions with an image_vector of their own; image_from_text: the best image of each caption that the text hits
    (query_id, rank, content) name, the first of an image; clip_text_to_image: for questions with a clip_vector, which stands in the
    joint space of texts and images. embed_captions adds `vector` to (caption_id, caption).
    """

    def rows(hits: DataFrame, kind: str) -> DataFrame:
        return hits.select("query_id", F.col("image_id").alias("doc_id"), image_content(F.col("caption"), full_path(F.col("image_path"), base)).alias("content"), "score", F.lit(kind).alias("retrieval_type"))

    asked = lambda c: questions.where(F.size(c) > 0).select("query_id", F.col(c).alias("vector"))
    named = text_hits.select(F.explode(captions(F.col("content"))).alias("caption")).distinct().withColumn("caption_id", F.monotonically_increasing_id())
    matches = images.caption_matches(collection, embed_captions(saved(named, "captions")))
    from_text = caption_images(text_hits, matches).drop("caption").join(collection.select("image_path", "image_id", "caption"), "image_path")
    parts = [rows(images.by_image(collection, asked("image_vector"), n), "image_to_image"), rows(from_text, "image_from_text"), rows(images.by_joint_text(collection, asked("clip_vector"), n), "clip_text_to_image")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def search_and_answer(docs: DataFrame, vectors: DataFrame, questions: DataFrame, image_hits: DataFrame | None = None, k: int = 10, reranker: str | None = "rule", filter_kind: str | None = "text", now: str | None = None, llm=None, index: LexicalStore | None = None, collection: DataFrame | None = None, embed_captions: Callable[[DataFrame], DataFrame] | None = None, base: str = "", choose: Callable[[DataFrame], DataFrame] | None = None, settings: Config = Config()) -> DataFrame:
    """One response per question: hybrid text hits, filtered image hits, packed context, answer, images (paths that go along).

    choose: any further choice among image hits before they are filtered. Image hits are given (query_id, doc_id, content, score, retrieval_type), or found by all_image_hits where there is a collection. The images of an answer, and a
    question's own (image_vector), leave less room for its text: each question has its own budget.
    """
    text = with_content(hybrid_search(docs, vectors, questions, k, settings.dense_weight, settings.sparse_weight, reranker, index), questions, docs)
    text = saved(text.select("query_id", "doc_id", "content", "score", F.lit("hybrid").alias("retrieval_type"), "rank"), "text-hits")
    if collection is not None:
        found = all_image_hits(text, questions, collection, embed_captions, base, k)
        image_hits = found if image_hits is None else image_hits.select(*found.columns).unionByName(found)
    if image_hits is not None:
        found = image_hits.select("query_id", "doc_id", "content", "score", "retrieval_type")
        if choose:
            found = choose(found)
        if filter_kind:
            ranked = top_k(found, None, ["query_id"], *by_score("score", "retrieval_type", "doc_id"))
            found = filter_results(text_similarity(ranked.join(questions.select("query_id", "query"), "query_id")), filter_kind, threshold=settings.similarity_threshold).withColumn("score", F.col("blended"))
        hits = merge_modalities(text.drop("rank"), found.select("query_id", "doc_id", "content", "score", "retrieval_type"))
    else:
        hits = top_k(text.drop("rank"), None, ["query_id"], *by_score("score", "doc_id"))
    own = F.coalesce(F.size("image_vector") > 0, F.lit(False)) if "image_vector" in questions.columns else F.lit(False)
    hits = saved(hits.join(questions.select("query_id", own.alias("own_image")), "query_id"), "hits")
    paths = answer_images(hits, settings.max_images, F.col("own_image"))
    sent = paths.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda p: p["path"]).alias("images"))
    hits = hits.join(sent, "query_id", "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    packed = pack_context(hits, context_budgets(F.size("images") + F.col("own_image").cast("int")))
    replies = answers(questions.select("query_id", "query"), packed, llm)
    out = responses(questions.select("query_id", "query"), hits, replies, now).join(sent, "query_id", "left").join(packed.select("query_id", "context"), "query_id", "left")
    return out.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def answer_file(originals: DataFrame, questions: DataFrame, hits: DataFrame, make: Callable[[], LanguageModel], now: str | None = None, attempts: int = 1) -> DataFrame:
    """File mode: a record for each question of a file (qid, question, answer), answered from hits (query_id, doc_id, content, rank, ...) by a language model.

    A question whose reply fails keeps its error and has no answer; all other records are whole. The model is asked when this is called, once for each question.
    """
    replies = saved(model_answers(questions.select("query_id", "query"), pack_context(hits, context_budget(0)), make, attempts=attempts), "replies")
    got = responses(questions.select("query_id", "query"), hits, replies, now).join(replies.select("query_id", "error", "seconds"), "query_id")
    return evaluation.file_records(originals, got.select("query_id", "answer", "retrieval", "total_results", "timestamp", "seconds", "error"), now)


def batch_report(records: DataFrame) -> DataFrame:
    """The summary of a file's records: failed ones are those with an error."""
    return evaluation.batch_summary(records.select(F.col("error").isNull().alias("ok"), F.col("processing_time").alias("seconds")))
