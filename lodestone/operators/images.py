"""Image search over an image collection: by image, by text in a joint space, by caption, and all of them in one list.

An image collection has image_id (long), image_path, caption, embedding (the image's vector, in the joint space of
texts and images) and caption_embedding (the caption's vector, in that of texts). Questions come as (query_id, vector).
A hit is (query_id, rank, image_id, image_path, caption, score, retrieval_type); score: 1 - cosine distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.vectors import distance_score
from lodestone.operators.dense import dense_search
from lodestone.operators.fusion import unified


def _hits(images: DataFrame, asked: DataFrame, fetch: int, keep: int, vector: str, kind: str) -> DataFrame:
    found = dense_search(images, asked, fetch, "image_id", vector).where(F.col("rank") <= keep)
    score = F.round(distance_score(1 - F.col("score")), 6).alias("score")
    rows = found.select("query_id", "rank", F.col("id").alias("image_id"), score)
    return rows.join(images.select("image_id", "image_path", "caption"), "image_id").select("query_id", "rank", "image_id", "image_path", "caption", "score", F.lit(kind).alias("retrieval_type"))


def by_image(images: DataFrame, asked: DataFrame, n: int = 10) -> DataFrame:
    """The n most similar images; one more is asked for, as the query image may be in the collection, and cut off again."""
    return _hits(images, asked, n + 1, n, "embedding", "image_similarity")


def by_joint_text(images: DataFrame, asked: DataFrame, n: int = 10) -> DataFrame:
    """The n images nearest to a text's vector in the joint space."""
    return _hits(images, asked, n, n, "embedding", "clip_text_image")


def by_caption(images: DataFrame, asked: DataFrame, n: int = 10) -> DataFrame:
    """The n images whose captions are nearest; images without a caption or path aren't in the index."""
    return _hits(_captioned(images), asked, n, n, "caption_embedding", "caption_match")


def _captioned(images: DataFrame) -> DataFrame:
    return images.where((F.coalesce("caption", F.lit("")) != "") & (F.coalesce("image_path", F.lit("")) != ""))


def by_text(images: DataFrame, joint: DataFrame, caption: DataFrame, n: int = 10) -> DataFrame:
    """Both text searches in one list: the better hit of each image, the n best of each question."""
    lists = [by_joint_text(images, joint, n), by_caption(images, caption, n)]
    return unified([x.drop("rank").withColumnRenamed("image_id", "doc_id") for x in lists], n).withColumnRenamed("doc_id", "image_id").select("query_id", "rank", "image_id", "image_path", "caption", "score", "retrieval_type")


def caption_matches(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(caption, image_path, score): the nearest image of each caption (caption_id long, caption, vector) named in texts."""
    asked = captions.select(F.col("caption_id").alias("query_id"), "vector")
    best = by_caption(images, asked, 1).select(F.col("query_id").alias("caption_id"), "image_path", "score")
    return captions.select("caption_id", "caption").join(best, "caption_id").select("caption", "image_path", "score")
