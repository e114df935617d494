"""From ranked results to answers: image choice, context packing, prompts, responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.ranking import top_k
from lodestone.functions.text import MEDICAL_WORDS, path_of, rerank_prompt_kind, snippet  # noqa: F401
from lodestone.models import LanguageModel, with_replies

# Characters the context may take.
WINDOW, PER_IMAGE, FOR_ANSWER, FOR_PROMPT, PER_TOKEN, REDUCED = 10240, 2500, 1500, 1000, 1.8, 1500
SEPARATOR, RESERVE, LEAST_CUT = "\n\n", 20, 100
NOTHING = "No relevant material was found for this question."

# Answer prompts by name: instructions of our own around the same two slots.
PROMPTS = {
    "strict": "Answer only from the material below. Say so where it is silent.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "simple": "Material:\n%2$s\n\nQuestion: %1$s\nAnswer briefly:",
    "advanced": "You are a specialist. Use only the material; give the core answer first, then details and cautions.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "optimized": "Give a complete, well-ordered answer grounded in the material.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "focused": "Answer exactly what is asked, in one paragraph, from the material.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "enhanced": "Weigh all of the material, note contradictions, then answer.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "medical": "As a clinician, answer from the material with correct terms.\n\nMaterial:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "contextual": "Use the context to answer; quote what supports it.\n\nContext:\n%2$s\n\nQuestion: %1$s\nAnswer:",
    "guide": "Write step-by-step guidance from the context.\n\nContext:\n%2$s\n\nTask: %1$s\nGuidance:",
}
# Preview characters of a candidate in each rerank prompt.
PREVIEW = {"basic": 200, "advanced": 300, "explanation": 200, "medical": 250}
RERANK_PROMPTS = {
    "basic": "Order the passages by relevance to the question. Reply with their numbers, comma-separated.\nQuestion: %1$s\n%2$s",
    "advanced": "Judge topic, completeness and reliability, then order the passages. Reply with their numbers, comma-separated.\nQuestion: %1$s\n%2$s",
    "explanation": "Order the passages by relevance; numbers first, comma-separated, then your reasons.\nQuestion: %1$s\n%2$s",
    "medical": "Order the passages by clinical relevance. Reply with their numbers, comma-separated.\nQuestion: %1$s\n%2$s",
}


def context_budget(images: int) -> int:
    """Characters left for text beside that many images."""
    return int((WINDOW - PER_IMAGE * images - FOR_ANSWER - FOR_PROMPT) * PER_TOKEN)


def context_budgets(images: Column) -> Column:
    """context_budget of a column."""
    return ((WINDOW - PER_IMAGE * images - FOR_ANSWER - FOR_PROMPT) * PER_TOKEN).cast("int")


def pack_context(results: DataFrame, budget: int | Column, reduce: bool = False, key: str = "query_id", order: str = "rank", content: str = "content") -> DataFrame:
    """(key, context, parts, cut): stripped non-blank contents in order, joined by a blank line, up to the budget.

    The first content that would overflow is cut (unstripped, with dots) if over LEAST_CUT characters are left, and
    nothing after it is taken even if it would fit. A budget of a column is that of the key's rows; none above 0 leaves no context.
    """
    most = REDUCED if reduce else context_budget(0) if isinstance(budget, Column) else budget
    budget = F.least(budget if isinstance(budget, Column) else F.lit(budget), F.lit(most))
    w = Window.partitionBy(key).orderBy(order)
    strip = F.regexp_replace(F.col(content), r"^\s+|\s+$", "")
    rows = results.select(key, order, content, strip.alias("part"), budget.alias("_budget")).where((F.length("part") > 0) & (F.col("_budget") > 0))
    # a part and its separator take three characters at least, so no more parts than this can fit or overflow
    rows = top_k(rows, max(0, most) // 3 + 2, [key], F.col(order), name="_place").drop("_place")
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("part") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("over", F.min(F.when(F.col("before") + F.length("part") > F.col("_budget"), F.col(order))).over(Window.partitionBy(key)))
    room = (F.col("_budget") - F.col("before") - RESERVE).cast("int")
    text = F.when(F.col("over").isNull() | (F.col(order) < F.col("over")), F.col("part")).when((F.col(order) == F.col("over")) & (room > LEAST_CUT), F.concat(F.substring(F.col(content), F.lit(1), room), F.lit("...")))
    kept = rows.withColumn("text", text)
    packed = kept.where(F.col("text").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("text")))).alias("l"), F.count("*").alias("parts"), F.coalesce(F.max(F.col(order) == F.col("over")), F.lit(False)).alias("cut"))
    packed = packed.select(key, F.array_join(F.transform("l", lambda x: x["text"]), SEPARATOR).alias("context"), "parts", "cut")
    return results.select(key).distinct().join(packed, key, "left").select(key, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("parts", F.lit(0)).cast("bigint").alias("parts"), F.coalesce("cut", F.lit(False)).alias("cut"))


def answer_images(results: DataFrame, most: int = 3, user_image: bool | Column = False) -> DataFrame:
    """(query_id, place, path): the first image hits of each query; the user's own image takes one place."""
    hits = results.where(F.col("retrieval_type").isin("image_from_text", "image_to_image")).withColumn("path", path_of(F.col("content"))).where("path <> ''")
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    taken = user_image.cast("int") if isinstance(user_image, Column) else F.lit(int(user_image))
    return hits.where(F.col("place") <= most - taken).select("query_id", "place", "path")


def answer_prompt(query: Column, context: Column, kind: str = "strict") -> Column:
    return F.format_string(PROMPTS[kind], query, context)


def rerank_prompts(results: DataFrame, kind: str = "auto") -> DataFrame:
    """(query_id, kind, prompt) from (query_id, query, rank, content)."""
    sets = results.groupBy("query_id", "query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("l"))
    sets = sets.withColumn("kind", rerank_prompt_kind(F.col("query"), F.col("n"), kind))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in PREVIEW.items() for x in kv]), F.col("kind"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), F.substring(x["content"], F.lit(1), size), F.lit("..."))), "\n")
    prompt = F.lit(None)
    for name, template in RERANK_PROMPTS.items():
        prompt = F.when(F.col("kind") == name, F.format_string(template, F.col("query"), body)).otherwise(prompt)
    return sets.select("query_id", "kind", prompt.alias("prompt"))


def answers(questions: DataFrame, contexts: DataFrame, llm: Callable[[Column], Column] | None = None, kind: str = "strict") -> DataFrame:
    """(query_id, query, prompt, answer): an injected model over the prompt column; the first part of the context stands in."""
    rows = questions.join(contexts, "query_id", "left")
    empty = F.coalesce("context", F.lit("")) == ""
    rows = rows.withColumn("prompt", F.when(~empty, answer_prompt(F.col("query"), F.col("context"), kind)))
    reply = llm(F.col("prompt")) if llm else F.substring_index("context", SEPARATOR, 1)
    return rows.select("query_id", "query", "prompt", F.when(empty, NOTHING).otherwise(reply).alias("answer"))


def model_answers(questions: DataFrame, contexts: DataFrame, make: Callable[[], LanguageModel], kind: str = "strict", attempts: int = 1) -> DataFrame:
    """(query_id, answer, error, seconds): a language model's answers; a question whose reply fails keeps the error and no answer, the others theirs."""
    asked = answers(questions, contexts, lambda prompt: F.lit(None).cast("string"), kind)
    asked = asked.withColumnRenamed("answer", "given")
    replied = with_replies(asked, make, error="error", seconds="seconds", attempts=attempts)
    return replied.select("query_id", F.coalesce("given", "reply").alias("answer"), "error", "seconds")


def responses(questions: DataFrame, results: DataFrame, replies: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """One row per question: answer, timestamp, total_results, retrieval (array by rank)."""
    fields = [c for c in ("rank", "doc_id", "content", "score", "retrieval_type") if c in results.columns]
    lists = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("retrieval"), F.count("*").alias("total_results"))
    out = questions.join(lists, "query_id", "left")
    if replies is not None:
        out = out.join(replies.select("query_id", "answer"), "query_id", "left")
    stamp = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return out.withColumn("timestamp", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")).withColumn("total_results", F.coalesce("total_results", F.lit(0)))


def bucket_of(retrieval_type: Column) -> Column:
    """The display bucket of a hit: its type if it is one of the three image types, else text."""
    return F.when(retrieval_type.isin("image_to_image", "image_from_text", "clip_text_to_image"), retrieval_type).otherwise("text")


def preview(results: DataFrame, most: int = 3) -> DataFrame:
    return results.where(F.col("rank") <= most).withColumn("snippet", snippet(F.col("content")))
