"""Batch summaries, evaluation samples and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import clean, overlap, raw_tokens, truncate_sentences
from lodestone.models import Judge
from lodestone.saved import small
from lodestone.session import ship

# Limits of an evaluation sample.
CONTEXTS, CONTEXT_SIZE, ANSWER_SIZE, QUESTION_SIZE = 2, 600, 800, 200
METRICS = ("faithfulness", "answer_relevancy", "context_relevancy")


def samples(records: DataFrame) -> DataFrame:
    """(id, question, answer, contexts) from (id, question, answer, contexts array); rows without question, answer or context go."""
    rows = records.where((F.coalesce(F.trim("question"), F.lit("")) != "") & (F.coalesce(F.trim("answer"), F.lit("")) != ""))
    contexts = F.filter(F.transform("contexts", lambda c: clean(truncate_sentences(c, CONTEXT_SIZE))), lambda c: c.isNotNull() & (c != ""))
    rows = rows.withColumn("contexts", F.slice(contexts, 1, CONTEXTS)).where(F.size("contexts") > 0)
    return rows.select("id", F.substring("question", 1, QUESTION_SIZE).alias("question"), clean(F.substring("answer", 1, ANSWER_SIZE)).alias("answer"), "contexts")


def overlap_metrics(rows: DataFrame) -> DataFrame:
    """(id, metric, score) by token overlap: stand-ins for model-judged metrics, of which they are only a rough image."""
    context = raw_tokens(F.array_join("contexts", " "))
    pairs = {"faithfulness": overlap(raw_tokens(F.col("answer")), context), "answer_relevancy": overlap(raw_tokens(F.col("question")), raw_tokens(F.col("answer"))), "context_relevancy": overlap(raw_tokens(F.col("question")), context)}
    return rows.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), pairs[m].alias("score")) for m in METRICS])).alias("x")).select("id", "x.metric", "x.score")


#: Characters of a context and of an answer once a judge's output could not be read, tries of a metric, and how such a failure is named.
JUDGE_CONTEXT, JUDGE_ANSWER, TRIES = 500, 1000, 3
UNREADABLE = ("failed to parse output", "output parser failed")


def judged_metrics(rows: DataFrame, make: Callable[[], Judge], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(id, metric, score, attempts, error) of samples (id, question, answer, contexts), by a judging model, one for each Python worker.

    A metric is tried TRIES times; what fails only then scores 0 and keeps its error. Where the judge's output could not be
    read, contexts and answer are cut for the next try and for the sample's metrics that follow. Other samples are untouched by a failure.
    """
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def judged(judge: Judge, question: str, answer: str, contexts: list[str]) -> Iterator[tuple]:
        for metric in metrics:
            for attempt in range(1, TRIES + 1):
                try:
                    score, error = judge.score(metric, question, answer, contexts), None
                    break
                except Exception as e:
                    score, error = 0.0, str(e) or type(e).__name__
                    if attempt < TRIES and any(u in error.lower() for u in UNREADABLE):
                        answer, contexts = answer[:JUDGE_ANSWER], [c[:JUDGE_CONTEXT] for c in contexts]
            yield metric, float(score or 0.0), attempt, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for rb in batches:
            ids, out = [], []
            for i, (question, answer, contexts) in enumerate(zip(*(rb.column(c).to_pylist() for c in (1, 2, 3)))):
                found = list(judged(judge, question or "", answer or "", [c or "" for c in contexts or []]))
                ids += [i] * len(found)
                out += found
            yield pa.record_batch([rb.column(0).take(pa.array(ids, pa.int64())), *(pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.string())))], ["id", "metric", "score", "attempts", "error"])

    return rows.select("id", "question", "answer", "contexts").mapInArrow(run, f"id {kind}, metric string, score double, attempts int, error string")


def metric_summary(scores: DataFrame) -> DataFrame:
    """(metric, average, max, min, count) over the known scores, at three decimals."""
    known = scores.where(F.col("score").isNotNull())
    return known.groupBy("metric").agg(F.round(F.avg("score"), 3).alias("average"), F.round(F.max("score"), 3).alias("max"), F.round(F.min("score"), 3).alias("min"), F.count("*").alias("count"))


def first_ranks(scores: DataFrame) -> DataFrame:
    """(query_id, rank) of the best relevant row among scores (query_id, id, score, relevant), null where none is: counted, not sorted."""
    place = F.struct(-F.round("score", 6), "id")
    best = scores.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), place)).alias("best"))
    ahead = scores.join(small(best), "query_id").groupBy("query_id").agg(F.first("best").alias("best"), F.count_if(place < F.col("best")).alias("ahead"))
    return ahead.select("query_id", F.when(F.col("best").isNotNull(), F.col("ahead") + 1).alias("rank"))


def recall_at(ranks: DataFrame, rank: str = "rank", at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: share of ranks within each cut-off (a null rank is a miss); 0 without rows."""
    hit = lambda k: F.coalesce(F.round(F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("int")), 6), F.lit(0.0)).alias(f"recall_{k}")
    return ranks.agg(*[hit(k) for k in at])


def file_records(originals: DataFrame, responses: DataFrame, now: str | None = None) -> DataFrame:
    """One record per question of a file, in its order: originals (qid, question, answer), responses (query_id = qid, answer, retrieval, total_results, timestamp, seconds, error).

    A question with an error, or without a response, keeps its own fields and the error; the rest are null.
    """
    rows = originals.join(responses.withColumnRenamed("query_id", "qid").withColumnRenamed("answer", "generated"), "qid", "left")
    error = F.when(F.col("error").isNotNull() | F.col("total_results").isNull(), F.coalesce("error", F.lit("no response")))
    good = lambda c, name: F.when(error.isNull(), F.col(c)).alias(name)
    stamp = F.date_format(F.lit(now).cast("timestamp") if now else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        F.col("qid").alias("id"), F.coalesce("question", F.lit("")).alias("original_question"), F.coalesce("answer", F.lit("")).alias("original_answer"), good("generated", "generated_answer"),
        good("retrieval", "retrieval_results"), good("total_results", "total_retrieved"), F.coalesce(good("timestamp", "t"), stamp).alias("timestamp"), good("seconds", "processing_time"), error.alias("error"),
    )


def query_results(scores: DataFrame) -> DataFrame:
    """(id, metrics): the metrics of each record as a map, from (id, metric, score)."""
    return scores.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "score")))).alias("metrics"))


def summary_columns() -> list[Column]:
    """Aggregates over (ok boolean, seconds double): counts, success rate and times of the successes as text at two decimals."""
    ok = F.col("ok")
    total, good = F.count("*"), F.count_if(ok)
    spent = F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0.0))
    return [
        total.alias("total_questions"), good.alias("successful_queries"), (total - good).alias("failed_queries"),
        F.when(total > 0, F.format_string("%.2f%%", good * 100.0 / F.greatest(total, F.lit(1)))).otherwise("0%").alias("success_rate"),
        F.format_string("%.2f", spent).alias("total_processing_time"), F.format_string("%.2f", spent / F.greatest(good, F.lit(1))).alias("average_processing_time"),
    ]


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over (ok boolean, seconds double)."""
    return results.agg(*summary_columns())
