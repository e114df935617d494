"""Readers, sinks, chunking, models and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import models
from lodestone.operators.chunking import sections
from lodestone.operators.evaluation import batch_summary
from lodestone.plans.search import search_and_answer
from lodestone.sources import readers
from lodestone.streaming.sessions import answer_stream, latest_summaries, summary_stream


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("intro\n# One\ntext\n```\n# not a heading\n```\n## Two\nmore\n# Three\n")
    docs = readers.markdown(spark, str(tmp_path))
    rows = sections(docs).orderBy("pos").collect()
    assert [(r.header_level, list(r.header_path)) for r in rows] == [(0, []), (1, ["One"]), (2, ["One", "Two"]), (1, ["Three"])]
    assert "# not a heading" in rows[1].text and rows[0].next_id == rows[1].node_id and rows[3].next_id is None


def test_no_markdown_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(Exception):
        readers.markdown(spark, str(tmp_path))


def test_questions_and_evaluation_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "a", "answer": "b"}, {"question": " "}, {"question": "c"}]))
    assert [(r.qid, r.question, r.answer) for r in readers.questions(spark, str(tmp_path / "q.json")).orderBy("qid").collect()] == [(1, "a", "b"), (3, "c", None)]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"query": "q", "answer": "a", "retrieval": {"doc_1": {"content": "x"}}}]}))
    assert tuple(readers.evaluation_records(spark, str(tmp_path / "r.json")).first()) == (0, "q", "a", ["x"])


def test_models(spark):
    df = models.with_embeddings(spark.createDataFrame([("a b",), ("",)], "text string"), lambda: models.embedder("hash"))
    sizes = [sum(x * x for x in r.embedding) for r in df.collect()]
    assert sizes[0] == pytest.approx(1) and sizes[1] == 0
    with pytest.raises(ValueError):
        models.language_model("none")


def test_answers_as_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id bigint, text string")
    vectors = models.with_embeddings(docs, lambda: models.embedder("hash")).select("doc_id", "embedding")
    spark.createDataFrame([(5, "alpha")], "query_id bigint, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id bigint, query string").parquet(str(tmp_path / "in"))

    def answer(batch):
        asked = models.with_embeddings(batch, lambda: models.embedder("hash"), "query", "vector")
        return search_and_answer(docs, vectors, asked, k=2, now="2024-01-02 03:04:05").select("query_id", "answer")

    q = answer_stream(stream, answer, str(tmp_path / "out"), "s1", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.query_id, r.answer, r.session_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(5, "alpha beta", "s1")]


def test_replayed_epochs_stand_once(spark, tmp_path):
    """A micro-batch whose commit was lost is run again: the answers and the summaries are the same as before."""
    made = tmp_path / "in"
    rows = [(i % 3, i % 4 != 0, i / 2) for i in range(40)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "session_id long, ok boolean, seconds double").coalesce(1).write.mode("append").parquet(str(made))
    stream = spark.readStream.schema("session_id long, ok boolean, seconds double").option("maxFilesPerTrigger", 1).parquet(str(made))

    def run():
        answer_stream(stream.selectExpr("session_id as query_id", "seconds as query"), lambda b: b, str(tmp_path / "a"), "s", str(tmp_path / "ca")).awaitTermination(120)
        summary_stream(stream, str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination(120)
        answers = sorted(r[:2] for r in spark.read.parquet(str(tmp_path / "a")).select("query_id", "query").collect())
        return answers, sorted(map(tuple, latest_summaries(spark, str(tmp_path / "b")).collect()))

    first = run()
    assert first[0] == sorted((s, t) for s, _, t in rows)
    df = spark.createDataFrame(rows, "session_id long, ok boolean, seconds double")
    assert first[1] == sorted((s, *batch_summary(df.where(F.col("session_id") == s)).first()) for s in range(3))
    for c in ("ca", "cb"):
        last = max((tmp_path / c / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == first
    # another stream over the same table has epochs of its own
    answer_stream(stream.selectExpr("session_id as query_id", "seconds as query"), lambda b: b, str(tmp_path / "a"), "s", str(tmp_path / "other")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 80


def test_append_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    readers.save_batch(df, df, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "results")).count() == 1
    assert readers.files(spark, str(tmp_path / "b")).where(F.col("length") > 0).count() >= 2
