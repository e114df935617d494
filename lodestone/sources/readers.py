"""Readers and writers for documents, records, questions, results and reports. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestone import files as store
from lodestone.operators.evaluation import metric_summary, query_results

IMAGE_RECORD = "image_path string, caption string, source string"


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_path, text, modified) of every .md file below folder; none is an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    if not rows.limit(1).count():
        raise ValueError(f"no Markdown files below {folder}")
    return rows


def image_records(spark: SparkSession, path: str) -> DataFrame:
    """Image records of a JSON-lines file, with ordinal in file order."""
    return spark.read.schema(IMAGE_RECORD).json(path).withColumn("ordinal", F.monotonically_increasing_id())


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file below folder, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of image files, for an injected encoder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder).select("path", "content")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, picture struct<height, width, nChannels, data>) of the files below folder, decoded by Spark; a null picture for a file that is none."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    fields = F.struct(*[F.col(f"image.{f}").alias(f) for f in ("height", "width", "nChannels", "data")])
    return rows.select(F.col("image.origin").alias("path"), F.when(F.col("image.height") > 0, fields).alias("picture"))


def parse_questions(files: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(qid, question, answer) from whole JSON files: [{question, answer?}], ["..."] or {"questions": ["..."]}; blank ones go, others are dropped. keep: columns to carry along."""
    keep = keep or []
    v = F.col(column)
    as_list = F.from_json(v, "array<string>")
    items = F.coalesce(F.from_json(F.get_json_object(v, "$.questions"), "array<string>"), as_list)
    each = files.select(*keep, F.posexplode(items).alias("pos", "item"))
    is_object = F.col("item").rlike(r"^\s*\{")
    question = F.when(is_object, F.get_json_object("item", "$.question")).otherwise(F.col("item"))
    rows = each.select(*keep, (F.col("pos") + 1).alias("qid"), question.alias("question"), F.when(is_object, F.get_json_object("item", "$.answer")).alias("answer"))
    return rows.where(F.trim(F.coalesce("question", F.lit(""))) != "")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return parse_questions(spark.read.text(path, wholetext=True))


def evaluation_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer, contexts) of a saved batch: {results: [...]} or a bare list; either name of each field."""
    item = "struct<original_question: string, query: string, generated_answer: string, answer: string, retrieval_results: map<string, struct<content: string>>, retrieval: map<string, struct<content: string>>>"
    v = spark.read.text(path, wholetext=True)
    rows = v.select(F.posexplode(F.coalesce(F.from_json(F.get_json_object("value", "$.results"), f"array<{item}>"), F.from_json("value", f"array<{item}>"))).alias("id", "r"))
    hits = F.map_values(F.coalesce("r.retrieval_results", "r.retrieval"))
    return rows.select("id", F.coalesce("r.original_question", "r.query").alias("question"), F.coalesce("r.generated_answer", "r.answer").alias("answer"), F.transform(hits, lambda h: h["content"]).alias("contexts"))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 4) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if store.names(spark, path) == [name]:  # a stream reads folders
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def save_batch(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """A batch as JSON: summary and results beside each other."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    results.write.mode("overwrite").json(f"{folder}/results")


def save_report(scores: DataFrame, folder: str) -> None:
    """An evaluation as JSON: query_results (id, metrics) and summary (metric, average, max, min, count) beside each other."""
    query_results(scores).write.mode("overwrite").json(f"{folder}/query_results")
    metric_summary(scores).write.mode("overwrite").json(f"{folder}/summary")


def append_results(results: DataFrame, folder: str, session: str) -> None:
    """Adds a session's results to the result table, partitioned by session."""
    results.withColumn("session_id", F.lit(session)).write.mode("append").partitionBy("session_id").parquet(folder)
