"""Index builds: Markdown books and image records to stored vector collections."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import files
from lodestone.models import Embedder, with_embeddings
from lodestone.operators.chunking import sections
from lodestone.operators.collections import Collections, image_nodes
from lodestone.operators.lexical_store import LexicalStore
from lodestone.operators.vector_store import VectorStore
from lodestone.saved import tables_dir
from lodestone.sources import readers


def document_nodes(docs: DataFrame, make: Callable[[], Embedder], id_col: str = "doc_path") -> DataFrame:
    """Rows of a document collection from texts: a section each, with its vector and where it stands."""
    rows = with_embeddings(sections(docs, id_col), make)
    meta = F.map_filter(F.create_map(F.lit("source"), F.col(id_col).cast("string"), F.lit("header_path"), F.array_join("header_path", "/"), F.lit("prev_id"), F.col("prev_id"), F.lit("next_id"), F.col("next_id")), lambda _, v: v.isNotNull())
    return rows.select(F.col("node_id").alias("id"), "embedding", F.col("text").alias("document"), meta.alias("metadata"))


def image_rows(records: DataFrame, base: str, make: Callable[[], Embedder], files: DataFrame | None = None) -> DataFrame:
    """Rows of an image collection from image records: valid ones, the last of each path, with the vectors of a model of paths.

    make: a model whose embed() takes the images' full paths; one that can't read an image returns None for it, and the
    image is left out.
    """
    nodes = image_nodes(records, base, files).withColumn("full", F.concat(F.when(F.col("image_path").startswith("/"), "").otherwise(base.rstrip("/") + "/"), "image_path"))
    rows = with_embeddings(nodes, make, "full").where(F.col("embedding").isNotNull())
    meta = F.create_map(F.lit("image_path"), F.col("image_path"), F.lit("source"), F.col("source"), F.lit("full_caption"), F.col("caption"))
    return rows.select(F.col("image_id").alias("id"), "embedding", F.col("caption").alias("document"), meta.alias("metadata"))


def _store(spark: SparkSession, name: str, rows: DataFrame, rebuild: bool) -> DataFrame:
    collections = Collections(spark)
    if rebuild:
        collections.replace(name, rows)
    else:
        collections.put(name, rows.withColumn("_at", F.lit(0)), "_at")
    return collections.info(name)


def build_documents(spark: SparkSession, folder: str, name: str, make: Callable[[], Embedder], rebuild: bool = False) -> DataFrame:
    """Stores every section of the Markdown files below folder; rebuild: in place of what the collection held. Returns its count."""
    return _store(spark, name, document_nodes(readers.markdown(spark, folder), make), rebuild)


def build_images(spark: SparkSession, records: str, base: str, name: str, make: Callable[[], Embedder], rebuild: bool = False) -> DataFrame:
    """Stores the images of a JSON-lines file whose files are below base. Returns the collection's count."""
    return _store(spark, name, image_rows(readers.image_records(spark, records), base, make, readers.files(spark, base)), rebuild)


def build_all(spark: SparkSession, folder: str, records: str, base: str, text_model: Callable[[], Embedder], image_model: Callable[[], Embedder], documents: str = "documents", images: str = "images", rebuild: bool = True) -> DataFrame:
    """Both collections, and the counts of both."""
    return build_documents(spark, folder, documents, text_model, rebuild).unionByName(build_images(spark, records, base, images, image_model, rebuild))


def kept(spark: SparkSession, kind: str, table: str, build: Callable[[str], None]) -> str:
    """Folder of an index of a table, built at its first use in this application and again once the table's files have changed.

    A build that was cut short leaves no mark and is made anew, in a folder of its own.
    """
    state = hashlib.sha256(f"{table}\n{files.fingerprint(spark, table)}".encode()).hexdigest()[:16]
    mark = f"{tables_dir(spark)}/{kind}-{state}.done"
    try:
        return files.read(spark, mark) if files.names(spark, mark) else _built(spark, mark, kind, build)
    except FileExistsError:  # another thread was faster
        return files.read(spark, mark)


def _built(spark: SparkSession, mark: str, kind: str, build: Callable[[str], None]) -> str:
    path = f"{tables_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    build(path)
    files.write_new(spark, mark, path)
    return path


def lexical_index(spark: SparkSession, table: str, **columns) -> LexicalStore:
    """The stored inverted index of a Parquet table of documents."""
    return LexicalStore(spark, kept(spark, "lexical", table, lambda path: LexicalStore.create(spark, path).upsert(spark.read.parquet(table), **columns)))


def vector_index(spark: SparkSession, table: str, **columns) -> VectorStore:
    """The stored cell index of a Parquet table of vectors."""
    return VectorStore(spark, kept(spark, "vectors", table, lambda path: VectorStore.build(spark, path, spark.read.parquet(table), **columns)))
