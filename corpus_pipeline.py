"""A training corpus from raw documents: five stages, each the next one's input.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to
the folder in spark.checkpoint.dir and reads again for the next. All but the last return the columns of
documents; the last adds the fitted rate, the likeliest domain and the whole copies of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, mixing, ngram_join, pii, toxicity
from lodestone.llm._spark import Stage, table
from lodestone.llm.queries import TARGETS, known_domains


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id stays."""
    return ngram_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised, disclosing terms are removed; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate in the target mixture of languages."""
    return mixing.with_rates(docs, known_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", remove_personal_data),
    ("mixing", mix),
]

#: The models and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = stage.save(function(spark, docs, sf_dir), f"stage-{i}")
        if i:
            stage.drop(f"stage-{i - 1}")
    return docs
