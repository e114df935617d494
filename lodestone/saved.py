"""Tables that a plan writes on the way, so that what is used several times is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import files

#: Rows of a stated set (questions, their terms) that are broadcast at most, and characters of them.
MOST, MOST_CHARACTERS = 200_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; on a cluster that would lose data, so it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lodestone-shared")
    return own


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written on the way. Results not yet read can't be read after it."""
    files.delete(spark, tables_dir(spark))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; remove_tables() deletes it."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fits(df: DataFrame, most: int) -> bool:
    """Whether df has no more than `most` rows, and they no more than MOST_CHARACTERS as text."""
    rows, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return rows <= most and size <= MOST_CHARACTERS


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """df, to be broadcast if it is within the bounds."""
    return F.broadcast(df) if _fits(df, most) else df


def against_all(rows: DataFrame, asked: DataFrame, blocks: int = 64, most: int = MOST) -> DataFrame:
    """Every row with every one of a stated set: broadcast within the bounds, beyond them in blocks of the set that meet all rows by a join."""
    if _fits(asked, most):
        return rows.crossJoin(F.broadcast(asked))
    key = "_block"
    dealt = asked.withColumn(key, F.pmod(F.xxhash64(*asked.columns), F.lit(blocks)).cast("int"))
    return rows.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, key).drop(key)
