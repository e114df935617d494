"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.saved import shared_dir
from lodestone.session import ship


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all that this application's operators have written on the way. Results not yet read can't be read after it."""
    _delete(spark, _tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stage:
    """Tables an operator writes on the way, so that no lineage depends on an executor staying alive."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
        ship(spark)

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df as Parquet in the shared folder and read it back.

        rows: rows of a row group at most, for rows of megabytes; a reader holds a row group's worth of them at a time.
        """
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if rows:
            writer = writer.option("parquet.block.row.count.limit", rows)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
        # shuffle files of finished steps go when the driver collects the plans that made them
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that are broadcast to be dropped from a table (8 bytes each); beyond, the table is shuffled with them.
MOST_IDS = 2_000_000


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose id isn't in the one column of ids (distinct). Rows with a null id stay."""
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, df[column] == ids[ids.columns[0]], "left_anti")


def units(keys: int, work):
    """A mapInArrow function that calls work(table) -> batch or None on each run of rows equal in the first `keys` columns (longs or ints, no nulls)."""

    def run(batches):
        held, key = [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            k = np.stack([rb.column(i).to_numpy() for i in range(keys)], axis=1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(cut[:-1], cut[1:]):
                mine = tuple(k[a].tolist())
                if held and mine != key:
                    if (out := work(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield out
                    held = []
                key = mine
                held.append(rb.slice(a, b - a))
        if held and (out := work(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run
