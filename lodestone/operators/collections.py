"""Collections as tables: clean image records, last-wins upserts, catalog information."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone import files
from lodestone.functions.ranking import keep_best
from lodestone.functions.text import full_path


def image_nodes(records: DataFrame, base: str, files: DataFrame | None = None) -> DataFrame:
    """(image_id, image_path, caption, source): valid records (path and caption non-empty, file present), the last of each path.

    records: image_path, caption, source and ordinal (the record's order). files: column path, of the files that exist.
    """
    rows = records.where((F.coalesce(F.trim("image_path"), F.lit("")) != "") & (F.coalesce(F.trim("caption"), F.lit("")) != ""))
    rows = rows.withColumn("full", full_path(F.col("image_path"), base))
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("full")).distinct(), "full", "left_semi")
    rows = keep_best(rows, ["image_path"], F.col("ordinal").desc())
    return rows.select(F.sha2("image_path", 256).alias("image_id"), "image_path", "caption", F.coalesce("source", F.lit("")).alias("source"))


def upsert(old: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """old with new's rows in place of those of the same key; the row of the highest ordinal wins within new."""
    last = keep_best(new, [key], F.col(ordinal).desc())
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def collection_info(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection_name, document_count) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("document_count")).select(F.lit(name).alias("collection_name"), "document_count")
        out = one if out is None else out.unionByName(one)
    return out


class Collections:
    """Named vector collections in the session catalog: get or create, upsert, replace, inspect, delete.

    A collection is a view over a table that is divided by a bucket of the id and a version. An upsert reads and writes
    only the buckets of its ids, under a new version, and then the view names the current version of each bucket, in one
    catalog change: a crash leaves the old or the new state under the name, and files of other buckets aren't touched.
    """

    SCHEMA = "id string, embedding array<float>, document string, metadata map<string,string>"

    def __init__(self, spark: SparkSession, buckets: int = 64):
        self.spark, self.buckets = spark, buckets

    def _property(self, name: str, key: str) -> str:
        return self.spark.sql(f"SHOW TBLPROPERTIES `{name}`('{key}')").first().value

    def _versions(self, name: str) -> dict[int, int]:
        return {int(b): v for b, v in json.loads(self._property(name, "versions")).items()}

    def _data(self, name: str, versions: dict[int, int]) -> DataFrame:
        """Rows of the buckets in their versions: the condition is on what the folders are named by, so no other is read."""
        named = [f"{b}:{v}" for b, v in sorted(versions.items())]
        return self.spark.table(f"{name}_data").where(F.concat_ws(":", F.col("bucket").cast("string"), F.col("version").cast("string")).isin(named) if named else F.lit(False))

    def _point(self, name: str, versions: dict[int, int], metric: str, buckets: int) -> None:
        named = ", ".join(f"'{b}:{v}'" for b, v in sorted(versions.items())) or "''"
        self.spark.sql(
            f"CREATE OR REPLACE VIEW `{name}` TBLPROPERTIES('metric'='{metric}', 'buckets'='{buckets}', 'versions'='{json.dumps(versions)}') AS "
            f"SELECT id, embedding, document, metadata FROM `{name}_data` WHERE concat_ws(':', CAST(bucket AS STRING), CAST(version AS STRING)) IN ({named})"
        )

    def get(self, name: str, metric: str = "cosine", create: bool = True) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            if not create:
                raise ValueError(f"no collection {name}")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}_data` ({self.SCHEMA}, bucket int, version bigint) USING parquet PARTITIONED BY (bucket, version)")
            self._point(name, {}, metric, self.buckets)
        return self.spark.table(name)

    def metric(self, name: str) -> str:
        return self._property(name, "metric")

    def put(self, name: str, rows: DataFrame, ordinal: str) -> None:
        """Upserts by id; the row of the highest ordinal wins within rows, rows without an id are left out. Only the buckets of their ids are read and written."""
        self.get(name)
        versions, buckets = self._versions(name), int(self._property(name, "buckets"))
        rows = rows.where("id is not null").withColumn("bucket", _bucket(buckets))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # as many as there are buckets at most
        old = self._data(name, {b: v for b, v in versions.items() if b in touched}).drop("version")
        self._write(name, upsert(old, rows, "id", ordinal), versions, touched)

    def remove(self, name: str, ids: DataFrame) -> None:
        """Deletes the rows of the ids in the one column of ids; unknown ones are no error."""
        versions, buckets = self._versions(name), int(self._property(name, "buckets"))
        ids = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct().withColumn("bucket", _bucket(buckets))
        touched = {r.bucket for r in ids.select("bucket").distinct().collect()} & set(versions)
        old = self._data(name, {b: versions[b] for b in touched}).drop("version")
        self._write(name, old.join(ids.select("id"), "id", "left_anti"), versions, touched)

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows in place of all that the collection held."""
        self.get(name)
        buckets = int(self._property(name, "buckets"))
        self._write(name, rows.withColumn("bucket", _bucket(buckets)), self._versions(name), set(range(buckets)))

    def _write(self, name: str, rows: DataFrame, versions: dict[int, int], touched: set[int]) -> None:
        """rows as the new version of the touched buckets. Its number is new, so what a crashed run left is never read."""
        version = uuid.uuid4().int >> 65
        columns = ["id", "embedding", "document", "metadata", "bucket"]
        rows.select(*columns, F.lit(version).alias("version")).repartition("bucket").write.insertInto(f"{name}_data")
        self.spark.catalog.refreshTable(f"{name}_data")
        written = {r.bucket for r in self.spark.table(f"{name}_data").where(F.col("version") == version).select("bucket").distinct().collect()}
        new = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(written, version)
        self._point(name, new, self.metric(name), int(self._property(name, "buckets")))
        at = self.location(name)
        for b in touched & set(versions):
            files.delete(self.spark, f"{at}/bucket={b}/version={versions[b]}")
        self.spark.catalog.refreshTable(f"{name}_data")

    def location(self, name: str) -> str:
        return self.spark.sql(f"DESCRIBE TABLE EXTENDED `{name}_data`").where("col_name = 'Location'").first().data_type

    def info(self, name: str) -> DataFrame:
        return collection_info({name: self.get(name, create=False)})

    def status(self) -> DataFrame:
        """(collection_name, document_count) of every collection in the catalog."""
        names = [t.name for t in self.spark.catalog.listTables() if t.tableType == "VIEW" and self.spark.catalog.tableExists(f"{t.name}_data")]
        if not names:
            return self.spark.createDataFrame([], "collection_name string, document_count long")
        return collection_info({n: self.spark.table(n) for n in sorted(names)})

    def delete(self, name: str) -> bool:
        if not self.spark.catalog.tableExists(name):
            return False
        self.spark.sql(f"DROP VIEW `{name}`")
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}_data`")
        return True


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
