"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, distributed components.

Two unit vectors at angle a get the same bit from a random hyperplane with probability 1 - a / pi, so pairs at the
cosine threshold share a whole b-bit signature in at least one of T tables with a chosen probability. b follows the
number of vectors, T follows from b and that probability; nothing is dropped. Equal vectors are first folded into
one with a count. A bucket is cut into blocks, and every pair of blocks is one unit of work, so a large bucket
spreads over many tasks and no task holds more than two blocks. A unit compares all its pairs
exactly, counts a pair only in the first table where it meets, and emits one row per vector,
never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._spark import Stage, units
from lodestone.llm.components import connected_components

#: Chance that a pair right at the threshold meets in some table; vectors per bucket aimed at; vectors in a block.
FOUND, AIM, BLOCK = 0.998, 64, 1024


def plan_tables(n: int, least: float, found: float = FOUND) -> tuple[int, int]:
    """(bits, tables) for n vectors and a cosine threshold; for a chance of 1, no bits: one bucket, in which all are compared."""
    if found >= 1:
        return 0, 1
    bits = min(30, max(6, round(math.log2(max(n, 1) / AIM)))) if n > AIM else 6
    same = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(1 - found) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _signatures(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for rb in batches:
            size = rb.column(3).to_numpy()
            signs = np.zeros((rb.num_rows, tables), dtype=np.int64)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, bits * tables))
                up = _matrix(rb.column(2).take(pa.array(rows))) @ planes[d] > 0
                signs[rows] = up.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
            yield pa.record_batch([*rb.columns, pa.array(list(signs), pa.list_(pa.int64()))], [*rb.schema.names, "signs"])

    return run


def _compare(least: float):
    """One row (key, n, root) per vector that links with another of its unit: links first met here, least key linked to."""

    def unit(keys: np.ndarray, copies: np.ndarray, x: np.ndarray, signs: np.ndarray, block: np.ndarray, t: int, first: int, second: int):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        a, b = (np.flatnonzero(block == first), np.flatnonzero(block == second))
        close = x[a] @ x[b].T >= least
        if first == second:
            np.fill_diagonal(close, False)
        if not close.any():
            return None
        met = (signs[a][:, None, :t] == signs[b][None, :, :t]).any(axis=2)
        new = close & ~met
        n = np.zeros(len(keys), dtype=np.int64)
        n[a] += new @ copies[b]
        if first != second:
            n[b] += new.T @ copies[a]
        root, big = keys.copy(), np.iinfo(np.int64).max
        while True:
            before = root.copy()
            root[a] = np.minimum(root[a], np.where(close, root[b][None, :], big).min(axis=1))
            root[b] = np.minimum(root[b], np.where(close, root[a][:, None], big).min(axis=0))
            if (root == before).all():
                break
        keep = np.flatnonzero((n > 0) | (root != keys))
        return keys[keep], n[keep], root[keep]

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        get = lambda name: rows.column(name).to_numpy()
        found = unit(get("key"), get("copies"), _matrix(rows.column("embedding").combine_chunks()), _matrix(rows.column("signs").combine_chunks()).astype(np.int64), get("block"), get("t")[0], get("first")[0], get("second")[0])
        return pa.record_batch([pa.array(c) for c in found], ["key", "n", "root"]) if found else None

    return units(4, work)


def near_duplicate_embeddings(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11, found: float = FOUND) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Only rows with equal labels are compared, by cosine in double precision; a null label, a null, empty or zero
    vector and one with null or non-finite components link with nothing, nor do vectors of different
    lengths. n_links: other rows linked directly, copies included; component_id: least id reachable by links; kept:
    whether that is the row itself. Pairs below `least` are never linked; one at it is found with probability
    `found` at least; with 1 all vectors of a label are compared, in blocks, and no link is lost. A row with a null id links with nothing and has a null component and kept. Rows that
    repeat an id are each returned and count as linked with each other if their vectors are. Other columns aren't
    read. No rows give no rows.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "embeddings")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    fine = "id is not null and label is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(embedding, v -> v <> 0)"
    rows = stage.save(rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False))), "rows")
    classes = rows.where("fine").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stage.save(classes.withColumn("size", F.size("embedding")).withColumn("key", F.xxhash64("label", "embedding")), "classes")
    bits, tables = plan_tables(classes.count(), least, found)
    signed = classes.select("key", "copies", "embedding", "size", F.xxhash64("label").alias("group"), "label").drop("label").mapInArrow(_signatures(bits, tables, seed), "key long, copies long, embedding array<double>, size int, group long, signs array<long>")
    signed = stage.save(signed, "signed")
    # a unit's key holds no vector until it is known to have two
    at = signed.select("key", F.posexplode("signs").alias("t", "sign"), "group", "size").select("key", "t", F.xxhash64("group", "size", "sign").alias("bucket"))
    sizes = at.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = at.join(sizes, ["t", "bucket"]).withColumn("many", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), "many").cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select(F.col("t").cast("long").alias("t"), "bucket", F.least("block", "other").cast("long").alias("first"), F.greatest("block", "other").cast("long").alias("second"), F.col("block").cast("long").alias("block"), "key")
    full = dealt.join(signed.select("key", "copies", "embedding", "signs"), "key").select("t", "bucket", "first", "second", "block", "key", "copies", "embedding", "signs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = full.repartition(parts, "t", "bucket", "first", "second").sortWithinPartitions("t", "bucket", "first", "second").mapInArrow(_compare(least), "key long, n long, root long")
    links = stage.save(links, "found")
    stage.drop("signed")
    counts = links.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), stage)
    known = classes.select("label", "embedding", "key", "rep", "copies").join(counts, "key", "left").join(parts.select(F.col("node").alias("key"), F.col("component").alias("centre")), "key", "left")
    known = stage.save(known.withColumn("centre", F.coalesce("centre", "key")), "known")
    least_id = known.groupBy("centre").agg(F.min("rep").alias("component"))
    known = known.join(least_id, "centre").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component", F.lit(True).alias("fine"))
    out = rows.join(known, ["label", "embedding", "fine"], "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
