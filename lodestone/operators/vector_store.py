"""A stored vector index: cells around learned centres, codes of what is left, exact re-rank.

Centres are learned over the cluster by Lloyd's rounds on unit vectors. Each vector lies in the cell of its nearest centre,
as a code of one byte a component of its difference from the centre, with a bound of the code's error, and beside it whole. A query
looks through the cells nearest to it: codes give every score with its bound, what can't be among the k best of a
batch is left out, and the rest is scored on the whole vectors. In exact mode a second look goes to the
cells whose angle allows a better neighbour than the k-th found, so the result is that of dense.dense_search.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import files
from lodestone.functions.ranking import by_score, top_k
from lodestone.operators import dense
from lodestone.saved import saved
from lodestone.session import ship

#: Vectors of a cell aimed at, rounds of learning, vectors that centres are learned on, cells a query looks through first.
CELL, ROUNDS, LEARNED, PROBES = 256, 6, 500_000, 8
#: Scores are compared at six decimals.
SLACK = 2e-6


def _nearest(centres: np.ndarray):
    """(cell, angle, score) of unit vectors."""

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ centres.T
            cell[i : i + 4096] = s.argmax(axis=1)
            best[i : i + 4096] = s.max(axis=1)
        return cell, best

    return of


def _sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
        nearest = _nearest(centres)
        for rb in batches:
            if rb.num_rows:
                x = dense._unit(rb.column(1))
                cell, _ = nearest(x)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64())), pa.array(n[at])], ["cell", "total", "n"])

    return run


def learn_centres(rows: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of (id, vector): each round sums the vectors of a cell on the cluster; an emptied cell keeps its centre."""
    first = rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").toArrow().column(0).combine_chunks()
    centres = dense._unit(first)
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centres), "cell long, total array<double>, n long")
        each = sums.select("cell", F.posexplode("total").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v"))
        new = centres.copy()
        for r in each.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v")).toLocalIterator():
            v = np.array(r.v)
            if np.linalg.norm(v) > 0:
                new[r.cell] = v / np.linalg.norm(v)
        if np.abs(new - centres).max() < 1e-4:
            break
        centres = new
    return centres


def _coded(centres: np.ndarray):
    """(cell, id, code, scale, error, angle, vector) of (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _nearest(centres)
        for rb in batches:
            if not rb.num_rows:
                continue
            x = dense._unit(rb.column(1))
            cell, cos = nearest(x)
            left = x - centres[cell]
            scale = np.abs(left).max(axis=1) / 127
            scale[scale == 0] = 1.0
            code = np.rint(left / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(left - code * scale[:, None], axis=1)
            angle = np.where(np.abs(x).sum(axis=1) > 0, np.arccos(np.clip(cos, -1, 1)), math.pi)  # a zero vector is near to nothing
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.record_batch([pa.array(cell), rb.column(0), codes, pa.array(scale), pa.array(error), pa.array(angle), rb.column(1)], ["cell", "id", "code", "scale", "error", "angle", "vector"])

    return run


def _asked_by_cell(where: np.ndarray, cells: np.ndarray) -> dict[int, np.ndarray]:
    """Which queries ask for a cell, from where (queries x cells): a bit a query, as an exact search asks for most cells with most queries."""
    return {int(cells[c]): np.packbits(where[:, c]) for c in np.flatnonzero(where.any(axis=0))}


def _looked(centres: np.ndarray, asked, k: int):
    """(query_id, cell, id) that may be among a query's k best. asked: broadcast (ids, unit vectors, which of them by cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = asked.value
        for rb in batches:
            if not rb.num_rows:
                continue
            cells = rb.column("cell").to_numpy()
            code = np.frombuffer(b"".join(rb.column("code").to_pylist()), dtype=np.int8).reshape(rb.num_rows, -1)
            mine, scale, error = (rb.column(c).to_numpy() for c in ("id", "scale", "error"))
            for cell in np.unique(cells).tolist():
                if cell not in by_cell:
                    continue
                rows, who = np.flatnonzero(cells == cell), np.flatnonzero(np.unpackbits(by_cell[cell], count=len(ids)))
                about = centres[cell] + code[rows] * scale[rows][:, None]
                for a in range(0, len(who), dense.BLOCK):
                    some = who[a : a + dense.BLOCK]
                    score = q[some] @ about.T
                    least = score - error[rows]
                    at = max(0, len(rows) - k)
                    bar = np.partition(least, at, axis=1)[:, at][:, None] if len(rows) > k else -np.inf
                    w, v = np.nonzero(score + error[rows] >= bar - SLACK)
                    yield pa.record_batch([pa.array(ids[some][w]), pa.array(np.full(len(w), cell)), pa.array(mine[rows][v])], ["query_id", "cell", "id"])

    return run


class VectorStore:
    """The index in a folder that all executors share; build() makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, spark: SparkSession, path: str, corpus: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, learned: int = LEARNED) -> VectorStore:
        """Index of corpus; rows with a null or empty vector or a null id are left out, vectors must be of one length.

        Centres are learned on at most `learned` vectors, by the order of a hash of their ids; all vectors are indexed.
        """
        ship(spark)
        store = cls(spark, path)
        rows = corpus.where((F.size(vector_col) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        n = rows.count()
        cells = min(cells or max(1, round(n / CELL)), max(1, n))
        some = rows if n <= learned else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < math.ceil(1_000_003 * learned / n))
        centres = learn_centres(some, cells) if n else np.zeros((0, 1))
        kind = rows.schema["vector"].dataType.simpleString()
        if n:
            coded = rows.mapInArrow(_coded(centres), f"cell long, id long, code binary, scale double, error double, angle double, vector {kind}")
            # a large cell is written by several tasks
            coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (1 << 22))))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{store.path}/cells")
            stats = spark.read.parquet(f"{store.path}/cells").groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
            known = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "cell long, centre array<double>")
            known.join(stats, "cell").coalesce(1).write.parquet(f"{store.path}/centres")
        files.write_new(spark, f"{store.path}/done", json.dumps({"n": n, "cells": cells, "vector": kind}))
        return store

    def _cells(self) -> DataFrame:
        kind = json.loads(files.read(self.spark, f"{self.path}/done"))["vector"]
        return self.spark.read.schema(f"id long, code binary, scale double, error double, angle double, vector {kind}, cell long").parquet(f"{self.path}/cells")

    def share(self, part: float) -> int:
        """Number of probes that looks through that part of the cells."""
        return max(1, math.ceil(part * json.loads(files.read(self.spark, f"{self.path}/done"))["cells"]))

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query_id, rank, id, score): the k nearest by cosine of each stated query (query_id long, vector), ties by id.

        probes: cells that each query looks through. exact: go on to every cell that may hold a better neighbour; the result is
        then that of dense_search. The looks run when this is called.
        """
        found, _ = self.looked_through(queries, k, probes, exact)
        return top_k(found, k, ["query_id"], *by_score("score", "id")).select("query_id", "rank", "id", F.round("score", 6).alias("score"))

    def looked_through(self, queries: DataFrame, k: int, probes: int, exact: bool) -> tuple[DataFrame, DataFrame]:
        """((query_id, id, score) found, (query_id, looked): vectors of the cells that each query looked through)."""
        if not json.loads(files.read(self.spark, f"{self.path}/done"))["n"]:
            none = self.spark.createDataFrame([], "query_id long, id long, score double, looked long")
            return none.select("query_id", "id", "score"), none.select("query_id", "looked")
        known = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # a row a cell, fixed when the index was built
        cells, centres = np.array([r.cell for r in known]), np.array([r.centre for r in known])
        angles, sizes = np.array([r.angle for r in known]), np.array([r.n for r in known])
        every = np.zeros((int(cells.max()) + 1, centres.shape[1]))
        every[cells] = centres
        parts, counts = [], []
        for ids, q in dense.in_blocks(queries):
            near = np.arccos(np.clip(q @ centres.T, -1, 1))
            zero = np.abs(q).sum(axis=1) == 0
            # no vector of a cell is nearer than this
            bound = np.where(zero[:, None], 0.0, np.cos(np.maximum(0, near - angles[None, :])))
            first = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(first, np.argsort(near, axis=1, kind="stable")[:, :probes], True, axis=1)
            found = saved(self._look(ids, q, first, cells, every, k), "looked")
            if exact:
                bar = {r.query_id: r.score for r in top_k(found, k, ["query_id"], F.desc("score"), "id").where(F.col("rank") == k).select("query_id", "score").toLocalIterator()}
                least = np.array([bar.get(i, -2.0) for i in ids.tolist()])
                more = ~first & (bound >= least[:, None] - SLACK)
                if more.any():
                    found = found.unionByName(saved(self._look(ids, q, more, cells, every, k), "looked"))
                first |= more
            parts.append(found)
            counts.append(self.spark.createDataFrame(list(zip(ids.tolist(), (first @ sizes).tolist())), "query_id long, looked long"))
        if not parts:
            none = self.spark.createDataFrame([], "query_id long, id long, score double, looked long")
            return none.select("query_id", "id", "score"), none.select("query_id", "looked")
        return functools.reduce(DataFrame.unionByName, parts), functools.reduce(DataFrame.unionByName, counts)

    def _look(self, ids: np.ndarray, q: np.ndarray, where: np.ndarray, cells: np.ndarray, centres: np.ndarray, k: int) -> DataFrame:
        """Exact scores of what the codes leave of the given cells."""
        by_cell = _asked_by_cell(where, cells)
        asked = self.spark.sparkContext.broadcast((ids, q, by_cell))
        rows = self._cells().where(F.col("cell").isin(list(by_cell))) if len(by_cell) < len(cells) else self._cells()
        left = rows.select("cell", "id", "code", "scale", "error").mapInArrow(_looked(centres, asked, k), "query_id long, cell long, id long")
        whole = rows.select("cell", "id", "vector")
        joined = left.join(whole, ["cell", "id"])
        return joined.mapInArrow(_scored(asked), "query_id long, id long, score double")


def _scored(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, _ = asked.value
        at = {i: k for k, i in enumerate(ids.tolist())}
        for rb in batches:
            if rb.num_rows:
                x = dense._unit(rb.column(rb.schema.get_field_index("vector")))
                who = np.array([at[i] for i in rb.column(rb.schema.get_field_index("query_id")).to_pylist()])
                score = np.einsum("ij,ij->i", q[who], x)
                yield pa.record_batch([rb.column(rb.schema.get_field_index("query_id")), rb.column(rb.schema.get_field_index("id")), pa.array(score)], ["query_id", "id", "score"])

    return run
