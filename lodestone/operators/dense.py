"""Exact nearest neighbours by cosine: each Arrow batch of the corpus against the stated queries."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.functions.ranking import by_score, top_k
from lodestone.session import ship

#: Query vectors compared at a time, and bytes of them that are broadcast for one scan of the corpus.
BLOCK, MOST_BYTES = 1024, 256 << 20
#: Where all scores are asked for: how many of them a task makes at most, about, and how many leave it at a time.
TASK_SCORES, AT_A_TIME = 1 << 26, 1 << 16
#: From how many scores of a batch on these come by value, how many are put in order at a time, and into how many bins of value each half of -1 to 1 is divided.
BY_VALUE, IN_ORDER, HALF = 1 << 21, 1 << 21, 2048


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _slices(count: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of bins with IN_ORDER scores at most, or of one bin; those with most scores a bin first."""
    out, first, held = [], 0, 0
    for i, c in enumerate(count.tolist()):
        if held and held + c > IN_ORDER:
            out.append((held / (first - i), first, i))
            first, held = i, 0
        held += c
    out.append((held / (first - len(count)), first, len(count)))
    return [(a, b) for share, a, b in sorted(out) if share]


def _by_value(ids: np.ndarray, x: np.ndarray, mine: np.ndarray, unit: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """All scores of unit vectors, IN_ORDER of them in order at a time.

    A score's bin is told once and kept in two bytes, so each pair is in one slice alone however its score is rounded when it is made again.
    """
    bins, count, block = np.empty((len(x), len(mine)), dtype=np.uint16), np.zeros(2 * HALF + 1, dtype=np.int64), max(1, min(BLOCK, IN_ORDER // 16 // len(mine)))
    for a in range(0, len(x), block):
        at = np.nan_to_num((x[a : a + block] @ unit) * HALF + HALF, nan=0.0)
        bins[a : a + block] = np.clip(at, 0, 2 * HALF, out=at)
        count += np.bincount(bins[a : a + block].ravel(), minlength=len(count))
    for first, end in _slices(count):
        held, n = [], 0
        for a in range(0, len(x), block):
            found = np.flatnonzero(bins[a : a + block] - np.uint16(first) < end - first)
            if len(found):
                held.append(((found + a * len(mine)).astype(np.uint32), (x[a : a + block] @ unit).ravel()[found]))
                n += len(found)
            if held and (n >= IN_ORDER or a + block >= len(x)):
                pairs, score = (np.concatenate(c) for c in zip(*held))
                held, n, order = [], 0, np.argsort(score)
                for b in range(0, len(order), AT_A_TIME):
                    some = order[b : b + AT_A_TIME]
                    q, v = np.divmod(pairs[some], len(mine))
                    yield pa.record_batch([pa.array(ids[q]), pa.array(mine[v]), pa.array(score[some])], names)


def _scores(asked, k: int | None):
    """Per batch the rows (query_id, id, score), only a query's k best if k is given. asked: broadcast ids and unit vectors.

    Without k a file of them should hold little besides what tells them apart. Few come by id, then query: an id stands once for
    a block of queries, whose ids come in the same order each time, and the scores take eight bytes each. From BY_VALUE on, scores
    repeat at six decimals: they come by value, so that a value stands once for many pairs, and a pair takes the bits of its two ids.
    """
    names = ["query_id", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = asked.value
        for rb in batches:
            if not rb.num_rows:
                continue
            unit, mine = _unit(rb.column(1)).T, rb.column(0).to_numpy(zero_copy_only=False)
            if k is None and len(ids) * len(mine) >= BY_VALUE:
                step = max(1, TASK_SCORES // len(ids))
                for b in range(0, len(mine), step):
                    yield from _by_value(ids, x, mine[b : b + step], unit[:, b : b + step], names)
                continue
            for a in range(0, len(ids), BLOCK):
                some, scores = ids[a : a + BLOCK], x[a : a + BLOCK] @ unit
                if k is None:
                    step = max(1, AT_A_TIME // len(some))
                    for b in range(0, len(mine), step):
                        part = mine[b : b + step]
                        yield pa.record_batch([pa.array(np.tile(some, len(part))), pa.array(np.repeat(part, len(some))), pa.array(scores[:, b : b + step].T.ravel())], names)
                    continue
                for q, score in zip(some, scores):
                    order = np.lexsort((mine, -np.round(score, 6)))[:k]
                    yield pa.record_batch([pa.array(np.full(len(order), q)), pa.array(mine[order]), pa.array(score[order])], names)

    return run


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """x of at most a few units as Spark's round() gives it: halves of the written decimal away from zero."""
    at = x * 10.0**decimals
    whole = np.rint(at)
    for i in np.flatnonzero(np.abs(np.abs(at - whole) - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(x[i]))).scaleb(decimals).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 10.0**decimals + 0.0


def _with_rounded(scores: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], decimals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in scores(batches):
            yield rb.set_column(2, "score", pa.array(rounded(rb.column(2).to_numpy(), decimals)))

    return run


def in_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a stated query set (query_id long, vector), MOST_BYTES of them at a time; null and empty vectors are left out."""
    ids, vectors, size = [], [], 0
    for row in queries.where(F.size("vector") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
        ids.append(row.query_id)
        vectors.append(np.array(row.vector))
        size += vectors[-1].nbytes
        if size >= MOST_BYTES:
            yield np.array(ids, dtype=np.int64), _unit(pa.array(vectors, pa.list_(pa.float64())))
            ids, vectors, size = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), _unit(pa.array(vectors, pa.list_(pa.float64())))


def vector_scores(corpus: DataFrame, queries: DataFrame, k: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", decimals: int | None = None) -> DataFrame:
    """(query_id, id, score) of a stated query set (query_id long, vector) against all rows of one vector length.

    Rows with a null or empty vector are left out. The queries are broadcast, MOST_BYTES of them for each scan of the
    corpus. With k, each batch keeps a query's k best, so no more than batches x queries x k rows are shuffled. Without k
    there are rows x queries scores, and the rows are dealt to as many tasks as these ask for, however few files hold them:
    a power of two to a task, or a few less, as a file's ids take whole bits. With decimals, the scores are rounded as round() does.
    """
    spark = corpus.sparkSession
    ship(spark)
    rows = corpus.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    schema = "query_id long, id long, score double"
    n = rows.count() if k is None else 0
    parts = []
    for block in in_blocks(queries):
        tasks, cores = math.ceil(1.02 * n / 2 ** int(math.log2(max(1, TASK_SCORES / len(block[0]))))), spark.sparkContext.defaultParallelism
        dealt = rows.repartition(math.ceil(tasks / cores) * cores) if tasks > 1 else rows
        scores = _scores(spark.sparkContext.broadcast(block), k)
        parts.append(dealt.mapInArrow(scores if decimals is None else _with_rounded(scores, decimals), schema))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def dense_search(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine, ties by id."""
    found = top_k(vector_scores(corpus, queries, k, id_col, vector_col), k, ["query_id"], *by_score("score", "id"))
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def mean_vectors(vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, pos, value): element-wise mean of each key's vectors over its length; a zero mean stays zero."""
    each = vectors.select(key, F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "v"))
    mean = each.groupBy(key, "pos").agg(F.avg("v").alias("v"))
    size = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return mean.join(size, key).select(key, "pos", F.when(F.col("size") > 0, F.col("v") / F.col("size")).otherwise(F.col("v")).alias("value"))
