"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Features are presence of hashed token n-grams (one and two tokens) and of n-grams of token shapes (one to three), in
2**20 buckets. Follow-the-regularised-leader with an L1 term keeps only weights that pay for
themselves, so the model sent to the workers is the sparse rest, and a score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import U64, chunks
from lodestone.llm._spark import Stage
from lodestone.llm._terms import distinct_pairs, held_out, labelled_sample, shapes_and_ngrams
from lodestone.llm.toxicity import scores

#: Labelled rows that are fitted at most; buckets of the hash space (n-grams below, shapes above).
SAMPLE, BITS = 20_000, 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.5, 0.5, 2


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) and its value: 1 for a shape n-gram, 1 / sqrt(n-grams of the text) for an n-gram."""
    gram, gram_doc, shape, shape_doc = shapes_and_ngrams(data, off)
    shift = U64(64 - BITS)
    bucket = np.concatenate([(gram >> shift).astype(np.int64), (shape >> shift).astype(np.int64) + (1 << BITS)])
    doc, bucket = distinct_pairs(np.concatenate([gram_doc, shape_doc]), bucket)
    plain = bucket < 1 << BITS
    n = np.maximum(np.bincount(doc[plain], minlength=len(off) - 1), 1)
    return doc, bucket, np.where(plain, 1 / np.sqrt(n[doc]), 1.0)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """(bias, w) by FTRL-proximal, one row at a time. rows: buckets and values."""
    size = 2 << BITS
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = lambda z, n: np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    free = lambda z, n: -z / ((BETA + np.sqrt(n)) / ALPHA)  # noqa: E731  the bias isn't regularised
    for _ in range(epochs):
        for (bucket, x), label in zip(rows, y):
            nz, zz = n[bucket], z[bucket]
            w, b = weight(zz, nz), free(zb, nb)
            p = 1 / (1 + np.exp(-np.clip(b + w @ x, -30, 30)))
            g = (p - label) * x
            grown = nz + g * g
            z[bucket] = zz + g - (np.sqrt(grown) - np.sqrt(nz)) / ALPHA * w
            n[bucket] = grown
            gb = p - label
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * b
            nb += gb * gb
    return float(free(zb, nb)), weight(z, n)


class QualityModel:
    def __init__(self, bias: float, bucket: np.ndarray, w: np.ndarray):
        self.bias, self.bucket, self.w = bias, bucket, w
        self.dense: np.ndarray | None = None

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(2 << BITS, dtype=np.float32)
            self.dense[self.bucket] = self.w
        gram, gram_doc, shape, shape_doc = shapes_and_ngrams(data, off)
        shift, n = U64(64 - BITS), len(off) - 1
        z = np.full(n, self.bias)
        # each distinct bucket counts once; only those with a weight matter for the sum
        for hashes, doc, base, plain in ((gram, gram_doc, 0, True), (shape, shape_doc, 1 << BITS, False)):
            bucket = (hashes >> shift).astype(np.int64) + base
            hit = np.flatnonzero(self.dense[bucket])
            d, b = distinct_pairs(doc[hit], bucket[hit])
            s = np.bincount(d, weights=self.dense[b], minlength=n)
            if plain:
                rows = np.flatnonzero(s)
                if len(rows):
                    mine = np.isin(doc, rows)
                    size = np.bincount(distinct_pairs(doc[mine], bucket[mine])[0], minlength=n)
                    s[rows] /= np.sqrt(np.maximum(size[rows], 1))
            z += s
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def __getstate__(self):
        return self.bias, self.bucket, self.w

    def __setstate__(self, state):
        self.__init__(*state)


def train(docs: DataFrame, labels: DataFrame, stage: Stage, label: str = "quality", bound: int = SAMPLE) -> QualityModel:
    """The model fitted on the labelled rows outside the held-out fold (at most `bound`). Without any, every score is 0.5."""
    sample = labelled_sample(docs, labels, label, bound)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, off in chunks(rb.column(1)):
                doc, bucket, x = features(data, off)
                cut = np.searchsorted(doc, np.arange(1, j - i))
                yield pa.record_batch([rb.column(0).slice(i, j - i), rb.column(2).slice(i, j - i), pa.array([b.astype(np.int32).tobytes() for b in np.split(bucket, cut)], pa.binary()), pa.array([float(v[0]) if len(v) else 0.0 for v in np.split(x, cut)])], ["key", "y", "buckets", "scale"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, rows = [], []
        for rb in batches:
            y.extend(rb.column(1).to_pylist())
            for b, scale in zip(rb.column(2), rb.column(3).to_pylist()):
                bucket = np.frombuffer(b.as_buffer(), dtype=np.int32)
                rows.append((bucket, np.where(bucket < 1 << BITS, scale, 1.0)))
        if rows:
            bias, w = fit_ftrl(rows, np.array(y, dtype=np.float64))
            full = np.flatnonzero(w)
            yield pa.record_batch([pa.array([bias]), pa.array([full.astype(np.int32).tobytes()], pa.binary()), pa.array([w[full].astype(np.float32).tobytes()], pa.binary())], ["bias", "bucket", "w"])

    encoded = sample.select("key", "text", "y").mapInArrow(encode, "key long, y int, buckets binary, scale double").repartition(1).sortWithinPartitions("key", "buckets")
    model = encoded.mapInArrow(fit, "bias double, bucket binary, w binary").first()
    if model is None:
        return QualityModel(0.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return QualityModel(model.bias, np.frombuffer(model.bucket, np.int32), np.frombuffer(model.w, np.float32))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Learns from labels.quality (0 or 1; other values and unknown ids don't count, of repeated ids the highest label
    counts) outside the fold whose crc32 of the id as text divides by 5. A null or empty text has no features and
    gets the bias's score. A null id is scored, with held_out null. Repeated rows are returned each time;
    other columns of docs aren't read. Without labels every score is 0.5; no rows give no rows.
    """
    stage = Stage(docs.sparkSession, "quality")
    out = scores(docs, train(docs, labels, stage), stage, id_col, text_col)
    return out.select(id_col, held_out(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
