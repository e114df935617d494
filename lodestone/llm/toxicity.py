"""Toxicity: a second-order factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms present in a text (whole words and their
first characters, as 64-bit hashes). The pair term learns what a linear weight cannot, such as a
mild insult that turns toxic beside the mention of a group. Terms are those of the labelled
sample that differ between its labels (chi-square with Yates's correction, at one in a thousand), however many, counted over the cluster; the weights are fitted by AdaGrad on mini-batches in one task,
whose input is bounded by the sample; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import U64, chunks
from lodestone.llm._spark import Stage
from lodestone.llm._terms import distinct_pairs, held_out, labelled_sample, words_and_prefixes

#: Labelled rows that are fitted at most, and the least chi-square of a term (one degree of freedom, p = 0.001).
SAMPLE, CHI_SQUARE = 20_000, 10.83
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 12, 64, 0.1, 1e-4
_FILTER = 1 << 22


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, positive documents) of this partition's sample rows."""
    for rb in batches:
        y_all = rb.column(1).to_numpy().astype(np.int64)
        for i, j, data, off in chunks(rb.column(0)):
            term, doc = words_and_prefixes(data, off)
            doc, term = distinct_pairs(doc, term)
            distinct, at = np.unique(term, return_inverse=True)
            n = np.bincount(at, minlength=len(distinct))
            pos = np.bincount(at, weights=y_all[i:j][doc], minlength=len(distinct)).astype(np.int64)
            yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(n), pa.array(pos)], ["term", "n", "pos"])


class Terms:
    """The model's terms by hash, with a bitmap that rejects most others at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.view(np.uint64))
        self.maybe = np.zeros(_FILTER, dtype=bool)
        self.maybe[(self.hashes >> U64(42)).astype(np.int64)] = True

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, term number) of the texts."""
        term, doc = words_and_prefixes(data, off)
        hit = np.flatnonzero(self.maybe[(term >> U64(42)).astype(np.int64)])
        term, doc = term[hit], doc[hit]
        if not len(self.hashes):
            return doc[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.hashes, term), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == term)
        return distinct_pairs(doc[hit], at[hit])


def fm_logits(doc: np.ndarray, term: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Raw scores of n documents from their distinct (document, term) pairs."""
    out = bias + np.bincount(doc, weights=w[term], minlength=n)
    for f in range(v.shape[1]):
        x = v[term, f]
        s = np.bincount(doc, weights=x, minlength=n)
        out += 0.5 * (s * s - np.bincount(doc, weights=x * x, minlength=n))
    return out


def fit_fm(rows: list[np.ndarray], y: np.ndarray, terms: int, factors: int = FACTORS, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, w, v) by AdaGrad on the logistic loss with weight decay. rows: term numbers of each document."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(terms), rng.normal(0, 0.02, (terms, factors))
    gw, gv, bias, gb = np.full(terms, 1e-6), np.full((terms, factors), 1e-6), 0.0, 1e-6
    sizes = np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            n = len(batch)
            doc, term = np.repeat(np.arange(n), sizes[batch]), np.concatenate([rows[i] for i in batch]).astype(np.int64)
            z = fm_logits(doc, term, n, bias, w, v)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            gb += err.mean() ** 2
            bias -= RATE * err.mean() / np.sqrt(gb)
            if not len(term):
                continue
            used, at = np.unique(term, return_inverse=True)
            g = np.bincount(at, weights=err[doc]) / n + DECAY * w[used]
            gw[used] += g * g
            step = RATE * g / np.sqrt(gw[used])
            for f in range(factors):
                x = v[term, f]
                s = np.bincount(doc, weights=x, minlength=n)
                h = np.bincount(at, weights=err[doc] * (s[doc] - x)) / n + DECAY * v[used, f]
                gv[used, f] += h * h
                v[used, f] -= RATE * h / np.sqrt(gv[used, f])
            w[used] -= step
    return bias, w, v


class ToxicityModel:
    """Terms and weights; score() gives one probability per text."""

    def __init__(self, hashes: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = Terms(hashes), bias, w, v

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = fm_logits(*self.terms.find(data, off), len(off) - 1, self.bias, self.w, self.v)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, stage: Stage, label: str = "toxic", bound: int = SAMPLE, least: float = CHI_SQUARE) -> ToxicityModel:
    """The model fitted on the labelled rows outside the held-out fold (at most `bound`). Without any, every score is 0.5."""
    sc = stage.spark.sparkContext
    sample = stage.save(labelled_sample(docs, labels, label, bound), "sample")
    size = sample.agg(F.count("*"), F.sum("y")).first()
    n, pos = size[0], size[1] or 0
    counts = sample.select("text", "y").mapInArrow(_counts, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    expect = F.col("n") * F.lit(pos / max(n, 1))
    chi = F.greatest(F.abs(F.col("pos") - expect) - 0.5, F.lit(0.0)) ** 2 / (expect * F.lit(max(1 - pos / max(n, 1), 1e-9)) * (1 - F.col("n") / F.lit(max(n, 1) + 1.0)) + 1e-9)
    best = counts.where(chi >= least).select("term").toArrow()  # no more than the sample has
    hashes = np.sort(best.column(0).to_numpy().astype(np.int64).view(np.uint64))
    known = sc.broadcast(Terms(hashes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, off in chunks(rb.column(1)):
                doc, term = known.value.find(data, off)
                cut = np.searchsorted(doc, np.arange(1, j - i))
                yield pa.record_batch([rb.column(0).slice(i, j - i), rb.column(2).slice(i, j - i), pa.array([x.astype(np.int32).tobytes() for x in np.split(term, cut)], pa.binary())], ["key", "y", "terms"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, rows = [], []
        for rb in batches:
            y.extend(rb.column(1).to_pylist())
            rows.extend(np.frombuffer(x.as_buffer(), dtype=np.int32) for x in rb.column(2))
        if rows:
            bias, w, v = fit_fm(rows, np.array(y, dtype=np.float64), len(known.value.hashes))
            yield pa.record_batch([pa.array([bias]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["bias", "w", "v"])

    encoded = sample.select("key", "text", "y").mapInArrow(encode, "key long, y int, terms binary").repartition(1).sortWithinPartitions("key", "terms")
    model = encoded.mapInArrow(fit, "bias double, w binary, v binary").first()
    stage.drop("sample")
    if model is None:
        return ToxicityModel(hashes[:0], 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    return ToxicityModel(hashes, model.bias, np.frombuffer(model.w), np.frombuffer(model.v).reshape(-1, FACTORS))


def scores(docs: DataFrame, model, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row by a model with score(bytes, offsets)."""
    shared = stage.spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, off in chunks(rb.column(1)):
                yield pa.record_batch([rb.column(0).slice(i, j - i), pa.array(shared.value.score(data, off))], [id_col, "score"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Learns from labels.toxic (0 or 1; other values and unknown ids don't count, of repeated ids the highest label
    counts) outside the fold whose crc32 of the id as text divides by 5. A null or empty text has no terms and gets
    the bias's score. A null id is scored, with held_out null. Repeated rows are returned each time; other
    columns of docs aren't read. Without labels every score is 0.5; no rows give no rows.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    out = scores(docs, train(docs, labels, stage), stage, id_col, text_col)
    return out.select(id_col, held_out(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `cut`."""
    stage = Stage(docs.sparkSession, "toxicity")
    shared = stage.spark.sparkContext.broadcast(train(docs, labels, stage))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keep = [shared.value.score(data, off) < cut for _, _, data, off in chunks(rb.column(at))]
            if keep:
                yield rb.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
