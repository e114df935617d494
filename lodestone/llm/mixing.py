"""Mixing sources to target weights with soft membership.

A classifier over hashed words, counted on the rows of a labelled table, gives every document a posterior over domains: the
share of its words that each domain accounts for, fitted as a mixture of the domains' word distributions by a few
rounds of expectation-maximisation from the prior. So a document of two domains is a member of both, however long. With n_i tokens and posterior p_i, document rates r_i >= 0 are fitted so that the expected tokens of
domain d, sum_i r_i n_i p_id, match target d, by projected-gradient least squares from r = 1: r_i becomes
max(0, r_i - p_i . g), g being the residual times the inverse of the active documents' second moments (the
metric that makes a step exact until the projection bites), or, where such a step doesn't lower the miss, the residual
over the largest eigenvalue of all documents' second moments, which always does. Every step is one
aggregation over the documents; the driver keeps only the g of each step, from which
any task recomputes its rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.llm._bytes import U64, chunks, words
from lodestone.llm._spark import Stage

#: Labelled rows counted at most, hash buckets of words, steps at most, and the relative miss that ends them.
SAMPLE, BITS, STEPS, CLOSE = 20_000, 14, 40, 1e-6
#: Count added to every word of a domain, rounds of the mixture, and the words of prior that steady it.
ALPHA, ROUNDS, STEADY = 0.1, 8, 0.25
#: Domains at most: the model and a step's sums hold DOMAINS ** 2 numbers.
DOMAINS = 256


def _histogram(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every word, and the words of each document."""
    hashes, _, _, first = words(data, off)
    size = np.diff(first)
    return (hashes >> U64(64 - BITS)).astype(np.int64), np.repeat(np.arange(len(size)), size), size


class DomainModel:
    """Word distributions of the domains. counts: domain x bucket; rows: labelled rows of each domain."""

    def __init__(self, names: list[str], counts: np.ndarray, rows: np.ndarray):
        self.names = names
        chance = (counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * counts.shape[1])
        self.like = chance / chance.max(axis=0)
        self.prior = (rows + 1) / (rows.sum() + len(rows))

    def posterior(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of each document, posteriors documents x domains); without words the prior."""
        bucket, doc, size = _histogram(data, off)
        share = np.tile(self.prior, (len(off) - 1, 1))
        for _ in range(ROUNDS):
            parts = [share[doc, d] * like[bucket] for d, like in enumerate(self.like)]
            total = np.sum(parts, axis=0)
            new = np.stack([np.bincount(doc, weights=part / total, minlength=len(share)) for part in parts], axis=1)
            share = (new + STEADY * self.prior) / (size[:, None] + STEADY)
        return size, share


def train(docs: DataFrame, labelled: DataFrame, stage: Stage, id_col: str, text_col: str, bound: int = SAMPLE) -> DomainModel | None:
    """labelled: (id, domain). At most `bound` rows, by the order of a hash of their ids, are joined by broadcast and counted."""
    ids = labelled.where("domain is not null").groupBy("id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("domain", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rb in batches:
            domain = np.array(rb.column(0).to_pylist(), dtype=object)
            for i, j, data, off in chunks(rb.column(1)):
                bucket, doc, _ = _histogram(data, off)
                for name in set(domain[i:j]):
                    mine = domain[i:j] == name
                    add = np.append(np.bincount(bucket[mine[doc]], minlength=1 << BITS), mine.sum())
                    sums[name] = sums[name] + add if name in sums else add
        names = sorted(sums)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([sums[x].astype(np.int64).tobytes() for x in names], pa.binary())], ["domain", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in texts.mapInArrow(count, "domain string, counts binary").toLocalIterator():  # at most domains x tasks that read the sample
        add = np.frombuffer(row.counts, dtype=np.int64)
        total[row.domain] = total[row.domain] + add if row.domain in total else add
    if len(total) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    names = sorted(total)
    if not names:
        return None
    counts = np.stack([total[x] for x in names]).astype(np.float64)
    return DomainModel(names, counts[:, :-1], counts[:, -1])


def _rates(p: np.ndarray, history: np.ndarray) -> np.ndarray:
    r = np.ones(len(p))
    for g in history:
        r = np.maximum(0.0, r - p @ g)
    return r


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_rates(members: DataFrame, targets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(g of each step, relative miss) for members (n_tokens, posterior) and target tokens per domain."""
    width = len(targets)
    context = members.sparkSession.sparkContext

    def sums(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast(history)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, second = np.zeros(width), np.zeros((width, width))
            for rb in batches:
                n, p = rb.column(0).to_numpy().astype(np.float64), _matrix(rb.column(1), width)
                r = _rates(p, shared.value)
                total += (r * n) @ p
                active = (n * (r > 0))[:, None] * p
                second += active.T @ p
            values = np.concatenate([total, second.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

        out = np.zeros(width + width * width)
        for row in members.select("n_tokens", "posterior").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[row.i] = row.v
        return out[:width], out[width:].reshape(width, width)

    history = np.zeros((0, width))
    scale = max(1.0, float(np.linalg.norm(targets)))
    total, second = sums(history)
    steepest = 1 / max(float(np.linalg.eigvalsh(second)[-1]), 1e-300)  # of all documents: all rates begin at 1
    miss = float(np.linalg.norm(total - targets)) / scale
    exact = True
    for _ in range(steps):
        if miss < CLOSE:
            break
        step = np.linalg.pinv(second, rcond=1e-9, hermitian=True) @ (total - targets) if exact else steepest * (total - targets)
        tried = np.vstack([history, step])
        new_total, new_second = sums(tried)
        new_miss = float(np.linalg.norm(new_total - targets)) / scale
        if new_miss < miss * (1 - 1e-9):
            history, total, second, miss, exact = tried, new_total, new_second, new_miss, exact or len(tried) % 4 == 0
        elif exact:
            exact = False
        else:
            break
    return history, miss


def members(docs: DataFrame, model: DomainModel, stage: Stage, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, posterior) of every row, written to the shared folder: each step reads it again."""
    shared = stage.spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, off in chunks(rb.column(1)):
                size, p = shared.value.posterior(data, off)
                yield pa.record_batch([rb.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))], [id_col, "n_tokens", "posterior"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return stage.save(rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, posterior array<double>"), "members")


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], stage: Stage, id_col: str, text_col: str, scale: float) -> tuple[DomainModel, DataFrame, np.ndarray] | None:
    """The model, its members table and the g of each step; None without labelled rows."""
    model = train(docs, labelled, stage, id_col, text_col)
    if model is None:
        return None
    rows = members(docs, model, stage, id_col, text_col)
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in model.names])
    if share.sum() <= 0:
        raise ValueError("no known domain has a target weight")
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    return model, rows, fit_rates(rows, share / share.sum() * tokens * scale)[0]


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", scale: float = 1.0) -> DataFrame:
    """(id, n_tokens, domain, posterior, rate) for each row of docs.

    labelled: columns (id, domain). weights: target share of each domain, normalised; a domain left out gets 0.
    The rates' expected tokens sum to `scale` times the tokens of docs, shared out by the weights. Where no rates >= 0
    give that (a domain of weight 0 that every document has a share of), STEPS descent steps from equal rates are taken:
    the best fit itself would be many copies of the few purest documents. n_tokens: words; domain: the likeliest (the first of equals); posterior: of `domain`; rate: expected copies.
    A null or empty text has no words, the prior as its posterior and a rate like any other, which moves no tokens.
    Null ids and repeated rows are kept, each with its rate. Other columns aren't read. Without labelled rows no domain
    is known: domain and posterior are null and every rate is `scale`. No rows give no rows.
    """
    stage = Stage(docs.sparkSession, "mixing")
    fitted = fit(docs, labelled, weights, stage, id_col, text_col, scale)
    if fitted is None:
        one = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        return docs.select(F.col(id_col), one.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(float(scale)).alias("rate"))
    model, rows, history = fitted
    shared, names = stage.spark.sparkContext.broadcast(history), model.names

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            p = _matrix(rb.column(2), len(names))
            best = p.argmax(axis=1)
            yield pa.record_batch([rb.column(0), rb.column(1), pa.array([names[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(_rates(p, shared.value))], [id_col, "n_tokens", "domain", "posterior", "rate"])

    return rows.mapInArrow(rate, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, domain string, posterior double, rate double")


def with_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", scale: float = 1.0) -> DataFrame:
    """docs with columns mix_domain, mix_rate and mix_copies; columns of these names are replaced.

    mix_copies: the rate as whole copies, its fraction rounded up for that share of ids by a hash of id and text.
    """
    docs = docs.drop("mix_domain", "mix_rate", "mix_copies")
    stage = Stage(docs.sparkSession, "mixing")
    fitted = fit(docs, labelled, weights, stage, id_col, text_col, scale)
    if fitted is None:
        out = docs.withColumn("mix_domain", F.lit(None).cast("string")).withColumn("mix_rate", F.lit(float(scale)))
    else:
        model, _, history = fitted
        shared, at = stage.spark.sparkContext.broadcast((model, history)), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, history = shared.value
            for rb in batches:
                for i, j, data, off in chunks(rb.column(at)):
                    _, p = model.posterior(data, off)
                    part = rb.slice(i, j - i)
                    yield pa.record_batch([*part.columns, pa.array([model.names[b] for b in p.argmax(axis=1)], pa.string()), pa.array(_rates(p, history))], [*part.schema.names, "mix_domain", "mix_rate"])

        out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("mix_domain", T.StringType()), T.StructField("mix_rate", T.DoubleType())]))
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return out.withColumn("mix_copies", (F.floor("mix_rate") + (part < F.col("mix_rate") - F.floor("mix_rate")).cast("long")).cast("long"))
