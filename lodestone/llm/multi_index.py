"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors are brought to one length by an extra component, so that the order of inner products is the order of cosines
("simple" reduction of maximum inner product search), centred, turned to their principal axes and by
iterative quantisation (Gong and Lazebnik, 2011); signs make the code. A code is cut into substrings, each indexed on its own
(Norouzi, Punjani and Fleet, "Fast Search in Hamming Space with Multi-Index Hashing", 2012): with m substrings,
a code within r = m * a + b bits differs by at most a bits in one of the first b + 1 substrings or by a - 1 in one
of the others. Probing those buckets therefore meets every code within the radius; the whole code is checked, a pair
counts only at the first substring that meets it, and what is left is reranked on the original vectors.

The radius is each query's own: the score that its k-th neighbour should have is read off a bounded sample, and the
sample says how many bits a pair of that score differs by. Queries that find fewer than k ask again, wider.

Equal vectors are one class with its least ids, searched once. The substrings' index is dealt by the first bits of a
substring's value; a query visits the places whose first bits are near enough; places with very many codes are split.
Only the best of each query leave a unit of work, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm._spark import Stage

#: The rotation and the radii are fitted on at most SAMPLE vectors and at most NUMBERS numbers of them, by the order of a hash.
SAMPLE, NUMBERS = 20_000, 4_000_000
#: Numbers of the vectors of a unit aimed at; pairs compared at a time.
UNIT, PAIRS = 1 << 20, 1 << 20
#: Bits of a code and of a substring; share of the neighbours at a score that its radius takes in.
BITS, WIDTH, SHARE = 128, 16, 0.98
#: Vectors of the sample that stand for queries when radii are fitted, turns of the iterative quantisation.
ASKING, TURNS = 500, 40


@dataclass
class Codes:
    """What the sample taught: scale, centre and rotation of the vectors, and the radius by score."""

    scale: float
    centre: np.ndarray
    rotation: np.ndarray
    scores: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    rank: int
    k: int

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Vectors as they stand in the index: within the unit ball and brought to its surface."""
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]])

    def asked(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])

    def lanes(self, z: np.ndarray) -> np.ndarray:
        """Substrings of the codes, one column each."""
        up = (z - self.centre) @ self.rotation > 0
        return np.packbits(up, axis=1, bitorder="little").view("<u2")

    def limits(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query its radius, from the score that is its `rank`-th best in the sample, and a score that 2k + 2 of the sample reach.

        What scores below that is no candidate for the k best, so it need not leave a unit of work.
        """
        radius, least = np.empty(len(z), dtype=np.int64), np.full(len(z), -np.inf)
        at, many = min(self.rank, len(self.sample) - 1), 2 * self.k + 2
        for i in range(0, len(z), 256):
            scores = -np.sort(-(z[i : i + 256] @ self.sample.T), axis=1)[:, : max(at + 1, many)]
            radius[i : i + 256] = self.radii[np.searchsorted(self.scores, scores[:, at], side="right") - 1]
            if scores.shape[1] >= many:
                least[i : i + 256] = scores[:, many - 1]
        return radius, least


def fit(sample: np.ndarray, scale: float, n: int, k: int, bits: int = BITS, share: float = SHARE, seed: int = 5) -> Codes:
    """Codes from the sample (rows) of n distinct vectors of length at most `scale`."""
    rng = np.random.default_rng(seed)
    codes = Codes(scale, np.zeros(0), np.zeros((0, 0)), np.full(1, -np.inf), np.full(1, bits), np.zeros((0, 0)), 0, k)
    z = codes.stored(sample)
    codes.centre = z.mean(axis=0)
    y = z - codes.centre
    _, axes = np.linalg.eigh(y.T @ y)
    axes = axes[:, ::-1][:, : min(bits, axes.shape[1])]
    y = y @ axes
    parts = []
    for _ in range(-(-bits // axes.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(y.T @ np.sign(y @ turn))
            turn = u @ v
        parts.append(axes @ turn)
    codes.rotation = np.hstack(parts)[:, :bits]
    codes.sample = z
    # the k-th of n stands at about this place in the sample; two standard deviations more, for luck
    place = k * min(1.0, len(sample) / max(n, 1))
    codes.rank = math.ceil(place + 2 * math.sqrt(place))
    some = rng.permutation(len(sample))[:ASKING]
    asked = codes.asked(sample[some])
    scores = asked @ z.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(codes.rank, len(sample) - 1)]
    if near.size:
        own, all_ = codes.lanes(asked), codes.lanes(z)
        bits_off = np.stack([np.bitwise_count(own[i][None, :] ^ all_[near[i]]).sum(axis=1) for i in range(len(some))]).ravel()
        score = np.take_along_axis(scores, near, axis=1).ravel()
        by = np.argsort(-score)
        score, bits_off = score[by], bits_off[by]
        cuts = np.linspace(0, len(score), min(24, 1 + len(score) // 60) + 1).astype(int)
        radii = np.maximum.accumulate([int(np.quantile(bits_off[a:b], share, method="higher")) for a, b in zip(cuts[:-1], cuts[1:])])
        # lower scores than any seen have no bound but the whole code
        codes.scores = np.concatenate([[-np.inf], score[cuts[1:] - 1][::-1]])
        codes.radii = np.concatenate([[bits], radii[::-1]])
    return codes


def thresholds(radius: np.ndarray, m: int) -> np.ndarray:
    """Bits that each substring may differ by, so that every code within the radius meets one of them (-1: not looked up)."""
    a, b = np.divmod(np.asarray(radius), m)
    return a[:, None] - (np.arange(m)[None, :] > b[:, None])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros behind the shorter ones, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _coder(codes: Codes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            x = _matrix(rb.column("embedding"), width)
            lanes = codes.lanes(codes.stored(x)).astype(np.int32)
            own = np.zeros_like(lanes)
            radius, least = np.zeros(len(x), dtype=np.int32), np.full(len(x), -np.inf)
            asks = np.flatnonzero(rb.column("asks").to_numpy(zero_copy_only=False))
            if len(asks):
                z = codes.asked(x[asks])
                own[asks] = codes.lanes(z)
                radius[asks], low = codes.limits(z)
                least[asks] = low * codes.scale * np.linalg.norm(x[asks], axis=1)  # as an inner product of the vectors themselves
            yield pa.record_batch([rb.column("class"), pa.array(list(lanes), pa.list_(pa.int32())), pa.array(list(own), pa.list_(pa.int32())), pa.array(radius), pa.array(least)], ["class", "lanes", "own", "radius", "least"])

    return run


class _Unit:
    """The codes of one place of one substring's index."""

    def __init__(self, lane: int, rows: list[pa.RecordBatch], width: int):
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if rows else None
        self.lane, self.n = lane, t.num_rows if t else 0
        if not self.n:
            return
        lanes = t.column("lanes").flatten().to_numpy().reshape(self.n, -1).astype(np.uint16)
        by = np.argsort(lanes[:, lane], kind="stable")
        self.lanes, self.x = lanes[by], _matrix(t.column("embedding"), width)[by]
        self.classes, self.low = t.column("class").to_numpy()[by], t.column("low").to_numpy()[by]
        self.values, self.first = np.unique(self.lanes[:, lane], return_index=True)
        self.size = np.diff(np.append(self.first, self.n))

    def search(self, rb: pa.RecordBatch, k: int, width: int) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        own = rb.column("lanes").flatten().to_numpy().reshape(rb.num_rows, -1).astype(np.uint16)
        radius, classes, least = (rb.column(c).to_numpy() for c in ("radius", "class", "least"))
        x = _matrix(rb.column("embedding"), width)
        limits = thresholds(radius, own.shape[1])
        step = max(1, PAIRS // self.n)
        for i in range(0, len(own), step):
            o, lim = own[i : i + step], limits[i : i + step]
            q, v = np.nonzero(np.bitwise_count(o[:, self.lane][:, None] ^ self.values[None, :]) <= lim[:, self.lane][:, None])
            size = self.size[v]
            q = np.repeat(q, size)
            c = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[v], size)
            off = np.bitwise_count(o[q] ^ self.lanes[c])
            fits = off.sum(axis=1) <= radius[i : i + step][q]
            q, c, off = q[fits], c[fits], off[fits]
            here = np.argmax(off <= lim[q], axis=1) == self.lane  # the first substring that meets this code
            q, c = q[here], c[here]
            score = np.einsum("ij,ij->i", x[i : i + step][q], self.x[c])
            good = score >= least[i : i + step][q] - 1e-9 * np.abs(least[i : i + step][q])
            q, c, score = q[good], c[good], score[good]
            by = np.lexsort((self.low[c], -score, q))
            q, c, score = q[by], c[by], score[by]
            start = np.searchsorted(q, q)
            best = np.arange(len(q)) - start <= k
            q, c, score = q[best], c[best], score[best]
            if len(q):
                yield pa.record_batch([pa.array(classes[i : i + step][q]), pa.array(self.classes[c]), pa.array(self.low[c]), pa.array(score)], ["class", "found", "low", "score"])


def _searcher(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, unit = None, [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            key = np.stack([rb.column(c).to_numpy() for c in ("lane", "place", "slice", "kind")], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:]):
                here, asks = tuple(key[a, :3].tolist()), key[a, 3]
                if here != at:
                    at, held, unit = here, [], None
                if not asks:
                    held.append(rb.slice(a, b - a))
                    continue
                if unit is None:
                    unit, held = _Unit(here[0], held, width), []
                yield from unit.search(rb.slice(a, b - a), k, width)

    return run


def _search(coded: DataFrame, asking: DataFrame, stage: Stage, name: str, n: int, k: int, width: int, bits: int) -> DataFrame:
    """(class, found, score) of the k + 1 best classes of each asking class (class, own, radius, least, embedding) within its radius."""
    m = bits // WIDTH
    parts = max(1, n * max(1, width) // UNIT)
    prefix = min(WIDTH, max(0, math.ceil(math.log2(parts))))
    most = 2 * max(1, UNIT // max(1, width))
    stored = coded.select("class", "lanes", "low", "embedding", F.posexplode("lanes").alias("lane", "value"))
    stored = stored.withColumn("place", F.shiftrightunsigned("value", WIDTH - prefix)).drop("value")
    full = stage.save(stored.groupBy("lane", "place").agg(F.ceil(F.count("*") / most).cast("int").alias("slices")).where("slices > 1"), f"full-{name}")
    stored = stored.join(full, ["lane", "place"], "left").withColumn("slice", F.pmod(F.xxhash64("class"), F.coalesce("slices", F.lit(1))).cast("int"))
    stored = stored.select("lane", "place", "slice", F.lit(0).alias("kind"), "class", "lanes", "low", "embedding", F.lit(0).alias("radius"), F.lit(0.0).alias("least"))
    limit = F.floor(F.col("radius") / m) - F.when(F.col("lane") > F.col("radius") % m, 1).otherwise(0)
    asks = asking.select("class", F.col("own").alias("lanes"), "embedding", "radius", "least", F.posexplode("own").alias("lane", "value"))
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << prefix) - 1)), lambda x: F.bit_count(x) <= limit)
    asks = asks.withColumn("change", F.explode(near)).withColumn("place", F.shiftrightunsigned("value", WIDTH - prefix).bitwiseXOR(F.col("change")))
    asks = asks.join(full, ["lane", "place"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    asks = asks.select("lane", "place", "slice", F.lit(1).alias("kind"), "class", "lanes", F.lit(0).cast("long").alias("low"), "embedding", "radius", "least")
    shuffled = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), m * parts)
    dealt = stored.unionByName(asks).repartition(shuffled, "lane", "place", "slice").sortWithinPartitions("lane", "place", "slice", "kind", "class")
    best = dealt.mapInArrow(_searcher(k, width), "class long, found long, low long, score double")
    order = Window.partitionBy("class").orderBy(F.desc("score"), "low", "found")
    return stage.save(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("class", "found", "score"), f"best-{name}")


def nearest_neighbours(vectors: DataFrame, asked: str, k: int = 20, radius: int | None = None, bits: int = BITS, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets the condition `asked`, the k rows found of largest inner product.

    The query's own id is no candidate; ranks count from 1, ties go to the smaller id; score is the inner product of the original vectors in
    double precision. All candidates come where there are no more than k. radius: a fixed Hamming radius in place of
    each query's own; at `bits` the search is exact. Null, empty and zero vectors, those with null or non-finite
    components and rows with a null id take no part, neither as queries nor as candidates; of vectors of different lengths the shorter
    counts as filled with zeros. Rows that repeat id and vector count once; an id with several
    vectors is as many candidates and, if asked, is answered for each of them. Other columns are read only if `asked` names
    them. No rows give no rows.
    """
    if bits % WIDTH:
        raise ValueError(f"bits must be a multiple of {WIDTH}")
    spark = vectors.sparkSession
    stage = Stage(spark, "multi-index")
    kind = vectors.schema[vector_col].dataType.simpleString()
    one = "float" if kind == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{one}>").alias("embedding"), F.coalesce(F.expr(asked), F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("embedding", F.expr(f"transform(embedding, v -> v + {one}(0))"))  # one sort of zero
    rows = stage.save(rows.groupBy("id", "embedding").agg(F.max("asks").alias("asks")).withColumn("hash", F.xxhash64("embedding")), "rows")
    same = Window.partitionBy("hash", "embedding").orderBy("id")
    heads = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("hash", "embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asking = rows.where("asks").select("hash", "embedding").distinct().withColumn("asks", F.lit(True))
    classes = heads.join(asking, ["hash", "embedding"], "left").select(F.monotonically_increasing_id().alias("class"), "hash", "embedding", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    classes = stage.save(classes, "classes")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    n, width, scale = classes.agg(F.count("*"), F.max(F.size("embedding")), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    if not math.isfinite(scale):
        raise ValueError("vectors are too long for inner products in double precision")
    some = classes.orderBy("hash", "class").limit(max(2, min(SAMPLE, NUMBERS // width))).select("embedding").toArrow()
    codes = fit(_matrix(some.column(0).combine_chunks(), width), scale or 1.0, n, k, bits, share)
    coded = classes.select("class", "embedding", "asks").mapInArrow(_coder(codes, width), "class long, lanes array<int>, own array<int>, radius int, least double")
    coded = stage.save(coded.join(classes.select("class", "embedding", "asks", F.col("ids")[0].alias("low")), "class"), "coded")
    asks = coded.where("asks")
    if radius is not None:  # then all within it count
        asks = asks.withColumns({"radius": F.lit(radius), "least": F.lit(float("-inf"))})
    left = asks.select("class", "own", "embedding", F.col("radius").cast("int").alias("radius"), "least")
    total, answered, i = rows.count(), None, 0
    while True:
        best = _search(coded, left, stage, str(i), n, k, width, bits)
        ids = best.join(classes.select(F.col("class").alias("found"), "ids"), "found").select("class", "score", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
        ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        answers = stage.save(ids.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("answers")), f"answers-{i}")
        whole = answers.where(F.size("answers") >= min(k + 1, total))
        answered = whole if answered is None else answered.unionByName(whole)
        # those that found too few ask again, wider; at the width of the code they meet all
        few = left.where(F.col("radius") < bits).join(whole, "class", "left_anti").select("class", "own", "embedding", F.least(F.lit(bits), F.col("radius") + F.greatest(F.lit(bits // 8), F.col("radius") / 2).cast("int")).alias("radius"), "least")
        few = stage.save(few, f"few-{i}")
        if radius is not None or not few.limit(1).count():
            answered = answered.unionByName(answers.join(whole.select("class"), "class", "left_anti"))
            break
        left, i = few, i + 1
    named = rows.where("asks").join(classes.select("class", "hash", "embedding"), ["hash", "embedding"]).select("id", "class").join(answered, "class")
    mine = F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("id")), 1, k)
    return named.select("id", F.posexplode(mine).alias("at", "a")).select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))
