"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Each document is the set of its distinct 5-word shingles (64-bit hashes). Shingles have one
global order: those rare in the corpus first, by hash; those that a fixed-size count sketch
over all documents shows to be frequent last. With n shingles and threshold t, a set that
links with this one shares at least l of the first n - ceil(t n) + l shingles, for any l
(a multi-match prefix). Each document picks the l whose estimated cost is least: postings
read plus candidates to verify, at most postings / l of them. A pair becomes a candidate
only if it shares min(l, l') shingles of the min(l, l')-prefixes and if all it shares in the
prefixes, plus what can still follow them, could reach the threshold; it is then verified on
the whole sets. Any order and any choice of l gives complete results; the estimates only
steer cost.

No key is read by one task alone: what is asked of all postings of a shingle is aggregated before the shuffle where
the sketch shows it to be frequent, and joined back on salted keys; the pairs of one hub are salted likewise;
frequent shingles are compared in blocks of documents.

Documents with equal sets are first folded into one representative. Postings of a
frequent shingle are not paired with each other at once: in a few star rounds every posting
is paired with one hub, verified links are contracted into components, and only postings of
different components are paired in the last round. So a group of k near copies costs about
k pairs, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm._bytes import U64, chunks, shingle_sets
from lodestone.llm._spark import Stage, units, without_ids
from lodestone.llm.components import connected_components

#: Cells of the count sketch, and cells in one shuffled block of it.
CELLS, BLOCK = 1 << 20, 1 << 14
#: Largest multi-match level tried, and star rounds before all postings are paired.
MOST_MATCHES, STAR_ROUNDS = 12, 2
#: Postings beyond which a shingle is compared in blocks; documents in a block, and postings in one.
FREQUENT, DOCUMENTS, POSTINGS = 24, 256, 65_536
#: Rows of one shingle, or pairs of one document, that a task gets before they are dealt over salts; salts at most.
ROWS, SALTS = 1024, 4096
#: Hot keys that are broadcast with their number of salts or blocks (16 bytes each); beyond, the key is joined.
MOST_KEYS = 500_000


def _at_least(n: int, percent: int) -> int:
    """Least overlap that a set of n needs: ceil(percent / 100 * n), in integers."""
    return (percent * n + 99) // 100


def _count_cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        for rb in batches:
            for _, _, data, off in chunks(rb.column(0)):
                found = shingle_sets(data, off, k)
                if found:
                    cells += np.bincount((np.concatenate(found) >> U64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        blocks = cells.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        if len(full):
            yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([blocks[i].tobytes() for i in full], pa.binary())], ["block", "cells"])

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for rb in batches:
        for block, cells in zip(rb.column(0).to_pylist(), rb.column(1)):
            add = np.frombuffer(cells.as_buffer(), dtype=np.uint32).astype(np.uint64)
            total[block] = total[block] + add if block in total else add
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], ["block", "cells"])


def excess_levels(cells: np.ndarray) -> np.ndarray:
    """Per cell 0, or 1 + log2 of the count above what even spreading explains (mean + 6 deviations + 16)."""
    c = cells.astype(np.float64)
    mean = float(np.median(c))
    over = np.maximum(c - mean, 0)
    return np.where(over > 16 + 6 * np.sqrt(mean), 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def frequent_cells(texts: DataFrame, k: int) -> np.ndarray:
    """Frequency level of each sketch cell, over the shingles of all documents: CELLS bytes whatever the corpus."""
    parts = texts.mapInArrow(_count_cells(k), "block int, cells binary").repartition("block").mapInArrow(_sum_cells, "block int, cells binary")
    cells = np.zeros((CELLS // BLOCK, BLOCK), dtype=np.uint32)
    for row in parts.collect():  # 64 blocks of 64 KB at most
        cells[row.block] = np.frombuffer(row.cells, dtype=np.uint32)
    return excess_levels(cells.reshape(-1))


def choose_matches(estimate: np.ndarray, n: int, base: int, most: int) -> int:
    """The l in 1..most with the least estimated cost. estimate: candidates per shingle, in prefix order."""
    total = np.cumsum(estimate[: base + most - 1])[base - 1 :]
    level = np.arange(1, len(total) + 1)
    cost = level + total + total / level * (1 + n / 64)
    return int(np.argmin(cost)) + 1


def _prefixes(k: int, percent: int, levels):
    """One row per document: set size, fingerprints, chosen l, and the prefix shingles in order (8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        guess = np.where(level > 0, np.exp2(level.astype(np.float64) - 1), 0.0)
        for rb in batches:
            ids = rb.column(0)
            for i, j, data, off in chunks(rb.column(1)):
                rows: list[list] = [[], [], [], [], []]
                for s in shingle_sets(data, off, k):
                    n = len(s)
                    ell, prefix = 0, b""
                    if n:
                        cell = (s >> U64(44)).astype(np.int64)
                        lv = level[cell]
                        order = np.argsort(lv, kind="stable") if lv.any() else np.arange(n)
                        need = _at_least(n, percent)
                        base, most = n - need + 1, min(MOST_MATCHES, need)
                        ell = choose_matches(guess[cell[order[: base + most - 1]]], n, base, most)
                        prefix = s[order[: base + ell - 1]].tobytes()
                    for column, value in zip(rows, (n, int(s.sum(dtype=U64).astype(np.int64)), int(np.bitwise_xor.reduce(s * U64(0x9FB21C651E98DF25) ^ (s >> U64(29))).astype(np.int64)) if n else 0, ell, prefix)):
                        column.append(value)
                yield pa.record_batch([ids.slice(i, j - i), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())], ["doc_id", "n", "f1", "f2", "ell", "prefix"])

    return run


def _postings(percent: int, levels, often: bool):
    """Rows (token, salts, rep, n, ell, level, pos) from packed prefixes, of shingles that the sketch shows as frequent or of the others.

    salts: tasks over which the rows of this shingle are dealt. level: least l whose prefix holds it; pos: its place in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = np.exp2(np.maximum(levels.value.astype(np.float64) - 1, 0))
        salts = np.clip(np.ceil(guess / ROWS), 1, SALTS).astype(np.int32)
        for rb in batches:
            n, ell = rb.column(1).to_numpy(), rb.column(2).to_numpy()
            tokens = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in rb.column(3)]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            if not size.sum():
                continue
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            base = n - (percent * n + 99) // 100 + 1
            level = np.maximum(1, place - base[row] + 2)
            flat, rep = np.concatenate(tokens), rb.column(0).to_numpy()
            salt = salts[(flat.view(np.uint64) >> U64(44)).astype(np.int64)]
            mine = np.flatnonzero((salt > 1) == often)
            for i in range(0, len(mine), 200_000):
                at = mine[i : i + 200_000]
                r = row[at]
                columns = [flat[at], salt[at], rep[r], n[r].astype(np.int32), ell[r].astype(np.int32), level[at].astype(np.int32), place[at].astype(np.int32)]
                yield pa.record_batch([pa.array(x) for x in columns], ["token", "salts", "rep", "n", "ell", "level", "pos"])

    return run


def _wanted_sets(k: int, wanted):
    """(rep, set) of the documents whose id may be wanted; wanted: a broadcast bitmap of a fixed number of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, dtype=np.uint8)
        for rb in batches:
            ids = rb.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = _bit(ids, len(bits) * 8)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            kept = rb.filter(pa.array(hit.astype(bool)))
            for i, j, data, off in chunks(kept.column(1)):
                yield pa.record_batch([kept.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, off, k)], pa.binary())], ["rep", "shingles"])

    return run


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(24)).astype(np.int64) & (bits - 1)


BITS = 1 << 25


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the ids in this partition, as (block, 8 KB of bits) rows."""
    flags = np.zeros(BITS, dtype=bool)
    seen = False
    for rb in batches:
        flags[_bit(rb.column(0).to_numpy(), BITS)] = True
        seen = True
    if seen:
        packed = np.packbits(flags, bitorder="little").reshape(-1, 8192)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], ["block", "bits"])


def _or_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for rb in batches:
        for block, bits in zip(rb.column(0).to_pylist(), rb.column(1)):
            add = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
            total[block] = total[block] | add if block in total else add
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "bits"])


def _products(percent: int):
    """Per unit (key, first, second) the pairs that may reach the threshold, with their shared shingles of this key.

    A row is a document with its postings under the key; memory is that of the rows and of documents x documents.
    """

    def unit(rows: pa.Table) -> pa.RecordBatch | None:
        get = lambda name: rows.column(name).to_numpy().astype(np.int64)
        reps, n, ell, comp, cap, block = (get(c) for c in ("rep", "n", "ell", "comp", "cap", "block"))
        posts = rows.column("posts").combine_chunks()
        size = np.diff(posts.offsets.to_numpy())
        token, level, pos = (f.to_numpy(zero_copy_only=False) for f in posts.flatten().flatten())
        doc = np.repeat(np.arange(len(reps)), size)
        rest = (percent * n + 99) // 100 - ell
        spare = cap - rest - size  # prefix shingles that others have, under other keys
        first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        pick = lambda f, x: f(x[a][:, None], x[b][None, :])
        need, hits, strong, after = pick(np.minimum, ell), np.zeros((len(a), len(b)), dtype=np.int32), np.zeros((len(a), len(b)), dtype=np.int32), np.full((len(a), len(b)), 2**30, dtype=np.int64)
        by = np.argsort(token, kind="stable")
        cut = np.flatnonzero(np.diff(token[by])) + 1
        place = np.empty(len(reps), dtype=np.int64)
        place[b], in_b = np.arange(len(b)), block == second
        row = np.empty(len(reps), dtype=np.int64)
        row[a], in_a = np.arange(len(a)), block == first
        left = n[doc] - 1 - pos
        for same in np.split(by, cut):
            x, y = same[in_a[doc[same]]], same[in_b[doc[same]]]
            if len(x) and len(y):
                at_pair = np.ix_(row[doc[x]], place[doc[y]])
                hits[at_pair] += 1
                strong[at_pair] += np.maximum.outer(level[x], level[y]) <= need[at_pair]
                after[at_pair] = np.minimum(after[at_pair], np.minimum.outer(left[x], left[y]))
        sizes, ends = pick(np.add, n), pick(np.maximum, rest)
        most = np.minimum(hits + pick(np.minimum, spare) + np.minimum(after, ends), np.minimum(pick(np.maximum, cap), pick(np.minimum, n)))
        good = (hits > 0) & pick(np.not_equal, comp) & (100 * most >= percent * (sizes - most))
        i, j = np.nonzero(np.triu(good, 1) if first == second else good)
        if not len(i):
            return None
        x, y = a[i], b[j]
        columns = [np.minimum(reps[x], reps[y]), np.maximum(reps[x], reps[y]), hits[i, j], strong[i, j], need[i, j], sizes[i, j], after[i, j], ends[i, j]]
        return pa.record_batch([pa.array(c.astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(columns)], ["a", "b", "hits", "strong", "need", "sizes", "after", "rest"])

    return units(3, unit)


def _jaccard(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ok = []
            for x, y in zip(rb.column(2), rb.column(3)):
                u, v = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = np.intersect1d(u, v, assume_unique=True).size
                ok.append(bool(len(u) and len(v)) and 100 * both >= percent * (len(u) + len(v) - both))
            yield pa.record_batch([rb.column(0), rb.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def with_count(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the count of their key, 1 where counts (key, count) has none. Few counts are broadcast, so that a hot key stays spread."""
    if counts.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        counts = F.broadcast(counts)
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("salts = 1"), rows.where("salts > 1")


class _Join:
    def __init__(self, texts: DataFrame, k: int, percent: int):
        self.spark, self.texts, self.k, self.percent = texts.sparkSession, texts, k, percent
        self.stage = Stage(self.spark, "ngram-join")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) for candidate pairs (a, b), a the hub side."""
        stage, sc = self.stage, self.spark.sparkContext
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
        blocks = ids.mapInArrow(_bitmap, "block int, bits binary").repartition("block").mapInArrow(_or_blocks, "block int, bits binary").collect()
        bits = np.zeros((BITS // 8 // 8192, 8192), dtype=np.uint8)
        for row in blocks:  # 4 MB at most, whatever the number of documents
            bits[row.block] = np.frombuffer(row.bits, dtype=np.uint8)
        sets = self.texts.mapInArrow(_wanted_sets(self.k, sc.broadcast(bits.tobytes())), "rep long, shingles binary")
        ids = ids.distinct()
        sets = stage.save(sets.join(ids, "rep", "left_semi"), f"{name}-sets")
        # a hub's pairs are dealt over salts, with a copy of its set for each
        hot = stage.save(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > ROWS).select("a", F.ceil(F.col("n") / ROWS).cast("int").alias("salts")), f"{name}-hot")
        right = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
        right = with_count(right, hot, "a", "salts").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).drop("salts")
        left = with_count(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), hot, "a", "salts")
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        whole = right.join(left, ["a", "salt"]).select("a", "b", "x", "y")
        out = whole.mapInArrow(_jaccard(self.percent), "a long, b long, linked boolean")
        out = stage.save(out.groupBy("a", "b").agg(F.max("linked").alias("linked")), f"{name}-verified")
        stage.drop(f"{name}-sets", f"{name}-hot")
        return out

    def by_token(self, few: DataFrame, many: DataFrame, facts: dict) -> DataFrame:
        """Both with aggregates over all rows of their shingle; those of many, which have salts, are aggregated first and joined back."""
        window = Window.partitionBy("token")
        spread = many.groupBy("token", "salts").agg(*[f.alias(k) for k, f in facts.items()])
        spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        many = many.withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int")).join(spread, ["token", "salt"]).drop("salt")
        return few.withColumns({k: f.over(window) for k, f in facts.items()}).unionByName(many)

    def meeting(self, few: DataFrame, many: DataFrame) -> DataFrame:
        """Postings whose shingle is in a prefix of another component too, with cap.

        cap: the postings left of the document's prefix and all that follows it. Of two documents the one whose prefix
        ends first shares no more than its cap with the other, so a pair shares no more than the greater of the two.
        """
        by_rep = Window.partitionBy("rep", "n", "ell")
        rows = self.by_token(few, many, {"low": F.min("comp"), "high": F.max("comp")}).where("low <> high").drop("low", "high")
        return rows.withColumn("cap", (F.expr(f"({self.percent} * n + 99) div 100 - ell") + F.count("*").over(by_rep)).cast("int"))

    def facts(self) -> list:
        """Of one shared prefix shingle of a pair: whether it is a match, the matches needed, and what can still follow.

        Shingles that are shared but not in both prefixes come after all that are, in both orders. So there are at
        most as many as follow the last match on the shorter side (after), or the prefix that ends first (rest).
        """
        rest = f"greatest(({self.percent} * n + 99) div 100 - ell, ({self.percent} * n2 + 99) div 100 - ell2)"
        names = {"a": "least(rep, rep2)", "b": "greatest(rep, rep2)", "hits": "1", "strong": "int(greatest(level, level2) <= least(ell, ell2))", "need": "least(ell, ell2)", "sizes": "n + n2", "after": "least(n - 1 - pos, n2 - 1 - pos2)", "rest": rest}
        return [F.expr(f"cast({e} as {'long' if k in 'ab' else 'int'})").alias(k) for k, e in names.items()]

    def all_pairs(self, left: DataFrame, near, columns: tuple[str, ...]) -> DataFrame:
        """facts() of every pair of different components that shares a shingle.

        Shingles on up to FREQUENT postings are paired by a join. The others are gathered by their least
        document, which those of one group of copies have in common, and compared in blocks of documents,
        so that only pairs that can still reach the threshold leave the task.
        """
        left = self.stage.save(self.by_token(*_split(left), {"df": F.count("*"), "key": F.min("rep")}), "counted")
        rare = left.where(F.col("df") <= FREQUENT).drop("df", "key", "salts")
        other = rare.select("token", *[F.col(c).alias(f"{c}2") for c in columns])
        joined = rare.join(other, "token").where(F.col("comp") < F.col("comp2")).where(near).select(*self.facts())
        facts = ("rep", "n", "ell", "comp", "cap")
        often = left.where(F.col("df") > FREQUENT).groupBy("key", *facts).agg(F.collect_list(F.struct("token", "level", "pos")).alias("posts"))
        often = self.stage.save(often, "often")  # a row per document and key, which has no more postings than its prefix
        many = F.greatest(F.ceil(F.count("*") / DOCUMENTS), F.ceil(F.sum(F.size("posts")) / POSTINGS)).cast("int")
        size = self.stage.save(often.groupBy("key").agg(many.alias("many")).where("many > 1"), "blocks")
        often = with_count(often, size, "key", "many").withColumn("block", F.pmod(F.xxhash64("rep"), "many").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        dealt = often.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", *facts, "posts")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(parts, "key", "first", "second").sortWithinPartitions("key", "first", "second")
        return joined.unionByName(dealt.mapInArrow(_products(self.percent), "a long, b long, hits int, strong int, need int, sizes int, after int, rest int"))

    def repeated(self, sizes: DataFrame, reps: DataFrame) -> DataFrame | None:
        """(doc_id, rep) for each class of an id that has rows of different texts; None if there is no such id."""
        kinds = F.struct("n", "f1", "f2")
        ids = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.min(kinds).alias("low"), F.max(kinds).alias("high")).where("low <> high").select("doc_id")
        ids = self.stage.save(ids, "repeated-ids")
        if not ids.limit(1).count():
            return None
        classes = sizes.join(ids, "doc_id").join(reps.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select("doc_id", "rep").distinct()
        return self.stage.save(classes, "repeated")

    def components(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(sizes: one row per document with its fingerprints; members: component of each class; same: that of ids with different texts)."""
        stage, percent = self.stage, self.percent
        levels = self.spark.sparkContext.broadcast(frequent_cells(self.texts.select("text"), self.k))
        docs = stage.save(self.texts.mapInArrow(_prefixes(self.k, percent, levels), "doc_id long, n long, f1 long, f2 long, ell int, prefix binary"), "docs")
        sizes = docs.select("doc_id", "n", "f1", "f2")
        reps = docs.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("ell").alias("ell"), F.first("prefix").alias("prefix"))
        packed, schema = reps.select("rep", "n", "ell", "prefix"), "token long, salts int, rep long, n int, ell int, level int, pos int"
        rows = [packed.mapInArrow(_postings(percent, levels, often), schema).withColumn("comp", F.col("rep")) for often in (False, True)]
        shared = stage.save(self.meeting(*rows).drop("comp"), "shared")
        links, tried, labels = None, None, None
        same = self.repeated(sizes, reps)
        if same is not None:  # an id's texts are one document: its classes are linked by it
            links = same.withColumn("least", F.min("rep").over(Window.partitionBy("doc_id"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
            labels = stage.save(connected_components(links, stage, "cc-same"), "labels-same")
        for i in range(STAR_ROUNDS + 1):
            last = i == STAR_ROUNDS
            now = shared.withColumn("comp", F.col("rep"))
            if labels is not None:
                now = shared.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
            columns = ("rep", "n", "ell", "level", "pos", "comp", "cap")
            cap = "least(n, n2, greatest(cap, cap2))"
            near = F.expr(f"100 * {cap} >= {percent} * (n + n2 - {cap}) and comp <> comp2")
            if last:
                paired = self.all_pairs(stage.save(self.meeting(*_split(now)), "left"), near, columns)
            else:
                # one hub per shingle, the document with the fewest shingles of its own (the likely original of copies);
                # in later rounds that of another component
                order = F.struct(F.xxhash64("comp", F.lit(i)) if i else F.lit(0).cast("long"), -F.col("cap"), F.col("rep"))
                hub = F.min_by(F.struct(*columns), order)
                paired = self.by_token(*_split(now), {"hub": hub}).select("*", *[F.col(f"hub.{c}").alias(f"{c}2") for c in columns]).drop("hub").where(near)
                paired = paired.select(*self.facts())
            pairs = paired.groupBy("a", "b").agg(F.sum("strong").alias("strong"), F.min("need").alias("need"), F.max("sizes").alias("sizes"), (F.sum("hits") + F.least(F.min("after"), F.max("rest"))).alias("most"))
            pairs = pairs.where(f"strong >= need and 100 * most >= {percent} * (sizes - most)").select("a", "b")
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stage.save(pairs, f"pairs-{i}")
            found = pairs.count()
            if found:
                done = self.verified(pairs, f"round-{i}")
                tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
                new = done.where("linked").select("a", "b")
                links = new if links is None else links.unionByName(new)
                labels = stage.save(connected_components(links, stage, f"cc-{i}"), f"labels-{i}")
        if labels is None:
            labels = self.spark.createDataFrame([], "node long, component long")
        members = reps.select("n", "f1", "f2", "rep", "copies").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "f1", "f2", "copies", F.coalesce("component", "rep").alias("component"))
        if same is not None:
            same = same.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("same"))
        return sizes, members, same


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): one row per input row; component_id is the least id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their k-word shingle sets.
    A null or wordless text has no shingles and links with nothing: its component is its own id.
    Under k words the whole sequence is the one shingle. Rows with a null id keep their size, get a null
    component and link with nothing. Rows that repeat an id are each returned; they count as one
    document with the links of all its texts. Other columns are ignored. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes, members, same = _Join(texts, k, percent).components()
    members = Stage(docs.sparkSession, "ngram-join").save(members, "members")
    # a class of many copies is one key: such classes, one in ROWS documents at most, are broadcast while they are few
    key = ["n", "f1", "f2"]
    many = members.where(F.col("copies") > ROWS).drop("copies")
    if 0 < many.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        many, rest = F.broadcast(many), members.where(F.col("copies") <= ROWS).drop("copies")
        out = sizes.join(many, key).unionByName(sizes.join(many, key, "left_anti").join(rest, key, "left"))
    else:
        out = sizes.join(members.drop("copies"), key, "left")
    if same is not None:  # a wordless row of such an id is in no class
        out = out.join(same, "doc_id", "left").withColumn("component", F.coalesce("same", "component"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the document of the least id of each component. Rows with a null id stay; so do rows that repeat a kept id."""
    stage = Stage(docs.sparkSession, "near-duplicates")
    joined = ngram_jaccard_join(docs, id_col, text_col, k, percent)
    drop = stage.save(joined.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "drop")
    return without_ids(docs, drop, id_col)
