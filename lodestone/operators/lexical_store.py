"""A stored inverted index: top-k without reading the documents, statistics kept up to date by deltas.

An index is a folder of segments and a log. A segment is what one upsert or delete brought: the split texts by
document (forward), postings by term and shard of documents with their largest frequency and least length, the change
of every term's document frequency, of the number of documents and of their length, and the ids that it replaced or
removed in older segments. Nothing is ever rewritten; a numbered log entry names the segments, and readers take
the last entry, so a crash leaves the state before it. compact() makes one segment of all.

A search bounds each question's score in each shard by the shard's block maxima, scores the most promising shards, and
then only those whose bound reaches the k-th score found. Its result is that of lexical.bm25_search.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone import files
from lodestone.functions.ranking import by_score, keep_best, top_k
from lodestone.operators.lexical import B, GROUP, K1, MEETINGS, best_in_groups, question_terms, tokenised
from lodestone.saved import against_all, saved, small
from lodestone.session import ship

#: Documents of a shard, buckets of terms and of documents, shards scored first, terms named in a filter and shards broadcast at most.
SHARD, BUCKETS, FIRST, NAMED, PLACES = 256, 32, 3, 5000, 500_000
#: Values of a filter that Parquet takes one by one.
PUSHED = 10


def _bucket(c: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _weight(tf: Column, size: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl))


class LexicalStore:
    """The index in a folder that all executors share; create() starts an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> LexicalStore:
        store = cls(spark, path)
        files.write_new(spark, f"{store.path}/log/{0:08}", json.dumps({"segments": [], "shards": {}, "n": 0, "total": 0}))
        return store

    # ---- state ----

    def _last(self) -> tuple[int, dict]:
        entries = files.names(self.spark, f"{self.path}/log")
        if not entries:
            raise ValueError(f"no index in {self.path}")
        return int(entries[-1]), json.loads(files.read(self.spark, f"{self.path}/log/{entries[-1]}"))

    def _commit(self, number: int, state: dict) -> None:
        """The next log entry; if another writer was faster, FileExistsError, and nothing has changed."""
        files.write_new(self.spark, f"{self.path}/log/{number + 1:08}", json.dumps(state))

    def _read(self, segment: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment}/{table}")

    def _forward(self, segments: list[str]) -> DataFrame | None:
        """(part, doc_id, len, tokens) of the live documents."""
        return self._live(segments, lambda s: self._read(s, "forward", f"doc_id {self._kind(s)}, len int, tokens array<string>, part int"))

    def _kind(self, segment: str) -> str:
        return self.spark.read.parquet(f"{self.path}/{segment}/gone").schema["doc_id"].dataType.simpleString()

    def _gone(self, segments: list[str]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{s}/gone") for s in segments]
        return functools.reduce(DataFrame.unionByName, parts).distinct() if parts else None

    def _live(self, segments: list[str], rows) -> DataFrame | None:
        """Union of rows(segment) without the documents that later segments replaced."""
        out = None
        for i, s in enumerate(segments):
            if "forward" not in files.names(self.spark, f"{self.path}/{s}"):  # a delete
                continue
            one = rows(s)
            later = self._gone(segments[i + 1 :])
            if later is not None:
                one = one.join(small(later), "doc_id", "left_anti")
            out = one if out is None else out.unionByName(one)
        return out

    # ---- changes ----

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinal: str | None = None) -> None:
        """Adds documents and replaces those of the same id; the row of the highest ordinal wins within docs.

        Without an ordinal ids must not repeat within docs (ValueError). Rows with a null id are left out; a null text is an empty document.
        """
        rows = docs.where(F.col(id_col).isNotNull())
        if ordinal:
            rows = keep_best(rows, [id_col], F.col(ordinal).desc(), F.xxhash64(text_col))
        self._change(tokenised(rows, id_col, text_col), None)

    def delete(self, ids: DataFrame) -> None:
        """Removes the documents of the ids in the one column of ids; unknown ones are no error."""
        self._change(None, ids.select(F.col(ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct())

    def _change(self, words: DataFrame | None, removed: DataFrame | None) -> None:
        number, state = self._last()
        segment = f"segment-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{segment}"
        old = self._forward(state["segments"])
        if words is not None:
            words = words.select("doc_id", F.size("tokens").alias("len"), "tokens", _bucket(F.col("doc_id")).alias("part"))
            words.write.partitionBy("part").parquet(f"{at}/forward")
            words = self.spark.read.schema(words.schema).parquet(f"{at}/forward")
            n, ids, added = words.agg(F.count("*"), F.count_distinct("doc_id"), F.coalesce(F.sum("len"), F.lit(0))).first()
            if n != ids:
                files.delete(self.spark, at)
                raise ValueError("ids repeat: name the ordinal that says which row wins")
            changed = words.select("doc_id")
        else:
            n, added, changed = 0, 0, removed
        if old is None:
            replaced = None
            changed.limit(0).write.parquet(f"{at}/gone")
        else:
            # documents lie in parts by their id, so only the parts of the changed ones are read
            parts = [r.part for r in changed.select(_bucket(F.col("doc_id")).alias("part")).distinct().collect()]
            replaced = old.where(F.col("part").isin(parts)).join(small(changed.distinct()), "doc_id", "left_semi")
            replaced.select("doc_id").write.parquet(f"{at}/gone")
            # what is gone is read back below: the old rows of these ids
            lost, less = replaced.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            n, added = n - lost, added - less
        shards, deltas = dict(state["shards"]), []
        if words is not None:
            shards[segment] = self._postings(words, at)
            deltas.append(self._read(segment, "postings", "term string, n int, bucket int").select("term", "n"))
        if replaced is not None:
            deltas.append(replaced.select(F.explode(F.array_distinct("tokens")).alias("term"), F.lit(-1).alias("n")))
        deltas = functools.reduce(DataFrame.unionByName, deltas) if deltas else self.spark.createDataFrame([], "term string, n int")
        deltas = deltas.groupBy("term").agg(F.sum("n").cast("long").alias("n")).where("n <> 0").withColumn("bucket", _bucket(F.col("term")))
        deltas.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{at}/terms")
        self._commit(number, {"segments": [*state["segments"], segment], "shards": shards, "n": state["n"] + n, "total": state["total"] + added})

    def _postings(self, words: DataFrame, at: str) -> int:
        """Writes the postings of a segment; returns its number of shards."""
        shards = max(1, -(-words.count() // SHARD))
        # texts move to their shards once; a shard's terms are counted and gathered there, in one piece
        ship(self.spark)
        texts = words.select(_bucket(F.col("doc_id"), shards).alias("shard"), "doc_id", "len", "tokens")
        kind = words.schema["doc_id"].dataType.simpleString()
        blocks = texts.groupBy("shard").applyInArrow(_gathered, f"term string, shard int, tf int, len int, docs array<struct<doc_id: {kind}, tf: int, len: int>>")
        blocks = blocks.select("term", "shard", "tf", "len", F.size("docs").alias("n"), "docs", _bucket(F.col("term")).alias("bucket"))
        # each task writes its shards' part of every bucket
        blocks.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{at}/postings")
        return shards

    def compact(self) -> None:
        """One segment in place of all; the old ones' files go."""
        number, state = self._last()
        live = self._forward(state["segments"])
        if live is None:
            return
        segment = f"segment-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{segment}"
        live.write.partitionBy("part").parquet(f"{at}/forward")
        words = self.spark.read.schema(live.schema).parquet(f"{at}/forward")
        words.select("doc_id").limit(0).write.parquet(f"{at}/gone")
        self.terms_counted().withColumn("bucket", _bucket(F.col("term"))).withColumnRenamed("df", "n").repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{at}/terms")
        self._commit(number, state | {"segments": [segment], "shards": {segment: self._postings(words, at)}})
        for s in state["segments"]:
            files.delete(self.spark, f"{self.path}/{s}")

    # ---- reading ----

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        _, state = self._last()
        return state["n"], state["total"] / state["n"] if state["n"] else 0.0

    def terms_counted(self, only: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(term, df) of the terms of live documents; only: those in the column term of a small table."""
        _, state = self._last()
        parts = [self._read(s, "terms", "term string, n long, bucket int") for s in state["segments"]]
        if not parts:
            return self.spark.createDataFrame([], "term string, df long")
        every = _named(functools.reduce(DataFrame.unionByName, parts), None, buckets)
        if only is not None:
            every = every.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
        return every.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def terms(self, **only) -> DataFrame:
        """(term, df, idf) as a rebuilt index has them."""
        n, _ = self.stats()
        return self.terms_counted(**only).select("term", "df", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def docs(self) -> DataFrame:
        """(doc_id) of the live documents."""
        _, state = self._last()
        live = self._forward(state["segments"])
        return live.select("doc_id") if live is not None else self.spark.createDataFrame([], "doc_id long")

    def search(self, questions: DataFrame, k: int = 10, id_col: str = "query_id", text_col: str = "query", pruned: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score): the k best documents of each question, ties by id; the same as bm25_search.

        pruned: leave out shards that cannot reach the k-th score, which takes jobs of its own. Where questions and postings meet more
        than MEETINGS times, documents are scored in groups, and a group gives its best alone. Results are the same either way. The
        search itself runs when this is called: its hits are written, the plan that is returned ranks them.
        """
        _, state = self._last()
        n = state["n"]
        avgdl = state["total"] / n if n else 0.0
        asked = question_terms(questions, id_col, text_col).withColumn("bucket", _bucket(F.col("term")))
        rows = asked.limit(NAMED + 1).collect()
        named = None
        if len(rows) <= NAMED:
            asked, named = self.spark.createDataFrame(rows, asked.schema), sorted({r.term for r in rows})
        if not n or not rows:
            none = F.lit(None).cast(self._kind(state["segments"][0]) if state["segments"] else "long")
            found = asked.where("false").select("query_id", none.alias("doc_id"), F.lit(0.0).alias("score"))
            return self._ranked(found, questions.select(F.col(id_col).alias("query_id")), k)
        buckets = sorted({r.bucket for r in rows}) if named is not None else None
        weights = asked.join(self.terms(only=asked if named is not None else None, buckets=buckets), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"), "df")
        if named is not None:
            rows = weights.collect()
            weights, meets = F.broadcast(self.spark.createDataFrame(rows, weights.schema)), sum(r.df for r in rows)
        else:
            weights = saved(weights, "weights")
            meets = weights.agg(F.sum("df")).first()[0] or 0
        weights = weights.drop("df")
        grouped = meets > MEETINGS
        kind = self._kind(state["segments"][0])
        shape = f"term string, shard int, tf int, len int, docs array<struct<doc_id: {kind}, tf: int, len: int>>, bucket int"
        segments = [s for s in state["segments"] if "postings" in files.names(self.spark, f"{self.path}/{s}")]
        met = [_named(self._read(s, "postings", shape), named, buckets).withColumn("segment", F.lit(s)).join(weights, "term") for s in segments]

        def best(where: DataFrame | None) -> DataFrame:
            """Each question's k best above 0 in every group of shards, of all shards or of some (segment, shard)."""
            step = max(1, GROUP // SHARD)
            rows, gone = None, None
            terms = small(weights.select("term").distinct())
            for s in segments:
                one = _named(self._read(s, "postings", shape), named, buckets).join(terms, "term", "left_semi").withColumn("segment", F.lit(s))
                if where is not None:
                    one = one.join(small(where), ["segment", "shard"], "left_semi")
                one = one.select("segment", F.floor(F.col("shard") / step).alias("group"), "term", "docs")
                rows = one if rows is None else rows.unionByName(one)
                later = self._gone(state["segments"][state["segments"].index(s) + 1 :])
                if later is not None:
                    less = later.select(F.lit(s).alias("segment"), F.floor(_bucket(F.col("doc_id"), state["shards"][s]) / step).alias("group"), "doc_id")
                    gone = less if gone is None else gone.unionByName(less)
            return best_in_groups(rows, weights, k, avgdl, gone)

        def hits(where: DataFrame | None, few: bool, only: DataFrame | None = None) -> DataFrame:
            """Scores of the documents of all shards or of some (query_id, segment, shard); only: of some questions (query_id)."""
            out = None
            for s, one in zip(segments, met):
                if only is not None:
                    one = one.join(small(only), "query_id", "left_semi")
                if where is not None:
                    one = one.join(F.broadcast(where) if few else where, ["query_id", "segment", "shard"], "left_semi")
                each = one.select("query_id", "w", F.inline("docs"))
                later = self._gone(state["segments"][state["segments"].index(s) + 1 :])
                if later is not None:
                    each = each.join(small(later), "doc_id", "left_anti")
                out = each if out is None else out.unionByName(each)
            return out.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * _weight(F.col("tf"), F.col("len"), avgdl or 1.0)).alias("score"))

        if not met:
            found = asked.select("query_id", F.lit(None).cast(kind).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
        elif not pruned:
            found = saved(best(None) if grouped else hits(None, False), "hits")
        else:
            places = functools.reduce(DataFrame.unionByName, [m.select("query_id", "segment", "shard", "w", "tf", "len") for m in met])
            # the largest frequency in the least length bounds a positive term; a document may lack a negative one
            bound = F.sum(F.greatest(F.lit(0.0), F.col("w") * _weight(F.col("tf"), F.col("len"), avgdl or 1.0)))
            places = saved(places.groupBy("query_id", "segment", "shard").agg(bound.alias("bound")), "places")
            few = places.limit(PLACES + 1).count() <= PLACES
            first = top_k(places, FIRST, ["query_id"], F.desc("bound"), "segment", "shard").select("query_id", "segment", "shard")
            found = saved(hits(first, few), "first")
            least = top_k(found.where(F.round("score", 6) > 0), k, ["query_id"], F.desc("score")).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            left = places.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
            left = left.join(first, ["query_id", "segment", "shard"], "left_anti").select("query_id", "segment", "shard")
            if grouped:  # shards that some question needs
                found = saved(best(left.unionByName(first).select("segment", "shard").distinct()), "hits")
            else:
                found = saved(found.unionByName(hits(left, few)), "hits")
        return self._ranked(found, questions.select(F.col(id_col).alias("query_id")), k, (lambda only: hits(None, False, only)) if met and grouped else None)

    def _ranked(self, found: DataFrame, asked: DataFrame, k: int, every: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The k best; documents without a shared term score 0 and are only looked at for questions with fewer than k hits above 0.

        every: where found has none but the best hits, gives all of those questions.
        """
        full = found.where(F.round("score", 6) > 0).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = asked.distinct().join(full, "query_id", "left_anti")
        if short.limit(1).count():
            if every:
                short = saved(short, "short")
                found = found.join(small(short), "query_id", "left_anti").unionByName(saved(every(short), "short-hits"))
            rest = against_all(self.docs(), short).join(found, ["query_id", "doc_id"], "left_anti")
            found = found.unionByName(rest.select("query_id", "doc_id", F.lit(0.0).alias("score")))
        return top_k(found, k, ["query_id"], *by_score("score", "doc_id")).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _gathered(shard: pa.Table) -> pa.Table:
    """Postings of the documents (shard, doc_id, len, tokens) of one shard: a row a term, with its largest frequency, least length and documents."""
    tokens = shard.column("tokens").combine_chunks()
    # a slice of a longer array keeps its own offsets, so lengths are taken from the lists
    doc = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    coded = tokens.flatten().dictionary_encode()
    place, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(tokens)) + doc, return_counts=True)
    term, doc = np.divmod(place, max(1, len(tokens)))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    tf, size = tf.astype(np.int32), shard.column("len").to_numpy()[doc].astype(np.int32)
    docs = pa.StructArray.from_arrays([shard.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(size)], ["doc_id", "tf", "len"])
    most, least = (f.reduceat(x, starts) if len(starts) else x for f, x in ((np.maximum, tf), (np.minimum, size)))
    number = pa.array(np.full(len(starts), shard.column("shard")[0].as_py(), np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), docs)
    return pa.table([coded.dictionary, number, pa.array(most), pa.array(least), lists], ["term", "shard", "tf", "len", "docs"])


def _named(df: DataFrame, only: list[str] | None, buckets: list[int] | None) -> DataFrame:
    """Rows in the buckets, of the named terms where they are few enough to reach the scan; a join takes the rest."""
    if buckets is not None:
        df = df.where(F.col("bucket").isin(buckets))
    return df.where(F.col("term").isin(only)) if only is not None and len(only) <= PUSHED else df
