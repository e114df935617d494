"""Queries over the test tables, one per operator, and the same in SQL.

Plans that search run the search when the query is called: its hits are written, and the DataFrame ranks them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import ranking, text as T, vectors as V
from lodestone.operators import answers, chunking, collections, dense, evaluation, fusion, images, lexical, pixels, rerank, segmentation, similarity
from lodestone.plans import index, search
from lodestone.operators.lexical_store import LexicalStore
from lodestone.operators.vector_store import VectorStore
from lodestone.saved import against_all, saved, tables_dir
from lodestone.sources import readers
from lodestone.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def questions(t: Tables) -> DataFrame:
    """The stated query set: every twentieth benchmark item, whole text, with the vector of the same number."""
    q = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


def asked_vectors(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def stored(t: Tables) -> LexicalStore:
    """The stored index of the documents: split once, for all queries of this application."""
    return index.lexical_index(t.spark, f"{t.sf_dir}/documents.parquet")


def bm25(t: Tables, k: int = 10) -> DataFrame:
    return stored(t).search(questions(t), k)


def candidates(t: Tables) -> DataFrame:
    """A few rows a question, which several operators read: computed once."""
    return saved(search.with_content(bm25(t), questions(t), t.documents), "candidates")


# ---- SQL shared by several queries ----

def toks(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}))"


RAW = "regexp_extract_all(lower(@), '[\\p{L}\\p{N}_]+')"
BM25 = f"""
    q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 20 = 0),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({toks('query')}) AS term FROM q) GROUP BY ALL),
    d AS (SELECT doc_id, {toks('text')} AS tokens, len({toks('text')}) AS dl FROM documents),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
    tdf AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    h AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
          FROM p JOIN qt USING (term) JOIN tdf USING (term), st GROUP BY ALL),
    full_scores AS (SELECT query_id, d.doc_id, coalesce(s, 0.0) AS score FROM q CROSS JOIN d LEFT JOIN h USING (query_id, doc_id)),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM full_scores) WHERE rank <= {{k}})
"""


def bm25_sql(k: int) -> str:
    return BM25.replace("{k}", str(k))


VECTORS = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
    sims AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score, a.label AS ql, b.label AS label FROM v a, v b WHERE a.vec_id % 20 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sims)
"""
CANDIDATES = f"WITH {bm25_sql(10)}, c AS (SELECT query_id, query, doc_id, text AS content, round(score, 6) AS score, rank FROM top JOIN q USING (query_id) JOIN documents USING (doc_id))"


# ---- lexical ----

@query(f"SELECT lang, count(*) AS docs, sum(len({toks('text')})) AS tokens, round(avg(len({toks('text')})), 6) AS average, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def tokenize_stats(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.withColumn("n", F.size(T.tokens(F.col("text"))))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("average"), F.count_distinct("text").alias("texts"))


@query(f"WITH d AS (SELECT doc_id, unnest(list_distinct({toks('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, count(*) AS df FROM d GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS idf FROM t, n")
def bm25_terms(spark, sf_dir):
    return lexical.term_statistics(Tables(spark, sf_dir).documents).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {bm25_sql(10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM top")
def bm25_topk(spark, sf_dir):
    return bm25(Tables(spark, sf_dir))


@query(SQL["bm25_topk"])
def bm25_scan_topk(spark, sf_dir):
    """Without a stored index: texts are read and split for these questions."""
    t = Tables(spark, sf_dir)
    return lexical.bm25_search(t.documents, questions(t), 10)


@query(SQL["bm25_topk"])
def bm25_pruned_topk(spark, sf_dir):
    """Shards are bounded first, and those that can't reach the k-th score left out."""
    t = Tables(spark, sf_dir)
    return stored(t).search(questions(t), 10, pruned=True)


#: What upserts and deletes leave of the documents, as a table of the same name for the SQL of an index.
CHANGED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' amended' ELSE text END AS text FROM documents WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND doc_id % 7 <> 0"


def changed_index(t: Tables) -> LexicalStore:
    """An index of two thirds of the documents, then a fifth of all of them amended, then a seventh deleted."""
    d = t.documents.select("doc_id", "text")

    def build(path: str) -> None:
        store = LexicalStore.create(t.spark, path)
        store.upsert(d.where("doc_id % 3 <> 0"))
        store.upsert(d.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" amended"))))
        store.delete(d.where("doc_id % 7 = 0"))

    return LexicalStore(t.spark, index.kept(t.spark, "changed", f"{t.sf_dir}/documents.parquet", build))


@query(f"WITH documents AS ({CHANGED}), d AS (SELECT doc_id, unnest(list_distinct({toks('text')})) AS term FROM documents), n AS (SELECT count(*) AS n, avg(len({toks('text')})) AS avgdl FROM documents), t AS (SELECT term, count(*) AS df FROM d GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS idf, n AS documents, round(avgdl, 6) AS avgdl FROM t, n")
def bm25_incremental_terms(spark, sf_dir):
    store = changed_index(Tables(spark, sf_dir))
    n, avgdl = store.stats()
    return store.terms().select("term", "df", F.round("idf", 6).alias("idf"), F.lit(n).cast("bigint").alias("documents"), F.round(F.lit(avgdl), 6).alias("avgdl"))


@query(f"WITH documents AS ({CHANGED}), {bm25_sql(10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM top")
def bm25_incremental_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return changed_index(t).search(questions(t), 10)


@query(f"WITH {bm25_sql(10)} SELECT query_id, doc_id, round(score, 6) AS score FROM full_scores")
def bm25_full_scores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    q = questions(t)
    index = lexical.build_index(t.documents, only_terms=lexical.question_terms(q))
    return lexical.bm25_scores(index, q).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query()
def segmented_terms(spark, sf_dir):
    """The conversations without their spaces, cut by a model of all documents' words: how often each word comes out. The best path has no SQL form; tests hold it against a plain one."""
    t = Tables(spark, sf_dir)
    runs = t.conversations.select(F.regexp_replace("text", r"\s+", "").alias("text"))
    return segmentation.word_counts(runs, segmentation.word_model(t.documents))


# ---- dense ----

@query(f"WITH {VECTORS} SELECT query_id, rank, id, round(score, 6) AS score FROM near WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dense.dense_search(t.embeddings, asked_vectors(t), 10)


def stored_vectors(t: Tables) -> VectorStore:
    return index.vector_index(t.spark, f"{t.sf_dir}/embeddings.parquet")


@query(SQL["dense_topk"])
def ann_topk(spark, sf_dir):
    """By the stored cells, going on until no cell can hold a better neighbour."""
    t = Tables(spark, sf_dir)
    return stored_vectors(t).search(asked_vectors(t), 10, exact=True)


@query()
def ann_probed(spark, sf_dir):
    """By the stored cells nearest to each query alone, three quarters of them: approximate, so without SQL; looked: vectors whose codes a query read."""
    t = Tables(spark, sf_dir)
    store = stored_vectors(t)
    found, looked = store.looked_through(asked_vectors(t), 10, store.share(0.75), False)
    return ranking.top_k(found, 10, ["query_id"], *ranking.by_score("score", "id")).join(looked, "query_id").select("query_id", "rank", "id", F.round("score", 6).alias("score"), "looked")


@query(f"WITH {VECTORS} SELECT query_id, id, round(score, 6) AS similarity FROM sims")
def similarity_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dense.vector_scores(t.embeddings, asked_vectors(t), decimals=6).withColumnRenamed("score", "similarity")


@query(f"WITH {VECTORS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM sims WHERE id <> query_id) SELECT query_id, id, round(score, 6) AS score FROM b WHERE r = 1")
def argmax_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ranking.keep_best(dense.vector_scores(t.embeddings, asked_vectors(t), 2).where("id <> query_id"), ["query_id"], *ranking.by_score("score", "id")).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS}, f AS (SELECT query_id, (min(r) FILTER (WHERE label = ql))::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM sims WHERE id <> query_id) GROUP BY query_id) SELECT round(avg(coalesce(rank <= 1, false)::INT), 6) AS recall_1, round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_10 FROM f")
def recall_at_k(spark, sf_dir):
    t = Tables(spark, sf_dir)
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    # the ten nearest others decide all cut-offs; a query may be among its own eleven
    scores = dense.dense_search(t.embeddings, asked_vectors(t), 11).where("id <> query_id")
    known = scores.join(labels, "id").join(labels.toDF("query_id", "asked"), "query_id")
    return evaluation.recall_at(evaluation.first_ranks(known.withColumn("relevant", F.col("label") == F.col("asked"))))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS v FROM e GROUP BY ALL) SELECT label, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) + 0.0 AS value FROM m")
def agg_embedding(spark, sf_dir):
    return dense.mean_vectors(Tables(spark, sf_dir).embeddings, "label").select("label", F.col("pos").cast("bigint").alias("pos"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("WITH x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS s FROM embeddings), w AS (SELECT *, min(s) OVER (PARTITION BY label) AS lo, max(s) OVER (PARTITION BY label) AS hi FROM x) SELECT vec_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END, 6) AS norm, round(CASE WHEN hi = lo THEN s ELSE (s - lo) / (hi - lo + 1e-8) END, 6) AS norm_or_same FROM w")
def minmax_norm(spark, sf_dir):
    x = Tables(spark, sf_dir).embeddings.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("s"))
    return x.select("vec_id", F.round(ranking.min_max(F.col("s"), ["label"]), 6).alias("norm"), F.round(ranking.min_max_or_same(F.col("s"), ["label"]), 6).alias("norm_or_same"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(sqrt(list_dot_product(u, u)), 6) AS unit_norm FROM (SELECT vec_id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v)")
def vector_norms(spark, sf_dir):
    return Tables(spark, sf_dir).embeddings.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(V.unit(F.col("embedding"))), 6).alias("unit_norm"))


# ---- hybrid and rerank ----

HYBRID = f"""
    WITH {bm25_sql(20)}, {VECTORS.replace('v AS (SELECT vec_id', 'v AS (SELECT vec_id', 1).replace('WHERE a.vec_id % 20 = 0', 'WHERE a.vec_id IN (SELECT query_id FROM q) AND b.vec_id IN (SELECT doc_id FROM documents)')},
    dn AS (SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM near WHERE rank <= 20),
    sp AS (SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top),
    dn2 AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * 0.7 AS s FROM dn WINDOW w AS (PARTITION BY query_id)),
    sp2 AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * 0.3 AS s FROM sp WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, doc_id, coalesce(dn2.s, 0.0) + coalesce(sp2.s, 0.0) AS score, dn2.rank AS dr, sp2.rank AS sr FROM dn2 FULL JOIN sp2 USING (query_id, doc_id)),
    merged AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM f)
"""


def hybrid(t: Tables, **options) -> DataFrame:
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id").join(t.documents.select("doc_id"), "doc_id", "left_semi")
    return search.hybrid_search(t.documents, vectors, questions(t), index=stored(t), **options)


@query(HYBRID + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM merged WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    return hybrid(Tables(spark, sf_dir))


def rule_sql(source: str) -> str:
    q, c = RAW.replace("@", "query"), RAW.replace("@", "content")
    return f"""
        parts AS (SELECT *, CASE WHEN len({q}) > 0 THEN len(list_intersect(list_distinct({q}), {c})) / len(list_distinct({q})) ELSE 0.0 END AS overlap,
            greatest(0.0, 1 - abs(length(content) - 200) / 200.0) AS length_score,
            CASE WHEN count(*) OVER (PARTITION BY query_id) <= 1 THEN 1.0 ELSE 1 - (rank - 1) / (count(*) OVER (PARTITION BY query_id)) * 0.2 END AS position_bonus FROM {source}),
        ruled AS (SELECT *, 0.5 * score + 0.3 * overlap + 0.1 * length_score + 0.1 * position_bonus AS new_score FROM parts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(new_score, 6) DESC, rank) AS new_rank FROM ruled)
    """


@query(CANDIDATES + f", {rule_sql('c')} SELECT query_id, doc_id, new_rank, round(overlap, 6) AS overlap, round(length_score, 6) AS length_score, round(position_bonus, 6) AS position_bonus, round(new_score, 6) AS new_score FROM ranked")
def rule_rerank(spark, sf_dir):
    r = rerank.rule_rerank(candidates(Tables(spark, sf_dir)))
    return r.select("query_id", "doc_id", "new_rank", *[F.round(c, 6).alias(c) for c in ("overlap", "length_score", "position_bonus", "new_score")])


@query(HYBRID + f", h2 AS (SELECT query_id, query, doc_id, text AS content, score, rank FROM merged JOIN q USING (query_id) JOIN documents USING (doc_id)), {rule_sql('h2')} SELECT query_id, new_rank AS rank, doc_id, round(new_score, 6) AS score FROM ranked WHERE new_rank <= 10")
def hybrid_reranked(spark, sf_dir):
    return hybrid(Tables(spark, sf_dir), reranker="rule")


@query(CANDIDATES + f", {rule_sql('c')}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(overlap, 6) DESC, rank) AS model_rank FROM parts) SELECT query_id, doc_id, model_rank AS new_rank, round(overlap, 6) AS new_score FROM o")
def model_rerank(spark, sf_dir):
    return rerank.model_rerank(candidates(Tables(spark, sf_dir))).select("query_id", "doc_id", "new_rank", F.round("new_score", 6).alias("new_score"))


_ORDER = """
    r AS (SELECT item_id AS reply_id, 3 + item_id % 4 AS n, CASE item_id % 7 WHEN 0 THEN (1 + item_id % 5) || ', ' || (1 + length(text) % 4)
        WHEN 1 THEN '排序结果: ' || (1 + item_id % 3) || ',1,2' || chr(10) || '排序理由: 文档' || (1 + item_id % 4) || '最好' WHEN 2 THEN 'none' WHEN 3 THEN ''
        WHEN 4 THEN '9,9' WHEN 5 THEN '2,2,' || (1 + item_id % 6) ELSE text END AS reply FROM benchmark),
    s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(reply, '[^0-9,]', '', 'g'), ','), lambda x: try_cast(x AS BIGINT) - 1), lambda x: x IS NOT NULL AND x >= 0 AND x < n) AS l FROM r),
    g AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS ranked FROM s),
    o AS (SELECT reply_id, n, list_concat(ranked, list_filter(range(n), lambda x: NOT list_contains(ranked, x))) AS ord FROM g WHERE len(ranked) > 0)
"""


def replies(t: Tables) -> DataFrame:
    """A reply of some form for each benchmark item: numbers, numbers in words, none, out of range, repeated, and the item's own text."""
    i, size = F.col("item_id"), F.length("text")
    s = lambda c: c.cast("string")
    forms = [F.concat(s(1 + i % 5), F.lit(", "), s(1 + size % 4)), F.concat(F.lit("排序结果: "), s(1 + i % 3), F.lit(",1,2\n排序理由: 文档"), s(1 + i % 4), F.lit("最好")), F.lit("none"), F.lit(""), F.lit("9,9"), F.concat(F.lit("2,2,"), s(1 + i % 6)), F.col("text")]
    return t.benchmark.select(i.alias("reply_id"), F.element_at(F.array(*forms), (i % 7 + 1).cast("int")).alias("reply"), (3 + i % 4).alias("n"))


@query(f"WITH {_ORDER} SELECT reply_id, unnest(range(len(ord))) AS place, unnest(ord) AS item, round((n - unnest(range(len(ord)))) / n, 6) AS score FROM o")
def llm_order_parse(spark, sf_dir):
    r = replies(Tables(spark, sf_dir)).select("reply_id", "n", F.posexplode(T.parse_order(F.col("reply"), F.col("n"))).alias("place", "item"))
    return r.select("reply_id", F.col("place").cast("bigint").alias("place"), "item", F.round((F.col("n") - F.col("place")) / F.col("n"), 6).alias("score"))


_PLACE = "(2 + (query_id // 20) % 5)"


@query(CANDIDATES + f" SELECT query_id, doc_id, CASE WHEN rank = {_PLACE} THEN 1 WHEN rank < {_PLACE} THEN rank + 1 ELSE rank END AS new_rank, round((n - CASE WHEN rank = {_PLACE} THEN 0 WHEN rank < {_PLACE} THEN rank ELSE rank - 1 END) / n, 6) AS new_score FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c)")
def order_rerank(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # the reply names one place of each question's list, another one from question to question
    said = questions(t).select("query_id", F.concat(F.lit("best: "), (2 + F.floor(F.col("query_id") / 20) % 5).cast("string")).alias("reply"))
    return rerank.order_rerank(candidates(t), said).select("query_id", "doc_id", "new_rank", F.round("new_score", 6).alias("new_score"))


_MEDICAL = " OR ".join(f"contains(query, '{w}')" for w in T.MEDICAL_WORDS)


@query(f"SELECT item_id, CASE WHEN {_MEDICAL} THEN 'medical' WHEN n <= 5 THEN 'explanation' WHEN length(query) > 20 THEN 'advanced' ELSE 'basic' END AS kind FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '超声诊断' WHEN 1 THEN text ELSE text[1:1] END AS query, 1 + item_id % 10 AS n FROM benchmark)")
def rerank_prompt_select(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark
    # questions of each kind: medical words, a whole item, one letter
    q = F.when(F.col("item_id") % 3 == 0, "超声诊断").when(F.col("item_id") % 3 == 1, F.col("text")).otherwise(F.substring("text", 1, 1))
    return b.select("item_id", T.rerank_prompt_kind(q, 1 + F.col("item_id") % 10).alias("kind"))


# ---- text similarity ----

_HASH = "1 - (" + " + ".join(f"bit_count(xor(('0x' || substr(md5(query), {i}, 8))::BIGINT, ('0x' || substr(md5({{c}}), {i}, 8))::BIGINT))" for i in (1, 9, 17, 25)) + ") / 128.0"


@query(f"SELECT item_id AS query_id, doc_id, round({_HASH.format(c='d.text')}, 6) AS similarity FROM (SELECT item_id, text AS query FROM benchmark WHERE item_id % 20 = 0) b, documents d")
def md5_hamming(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = against_all(t.documents, questions(t).select("query_id", "query"))  # the stated queries against all rows
    return pairs.select("query_id", "doc_id", F.round(T.hash_similarity(F.col("query"), F.col("text")), 6).alias("similarity"))


_GRAMS = f"""
    ct AS (SELECT query_id, doc_id, {toks('content')} AS tk FROM c UNION ALL SELECT DISTINCT query_id, -1, {toks('query')} FROM c),
    tn AS (SELECT query_id, count(*) AS n FROM ct GROUP BY query_id),
    g1 AS (SELECT query_id, doc_id, unnest(tk) AS term FROM ct),
    g2 AS (SELECT query_id, doc_id, unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS term FROM ct),
    gt AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY ALL),
    gd AS (SELECT * FROM (SELECT query_id, term, sum(tf) AS total, count(*) AS df, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, term) AS r FROM gt GROUP BY query_id, term) WHERE r <= 1000),
    gw AS (SELECT query_id, doc_id, term, tf * ln((n + 1) / (df + 1)) AS w FROM gt JOIN gd USING (query_id, term) JOIN tn USING (query_id)),
    gs AS (SELECT query_id, doc_id, sqrt(sum(w * w)) AS size FROM gw GROUP BY ALL),
    tfi AS (SELECT c.query_id, c.doc_id, coalesce(dot / nullif(a.size * b.size, 0), 0.0) AS tfidf FROM c
        LEFT JOIN (SELECT x.query_id, x.doc_id, sum(x.w * y.w) AS dot FROM gw x JOIN gw y ON x.query_id = y.query_id AND x.term = y.term AND y.doc_id = -1 WHERE x.doc_id <> -1 GROUP BY ALL) p ON p.query_id = c.query_id AND p.doc_id = c.doc_id
        LEFT JOIN gs a ON a.query_id = c.query_id AND a.doc_id = c.doc_id LEFT JOIN gs b ON b.query_id = c.query_id AND b.doc_id = -1),
    kt AS (SELECT query_id, doc_id, term, count(*) AS tf FROM g1 GROUP BY ALL),
    kd AS (SELECT query_id, term, count(*) AS df FROM kt GROUP BY ALL),
    kw AS (SELECT * FROM (SELECT query_id, doc_id, term, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(tf * ln((n + 1) / (df + 1)), 9) DESC, term) AS r FROM kt JOIN kd USING (query_id, term) JOIN tn USING (query_id)) WHERE r <= 10),
    ks AS (SELECT query_id, doc_id, count(*) AS size FROM kw GROUP BY ALL),
    kwo AS (SELECT c.query_id, c.doc_id, coalesce(shared / greatest(a.size, b.size), 0.0) AS keyword FROM c
        LEFT JOIN (SELECT x.query_id, x.doc_id, count(*) AS shared FROM kw x JOIN kw y ON x.query_id = y.query_id AND x.term = y.term AND y.doc_id = -1 WHERE x.doc_id <> -1 GROUP BY ALL) p ON p.query_id = c.query_id AND p.doc_id = c.doc_id
        LEFT JOIN ks a ON a.query_id = c.query_id AND a.doc_id = c.doc_id LEFT JOIN ks b ON b.query_id = c.query_id AND b.doc_id = -1),
    bq AS (SELECT query_id, term, count(*) AS times FROM g1 WHERE doc_id = -1 GROUP BY ALL),
    bn AS (SELECT query_id, count(*) AS n, avg(len(tk)) AS avgdl FROM ct WHERE doc_id <> -1 GROUP BY query_id),
    bd AS (SELECT query_id, term, count(*) AS df FROM kt WHERE doc_id <> -1 GROUP BY ALL),
    bs AS (SELECT kt.query_id, kt.doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tk) / avgdl))) AS s
        FROM kt JOIN bq USING (query_id, term) JOIN bd USING (query_id, term) JOIN bn USING (query_id) JOIN ct ON ct.query_id = kt.query_id AND ct.doc_id = kt.doc_id WHERE kt.doc_id <> -1 GROUP BY ALL),
    bmz AS (SELECT c.query_id, c.doc_id, round(coalesce(s, 0.0), 9) AS s FROM c LEFT JOIN bs ON bs.query_id = c.query_id AND bs.doc_id = c.doc_id),
    bmn AS (SELECT query_id, doc_id, CASE WHEN max(s) OVER w = min(s) OVER w THEN s ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8) END AS bm25 FROM bmz WINDOW w AS (PARTITION BY query_id))
"""
_FUSED = CANDIDATES + f""", {_GRAMS},
    sig AS (SELECT c.*, tfidf, keyword, {_HASH.format(c='content')} AS hash, bm25 FROM c JOIN tfi USING (query_id, doc_id) JOIN kwo USING (query_id, doc_id) JOIN bmn USING (query_id, doc_id)),
    fused AS (SELECT *, ({" + ".join(f"CASE WHEN round(stddev_pop(round({s}, 9)) OVER (PARTITION BY query_id), 9) > 0 THEN {s} ELSE 0.0 END" for s in ("keyword", "hash", "bm25", "tfidf"))}) / 4 AS raw_similarity FROM sig),
    nrm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN score ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8) END AS ns,
        CASE WHEN max(round(raw_similarity, 9)) OVER w = min(round(raw_similarity, 9)) OVER w THEN round(raw_similarity, 9) ELSE (round(raw_similarity, 9) - min(round(raw_similarity, 9)) OVER w) / (max(round(raw_similarity, 9)) OVER w - min(round(raw_similarity, 9)) OVER w + 1e-8) END AS nr FROM fused WINDOW w AS (PARTITION BY query_id)),
    kept AS (SELECT *, 0.5 * ns + 0.5 * nr AS blended FROM nrm WHERE round(raw_similarity, 6) >= 0.1)
"""


@query(CANDIDATES + f", {_GRAMS} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf FROM tfi")
def tfidf_cosine(spark, sf_dir):
    return similarity.tfidf_cosine(candidates(Tables(spark, sf_dir))).select("query_id", "doc_id", F.round("tfidf", 6).alias("tfidf"))


@query(CANDIDATES + f", {_GRAMS} SELECT query_id, doc_id, round(keyword, 6) AS keyword FROM kwo")
def keyword_overlap(spark, sf_dir):
    return similarity.keyword_overlap(candidates(Tables(spark, sf_dir))).select("query_id", "doc_id", F.round("keyword", 6).alias("keyword"))


@query(CANDIDATES + f", {_GRAMS} SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bmn")
def candidate_bm25(spark, sf_dir):
    return similarity.candidate_bm25(candidates(Tables(spark, sf_dir))).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def filtered(t: Tables) -> DataFrame:
    return similarity.similarity_filter(similarity.text_similarity(candidates(t)))


@query(_FUSED + "SELECT query_id, doc_id, round(raw_similarity, 6) AS raw_similarity, round(blended, 6) AS blended, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 6) DESC, doc_id) AS new_rank FROM kept")
def text_similarity_filter(spark, sf_dir):
    return filtered(Tables(spark, sf_dir)).select("query_id", "doc_id", F.round("raw_similarity", 6).alias("raw_similarity"), F.round("blended", 6).alias("blended"), "new_rank")


@query(_FUSED + "SELECT count(*) AS total, count(*) AS text_filtered, 0 AS image_filtered, 0 AS multimodal_filtered, round(avg(raw_similarity), 6) AS mean_similarity, round(min(raw_similarity), 6) AS min_similarity, round(max(raw_similarity), 6) AS max_similarity FROM kept")
def filter_stats(spark, sf_dir):
    return similarity.filter_stats(filtered(Tables(spark, sf_dir)))


@query(f"WITH {bm25_sql(10)}, {VECTORS}, t AS (SELECT query_id, doc_id, round(score, 6) AS score FROM top), i AS (SELECT query_id, id AS doc_id, round(score, 6) AS score FROM near WHERE rank <= 10) SELECT query_id, doc_id, round(0.3 * coalesce(t.score, 0.0) + 0.7 * coalesce(i.score, 0.0), 9) AS score FROM t FULL JOIN i USING (query_id, doc_id)")
def multimodal_fuse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    image = dense.dense_search(t.embeddings, asked_vectors(t), 10).withColumnRenamed("id", "doc_id")
    return fusion.weighted_full_outer(bm25(t), image, 0.3, 0.7).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("SELECT vec_id, round(0.4 * (1 - a) + 0.3 * b + 0.3 * c, 6) AS similarity FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)")
def image_similarity(spark, sf_dir):
    # vector components stand in for the three scores of an image model
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return Tables(spark, sf_dir).embeddings.select("vec_id", F.round(similarity.perceptual_fusion(part(0), part(1), part(2)), 6).alias("similarity"))


# ---- images and modalities ----

@query(f"WITH {VECTORS}, other AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(list_reverse(a.e), b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM other), u AS (SELECT query_id, id, round(score, 6) AS score FROM near WHERE rank <= 10 UNION ALL SELECT query_id, id, round(score, 6) FROM o WHERE rank <= 10), b AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY ALL) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id AS doc_id, score FROM b) WHERE rank <= 10")
def unified_dedup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    views = [asked_vectors(t), asked_vectors(t).withColumn("vector", F.reverse("vector"))]
    lists = [dense.dense_search(t.embeddings, v, 10).select("query_id", F.col("id").alias("doc_id"), "score") for v in views]
    return fusion.unified(lists, 10).select("query_id", "rank", "doc_id", "score")


def modalities(t: Tables) -> DataFrame:
    text = bm25(t).select("query_id", "doc_id", "score", F.lit("hybrid").alias("retrieval_type"))
    image = dense.dense_search(t.embeddings, asked_vectors(t), 10).select("query_id", F.col("id").alias("doc_id"), "score", F.when(F.col("id") % 2 == 0, "image_to_image").otherwise("image_from_text").alias("retrieval_type"))
    return fusion.merge_modalities(text, image)


_MERGED = f"WITH {bm25_sql(10)}, {VECTORS}, m AS (SELECT query_id, doc_id, round(score, 6) AS score, 'hybrid' AS retrieval_type FROM top UNION ALL SELECT query_id, id, round(score, 6), CASE WHEN id % 2 = 0 THEN 'image_to_image' ELSE 'image_from_text' END FROM near WHERE rank <= 10), mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_type, doc_id) AS rank FROM m) "


@query(_MERGED + "SELECT query_id, rank, doc_id, score, retrieval_type FROM mr")
def merge_modalities(spark, sf_dir):
    return modalities(Tables(spark, sf_dir)).select("query_id", "rank", "doc_id", "score", "retrieval_type")


@query(_MERGED + "SELECT query_id, CASE WHEN retrieval_type = 'hybrid' THEN 'text' ELSE retrieval_type END AS bucket, count(*) AS n FROM mr GROUP BY ALL")
def categorize_results(spark, sf_dir):
    return modalities(Tables(spark, sf_dir)).groupBy("query_id", answers.bucket_of(F.col("retrieval_type")).alias("bucket")).agg(F.count("*").alias("n"))


_CAP = "c(query_id, rank, content) AS (SELECT doc_id % 50, doc_id, text || '。见图' || (doc_id % 12) || '-' || (doc_id % 9) || ' ' || lang || ' 心脏（四腔心）。另有图' || (doc_id % 5) || '-1 肝脏 右叶, 正常；' FROM documents), x AS (SELECT query_id, rank, unnest(list_transform(regexp_extract_all(content, '(图\\d+-\\d+\\s+[\\p{L}\\p{N}_\\s（）(),]+)', 1), lambda s: trim(s))) AS caption FROM c)"


@query(f"WITH {_CAP} SELECT query_id, caption, min(rank) AS first_rank, sha256(caption) AS image_path FROM x GROUP BY query_id, caption")
def caption_extract(spark, sf_dir):
    """Captions in the documents' texts, two to each, and the image of each: the first of a question's hits that names it stays."""
    d, s = Tables(spark, sf_dir).documents, lambda c: c.cast("string")
    i = F.col("doc_id")
    named = F.concat("text", F.lit("。见图"), s(i % 12), F.lit("-"), s(i % 9), F.lit(" "), "lang", F.lit(" 心脏（四腔心）。另有图"), s(i % 5), F.lit("-1 肝脏 右叶, 正常；"))
    hits = d.select((i % 50).alias("query_id"), i.alias("rank"), named.alias("content"))
    known = hits.select(F.explode(T.captions(F.col("content"))).alias("caption")).distinct().select("caption", F.sha2("caption", 256).alias("image_path"), F.lit(1.0).alias("score"))
    images = search.caption_images(hits, known)
    first = hits.select("query_id", "rank", F.explode(T.captions(F.col("content"))).alias("caption")).groupBy("query_id", "caption").agg(F.min("rank").alias("first_rank"))
    return images.join(first, ["query_id", "caption"]).select("query_id", "caption", "first_rank", "image_path")


# ---- contexts and responses ----

_PACK = """
    b AS (SELECT source, doc_id, text, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part FROM documents),
    r AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WHERE length(part) > 0),
    o AS (SELECT *, min(CASE WHEN before + length(part) > 13932 THEN doc_id END) OVER (PARTITION BY source) AS ov FROM r),
    x AS (SELECT source, doc_id, ov, CASE WHEN ov IS NULL OR doc_id < ov THEN part WHEN doc_id = ov AND 13932 - before - 20 > 100 THEN substr(text, 1, (13932 - before - 20)::BIGINT) || '...' END AS t FROM o)
"""


@query(f"WITH {_PACK} SELECT source, count(*) AS parts, length(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS chars, md5(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS digest, bool_or(coalesce(doc_id = ov, false)) AS cut FROM x WHERE t IS NOT NULL GROUP BY source")
def context_pack(spark, sf_dir):
    packed = answers.pack_context(Tables(spark, sf_dir).documents, answers.context_budget(0), key="source", order="doc_id", content="text")
    return packed.select("source", "parts", F.length("context").cast("bigint").alias("chars"), F.md5("context").alias("digest"), "cut")


@query(f"WITH {bm25_sql(10)} SELECT query_id, count(*) AS total_results, string_agg('doc_' || rank || ':' || doc_id, ',' ORDER BY rank) AS retrieval, '2024-01-02T03:04:05' AS timestamp FROM top GROUP BY query_id")
def response_assembly(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = answers.responses(questions(t).select("query_id", "query"), bm25(t), now="2024-01-02 03:04:05")
    return r.select("query_id", "total_results", F.array_join(F.transform("retrieval", lambda x: F.concat(F.lit("doc_"), x["rank"].cast("string"), F.lit(":"), x["doc_id"].cast("string"))), ",").alias("retrieval"), "timestamp")


@query(CANDIDATES + " SELECT query_id, rank, doc_id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS snippet FROM c WHERE rank <= 3")
def top3_preview(spark, sf_dir):
    return answers.preview(candidates(Tables(spark, sf_dir))).select("query_id", "rank", "doc_id", "snippet")


@query(_MERGED + ", im AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM mr WHERE retrieval_type <> 'hybrid') SELECT query_id, place, '/img/' || doc_id || '.png' AS path FROM im WHERE place <= 3")
def answer_images(spark, sf_dir):
    hits = modalities(Tables(spark, sf_dir)).withColumn("content", T.image_content(F.lit("caption"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".png"))))
    return answers.answer_images(hits)


@query(CANDIDATES + ", f AS (SELECT query_id, doc_id, rank, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part, content FROM c), w AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE length(part) > 0), a AS (SELECT query_id, CASE WHEN length(part) <= 13932 THEN part ELSE substr(content, 1, 13912) || '...' END AS first FROM w WHERE before = 0) SELECT query_id, string_split(first, chr(10) || chr(10))[1] AS answer FROM a")
def llm_answer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return answers.answers(questions(t).select("query_id", "query"), answers.pack_context(candidates(t), answers.context_budget(0))).select("query_id", "answer")


@query(CANDIDATES + f" SELECT query_id, CASE WHEN {_MEDICAL} THEN 'medical' WHEN count(*) <= 5 THEN 'explanation' WHEN length(query) > 20 THEN 'advanced' ELSE 'basic' END AS kind, count(*) AS n, CASE WHEN NOT ({_MEDICAL}) AND count(*) > 5 AND length(query) > 20 THEN md5(string_agg('[' || rank || '] ' || substr(content, 1, 300) || '...', chr(10) ORDER BY rank)) END AS advanced_list FROM c GROUP BY query_id, query")
def rerank_prompts(spark, sf_dir):
    prompts = answers.rerank_prompts(candidates(Tables(spark, sf_dir)))
    lines = F.regexp_count("prompt", F.lit(r"(?m)^\[\d+\] ")).cast("bigint")
    listed = F.md5(F.substring("prompt", F.locate("\n[1] ", F.col("prompt")) + 1, F.length("prompt")))
    return prompts.select("query_id", "kind", lines.alias("n"), F.when(F.col("kind") == "advanced", listed).alias("advanced_list"))


# ---- chunks, records, collections ----

_MD = "SELECT conv_id, '# conversation ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id"


def markdown(t: Tables) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return t.conversations.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.concat(F.lit("# conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("body")).alias("text"))


@query(f"WITH m AS ({_MD}), s AS (SELECT conv_id, unnest(regexp_extract_all(text, '(?s)(^|\\n)(#{{1,6}} [^\\n]*)', 2)) AS head, generate_subscripts(regexp_extract_all(text, '(?s)(^|\\n)(#{{1,6}} [^\\n]*)', 2), 1) - 1 AS pos FROM m) SELECT conv_id, pos, length(regexp_extract(head, '^(#+) ', 1)) AS header_level, CASE WHEN pos = 0 THEN '' ELSE 'conversation ' || conv_id || '/' END || trim(regexp_extract(head, '^#+ (.*)', 1)) AS header_path, CASE WHEN pos > 0 THEN sha256(conv_id || ':' || (pos - 1)) END AS prev_id FROM s")
def section_chunks(spark, sf_dir):
    s = chunking.sections(markdown(Tables(spark, sf_dir)), "conv_id")
    return s.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("header_level").cast("bigint").alias("header_level"), F.array_join("header_path", "/").alias("header_path"), "prev_id")


@query("SELECT conv_id, turn, role, lag(node) OVER w AS prev_id, lead(node) OVER w AS next_id FROM (SELECT *, conv_id || ':' || turn || ':' || role AS node FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def prev_next_nodes(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    rows = c.withColumn("node", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")).withColumn("at", F.struct("turn", "role", "text"))
    return chunking.linked(rows, ["conv_id"], "at", "node").select("conv_id", "turn", "role", "prev_id", "next_id")


@query("WITH r AS (SELECT 'img/' || (doc_id % 500) || '.png' AS image_path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' ' || n_chars END AS caption, source, doc_id AS ordinal FROM documents), f AS (SELECT DISTINCT 'img/' || doc_id || '.png' AS path FROM labels), v AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY ordinal DESC) AS n FROM r WHERE caption <> '' AND image_path IN (SELECT path FROM f)) SELECT sha256(image_path) AS image_id, image_path, caption, source FROM v WHERE n = 1")
def image_nodes_clean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    name = lambda c: F.concat(F.lit("img/"), c.cast("string"), F.lit(".png"))
    records = t.documents.select(name(F.col("doc_id") % 500).alias("image_path"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat_ws(" ", "lang", F.col("n_chars").cast("string"))).alias("caption"), "source", F.col("doc_id").alias("ordinal"))
    files = t.labels.select(F.concat(F.lit("/data/"), name(F.col("doc_id"))).alias("path"))
    return collections.image_nodes(records, "/data", files)


@query("WITH d AS (SELECT md5(text) AS key, doc_id AS ordinal, source FROM documents), o AS (SELECT key, min(ordinal) AS ordinal, 'old' AS source FROM d GROUP BY key), n AS (SELECT key, ordinal, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) AS r FROM d WHERE ordinal % 3 = 0) WHERE r = 1) SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n")
def upsert_last_wins(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.md5("text").alias("key"), F.col("doc_id").alias("ordinal"), "source")
    old = d.groupBy("key").agg(F.min("ordinal").alias("ordinal")).withColumn("source", F.lit("old"))
    return collections.upsert(old, d.where("ordinal % 3 = 0"), "key", "ordinal")


@query(" UNION ALL ".join(f"SELECT '{x}' AS collection_name, count(*) AS document_count FROM {x}" for x in TABLES))
def collection_info(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return collections.collection_info({name: getattr(t, name) for name in TABLES})


@query("SELECT f AS file, row_number AS qid, question, answer FROM (SELECT item_id // 10 AS f, row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) AS row_number, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS question, CASE WHEN (item_id // 10) % 3 = 0 AND item_id % 2 = 0 THEN 'answer ' || item_id END AS answer FROM benchmark) WHERE trim(question) <> ''")
def question_file_shapes(spark, sf_dir):
    """The benchmark as question files of ten items, in the three shapes that such a file may have."""
    i = F.col("item_id")
    rows = Tables(spark, sf_dir).benchmark.select(F.floor(i / 10).alias("file"), i, F.when(i % 7 == 0, " ").otherwise(F.col("text")).alias("question"), F.when(i % 2 == 0, F.concat(F.lit("answer "), i.cast("string"))).alias("answer"))
    items = F.sort_array(F.collect_list(F.struct("item_id", "question", "answer")))
    files = rows.groupBy("file").agg(items.alias("l"))
    plain = F.transform("l", lambda x: x["question"])
    shape = F.when(F.col("file") % 3 == 0, F.to_json(F.transform("l", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))))).when(F.col("file") % 3 == 1, F.to_json(plain)).otherwise(F.to_json(F.struct(plain.alias("questions"))))
    return readers.parse_questions(files.select("file", shape.alias("value")), keep=["file"])


@query(CANDIDATES + f", {_GRAMS}, f AS (SELECT query_id, doc_id, count(*) AS terms, md5(string_agg(term, '|' ORDER BY term)) AS digest, round(sum(w), 6) AS weight FROM gw WHERE doc_id <> -1 GROUP BY ALL) SELECT query_id, doc_id, coalesce(terms, 0) AS terms, digest, round(coalesce(weight, 0.0), 6) AS weight FROM c LEFT JOIN f USING (query_id, doc_id)")
def candidate_features(spark, sf_dir):
    """The weights of a candidate's terms as a map, by the method of the TF-IDF signal."""
    f = similarity.features(candidates(Tables(spark, sf_dir)), "tfidf")
    keys = F.sort_array(F.map_keys("features"))
    weight = F.round(F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, v: a + v), 6)
    return f.select("query_id", "doc_id", F.size("features").cast("bigint").alias("terms"), F.when(F.size("features") > 0, F.md5(F.array_join(keys, "|"))).alias("digest"), weight.alias("weight"))


# ---- evaluation ----

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PAIRS = """
    u AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    pr AS (SELECT conv_id || ':' || turn AS id, text AS question, t2 AS answer, text AS context FROM u WHERE role = 'user' AND r2 = 'assistant')
"""


def conversation_pairs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t.conversations.withColumns({"r2": F.lead("role").over(w), "t2": F.lead("text").over(w)}).where("role = 'user' and r2 = 'assistant'")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question"), F.col("t2").alias("answer"), F.array("text").alias("contexts"))


def _cleaned(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '…', '...'), '\\s+', ' ', 'g'))"


@query(f"WITH {_PAIRS}, z AS (SELECT id, substr(question, 1, 200) AS question, {_cleaned('substr(answer, 1, 800)')} AS answer, {_cleaned('''CASE WHEN length(context) <= 600 THEN context ELSE substr(context, 1, 597) || '...' END''')} AS context, question AS q0, answer AS a0 FROM pr) SELECT id, question, answer, context FROM z WHERE trim(coalesce(q0, '')) <> '' AND trim(coalesce(a0, '')) <> '' AND context <> ''")
def eval_prepare(spark, sf_dir):
    return evaluation.samples(conversation_pairs(Tables(spark, sf_dir))).select("id", "question", "answer", F.array_join("contexts", "|").alias("context"))


@query("WITH s AS (SELECT 'quality' AS metric, quality::DOUBLE AS score FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) SELECT metric, round(avg(score), 3) AS average, round(max(score), 3) AS max, round(min(score), 3) AS min, count(score) AS count FROM s GROUP BY metric")
def eval_summary(spark, sf_dir):
    labels = Tables(spark, sf_dir).labels
    scores = labels.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in ("quality", "toxic")])).alias("x")).select("x.metric", "x.score")
    return evaluation.metric_summary(scores)


@query("SELECT count(*) AS total_questions, count(*) FILTER (WHERE event_type <> 'error') AS successful_queries, count(*) FILTER (WHERE event_type = 'error') AS failed_queries, printf('%.2f%%', count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*)) AS success_rate, printf('%.2f', sum(value) FILTER (WHERE event_type <> 'error')) AS total_processing_time, printf('%.2f', avg(value) FILTER (WHERE event_type <> 'error')) AS average_processing_time FROM events")
def session_summary(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    return evaluation.batch_summary(events)


def _share(a: str, b: str) -> str:
    a, b = RAW.replace("@", a), RAW.replace("@", b)
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a})) ELSE 0.0 END"


_SAMPLES = f"WITH {_PAIRS}, z AS (SELECT id, substr(question, 1, 200) AS question, {_cleaned('substr(answer, 1, 800)')} AS answer, {_cleaned('''CASE WHEN length(context) <= 600 THEN context ELSE substr(context, 1, 597) || '...' END''')} AS context, question AS q0, answer AS a0 FROM pr), s AS (SELECT * FROM z WHERE trim(coalesce(q0, '')) <> '' AND trim(coalesce(a0, '')) <> '' AND context <> '')"
_METRICS = f"{_SAMPLES}, m AS (SELECT id, 'faithfulness' AS metric, {_share('answer', 'context')} AS score FROM s UNION ALL SELECT id, 'answer_relevancy', {_share('question', 'answer')} FROM s UNION ALL SELECT id, 'context_relevancy', {_share('question', 'context')} FROM s)"


@query(_METRICS + " SELECT metric, round(avg(score), 3) AS average, round(max(score), 3) AS max, round(min(score), 3) AS min, count(*) AS count FROM m GROUP BY metric")
def eval_metrics(spark, sf_dir):
    return evaluation.metric_summary(evaluation.overlap_metrics(evaluation.samples(conversation_pairs(Tables(spark, sf_dir)))))


@query(_METRICS + " SELECT id, string_agg(metric || '=' || round(score, 3), ',' ORDER BY metric) AS metrics FROM m GROUP BY id")
def eval_query_results(spark, sf_dir):
    r = evaluation.query_results(evaluation.overlap_metrics(evaluation.samples(conversation_pairs(Tables(spark, sf_dir)))))
    each = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 3).cast("string")))
    return r.select("id", F.array_join(F.array_sort(each), ",").alias("metrics"))


@query(HYBRID + f""", h2 AS (SELECT query_id, query, doc_id, text AS content, score, rank FROM merged JOIN q USING (query_id) JOIN documents USING (doc_id)), {rule_sql('h2')},
    hit AS (SELECT query_id, doc_id, content, row_number() OVER (PARTITION BY query_id ORDER BY round(new_score, 6) DESC, doc_id) AS rank FROM ranked WHERE new_rank <= 10),
    pt AS (SELECT *, trim(content, {_WS}) AS part FROM hit),
    bf AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pt WHERE length(part) > 0),
    a AS (SELECT query_id, CASE WHEN length(part) <= 13932 THEN part ELSE substr(content, 1, 13912) || '...' END AS first FROM bf WHERE before = 0)
    SELECT query_id, (SELECT count(*) FROM hit WHERE hit.query_id = q.query_id) AS total_results, string_split(first, chr(10) || chr(10))[1] AS answer, '2024-01-02T03:04:05' AS timestamp FROM q LEFT JOIN a USING (query_id)""")
def search_and_answer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id").join(t.documents.select("doc_id"), "doc_id", "left_semi")
    r = search.search_and_answer(t.documents, vectors, questions(t), now="2024-01-02 03:04:05", index=stored(t))
    return r.select("query_id", "total_results", "answer", "timestamp")


class LengthJudge:
    """Scores by lengths; can't read contexts of over 500 characters, and no question whose length divides by 11. A stand-in."""

    def score(self, metric: str, question: str, answer: str, contexts: list[str]) -> float:
        if len(question) % 11 == 0:
            raise ValueError("no judgement")
        if any(len(c) > 500 for c in contexts):
            raise ValueError("Failed to parse output of the judge")
        a, b = {"faithfulness": ("".join(contexts), answer), "answer_relevancy": (question, answer), "context_relevancy": (question, "".join(contexts))}[metric]
        return len(a) / (len(a) + len(b))


@query(f"""{_SAMPLES}, j AS (SELECT *, length(question) % 11 = 0 AS broken, length(context) > 500 AS long, substr(context, 1, 500) AS ctx FROM s),
    m AS (SELECT id, 'faithfulness' AS metric, length(ctx) / (length(ctx) + length(answer)) AS score, CASE WHEN broken THEN 3 WHEN long THEN 2 ELSE 1 END AS attempts, broken FROM j
        UNION ALL SELECT id, 'answer_relevancy', length(question) / (length(question) + length(answer)), CASE WHEN broken THEN 3 ELSE 1 END, broken FROM j
        UNION ALL SELECT id, 'context_relevancy', length(question) / (length(question) + length(ctx)), CASE WHEN broken THEN 3 ELSE 1 END, broken FROM j)
    SELECT id, metric, round(CASE WHEN broken THEN 0.0 ELSE score END, 6) AS score, attempts, CASE WHEN broken THEN 'no judgement' END AS error FROM m""")
def eval_judged(spark, sf_dir):
    r = evaluation.judged_metrics(evaluation.samples(conversation_pairs(Tables(spark, sf_dir))), LengthJudge)
    return r.select("id", "metric", F.round("score", 6).alias("score"), "attempts", "error")


#: Documents of which every tenth names a figure, as a table of the same name.
FIGURED = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '。见图' || (doc_id % 12) || '-' || (doc_id % 9) || ' heart。' ELSE text END AS text FROM documents"


@query(HYBRID.replace("WITH ", f"WITH documents AS ({FIGURED}), ", 1) + f""",
    im AS (SELECT vec_id AS image_id, 'img/' || vec_id || '.png' AS image_path, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'caption ' || vec_id END AS caption, e, list_reverse(e) AS ce FROM v),
    tx AS (SELECT query_id, doc_id, text AS content, round(score, 6) AS score, rank FROM merged JOIN documents USING (doc_id) WHERE rank <= 10),
    nm AS (SELECT query_id, rank, unnest(list_transform(regexp_extract_all(content, '(图\\d+-\\d+\\s+[\\p{{L}}\\p{{N}}_\\s（）(),]+)', 1), lambda s: trim(s))) AS caption FROM tx),
    cp AS (SELECT caption, regexp_extract(caption, '图(\\d+)', 1)::BIGINT * 10 + regexp_extract(caption, '-(\\d+)', 1)::BIGINT AS vid FROM (SELECT DISTINCT caption FROM nm)),
    cm AS (SELECT * FROM (SELECT cp.caption, image_id, round(list_cosine_similarity(v.e, ce), 6) AS score, row_number() OVER (PARTITION BY cp.caption ORDER BY round(list_cosine_similarity(v.e, ce), 6) DESC, image_id) AS r FROM cp JOIN v ON vec_id = vid, im WHERE im.caption <> '') WHERE r = 1),
    ft AS (SELECT * FROM (SELECT query_id, image_id, score, row_number() OVER (PARTITION BY query_id, image_id ORDER BY rank) AS r FROM nm JOIN cm USING (caption)) WHERE r = 1),
    ii AS (SELECT * FROM (SELECT q.query_id, image_id, round(list_cosine_similarity(v.e, im.e), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(v.e, im.e), 6) DESC, image_id) AS r FROM q JOIN v ON vec_id = q.query_id, im WHERE q.query_id % 40 = 0) WHERE r <= 1),
    cl AS (SELECT * FROM (SELECT q.query_id, image_id, round(list_cosine_similarity(list_reverse(v.e), im.e), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(list_reverse(v.e), im.e), 6) DESC, image_id) AS r FROM q JOIN v ON vec_id = q.query_id, im WHERE q.query_id % 60 = 0) WHERE r <= 10),
    ih AS (SELECT query_id, image_id, score, 'image_from_text' AS retrieval_type FROM ft UNION ALL SELECT query_id, image_id, score, 'image_to_image' FROM ii UNION ALL SELECT query_id, image_id, score, 'clip_text_to_image' FROM cl),
    al AS (SELECT query_id, doc_id, content, score, 'hybrid' AS retrieval_type FROM tx UNION ALL SELECT query_id, image_id, '图片描述: ' || caption || chr(10) || '图片路径: /data/' || image_path, score, retrieval_type FROM ih JOIN im USING (image_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_type, doc_id) AS rank FROM al),
    ni AS (SELECT query_id, least(3, (query_id % 40 = 0)::BIGINT + count(*) FILTER (WHERE retrieval_type IN ('image_from_text', 'image_to_image'))) AS n, count(*) AS total_results FROM rk GROUP BY query_id),
    pt AS (SELECT rk.*, CASE n WHEN 0 THEN 13932 WHEN 1 THEN 9432 WHEN 2 THEN 4932 ELSE 432 END AS budget, trim(content, {_WS}) AS part FROM rk JOIN ni USING (query_id)),
    bf AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pt WHERE length(part) > 0),
    ov AS (SELECT *, min(CASE WHEN before + length(part) > budget THEN rank END) OVER (PARTITION BY query_id) AS o FROM bf),
    tk AS (SELECT query_id, rank, CASE WHEN o IS NULL OR rank < o THEN part WHEN rank = o AND budget - before - 20 > 100 THEN substr(content, 1, (budget - before - 20)::BIGINT) || '...' END AS t FROM ov),
    cx AS (SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM tk WHERE t IS NOT NULL GROUP BY query_id)
    SELECT query_id, total_results, n AS images, md5(coalesce(context, '')) AS context, length(coalesce(context, '')) AS chars FROM ni LEFT JOIN cx USING (query_id)""")
def multimodal_answer(spark, sf_dir):
    """The whole question: text hits, its own image's neighbours, images of the figures that its hits name, images near its text, and a context that leaves room for the images."""
    t, i = Tables(spark, sf_dir), F.col("doc_id")
    figure = F.concat("text", F.lit("。见图"), (i % 12).cast("string"), F.lit("-"), (i % 9).cast("string"), F.lit(" heart。"))
    docs = t.documents.select("doc_id", F.when(i % 10 == 0, figure).otherwise(F.col("text")).alias("text"))
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    q = questions(t).withColumns({"image_vector": F.when(F.col("query_id") % 40 == 0, F.col("vector")), "clip_vector": F.when(F.col("query_id") % 60 == 0, F.reverse("vector"))})
    known = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))

    def embed(captions: DataFrame) -> DataFrame:
        part = lambda pattern: F.regexp_extract("caption", pattern, 1).cast("bigint")
        return captions.withColumn("vec_id", part(r"图(\d+)") * 10 + part(r"-(\d+)")).join(known, "vec_id")

    def one(images: DataFrame) -> DataFrame:
        return ranking.top_k(images.where("retrieval_type = 'image_to_image'"), 1, ["query_id"], *ranking.by_score("score", "doc_id")).drop("rank").unionByName(images.where("retrieval_type <> 'image_to_image'"))

    r = search.search_and_answer(docs, vectors, q, reranker=None, filter_kind=None, now="2024-01-02 03:04:05", collection=image_collection(t), embed_captions=embed, base="/data", choose=one)
    own = (F.col("query_id") % 40 == 0).cast("bigint")
    return r.select("query_id", "total_results", (F.size("images") + own).cast("bigint").alias("images"), F.md5("context").alias("context"), F.length("context").cast("bigint").alias("chars"))


class CountingModel:
    """Replies with the length of the prompt's question, and fails where that is odd. A stand-in."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            n = len(prompt.rsplit("\n\nQuestion: ", 1)[1].removesuffix("\nAnswer:"))
            if n % 2:
                raise ValueError("an odd question")
            out.append(str(n))
        return out


_RECORDS = f"""{CANDIDATES}, r AS (SELECT query_id, count(*) AS n, string_agg(doc_id, ',' ORDER BY rank) AS ids FROM c GROUP BY query_id),
    f AS (SELECT item_id AS id, text, ids, n, CASE WHEN r.query_id IS NULL THEN 'no response' WHEN length(text) % 2 = 1 THEN 'an odd question' END AS error FROM benchmark LEFT JOIN r ON r.query_id = item_id)"""


def file_records(t: Tables) -> DataFrame:
    """A file of all benchmark items, of which the stated questions are asked, with a model that fails for some of them."""
    hits = candidates(t)
    originals = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))
    return search.answer_file(originals, questions(t), hits, CountingModel, now="2024-01-02 03:04:05")


@query(f"{_RECORDS} SELECT id, md5(text) AS original_question, '' AS original_answer, CASE WHEN error IS NULL THEN length(text)::VARCHAR END AS generated_answer, CASE WHEN error IS NULL THEN ids END AS retrieval_results, CASE WHEN error IS NULL THEN n END AS total_retrieved, '2024-01-02T03:04:05' AS timestamp, error FROM f")
def file_mode(spark, sf_dir):
    r = file_records(Tables(spark, sf_dir))
    ids = F.array_join(F.transform("retrieval_results", lambda x: x["doc_id"].cast("string")), ",")
    return r.select("id", F.md5("original_question").alias("original_question"), "original_answer", "generated_answer", ids.alias("retrieval_results"), "total_retrieved", "timestamp", "error")


@query(f"{_RECORDS} SELECT count(*) AS total_questions, count(*) FILTER (WHERE error IS NULL) AS successful_queries, count(*) FILTER (WHERE error IS NOT NULL) AS failed_queries, printf('%.2f%%', count(*) FILTER (WHERE error IS NULL) * 100.0 / count(*)) AS success_rate FROM f")
def file_report(spark, sf_dir):
    return search.batch_report(file_records(Tables(spark, sf_dir))).select("total_questions", "successful_queries", "failed_queries", "success_rate")


@query("SELECT user_id AS session_id, count(*) AS total_questions, count(*) FILTER (WHERE event_type <> 'error') AS successful_queries, count(*) FILTER (WHERE event_type = 'error') AS failed_queries, printf('%.2f%%', round(count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*), 2)) AS success_rate, printf('%.2f', round(coalesce(sum(value) FILTER (WHERE event_type <> 'error'), 0), 2)) AS total_processing_time FROM events GROUP BY user_id")
def session_stream_summary(spark, sf_dir):
    """The events as a stream of results, each user a session: the last running summary of each."""
    stream = readers.parquet_stream(spark, f"{sf_dir}/events.parquet", Tables(spark, sf_dir).events.schema)
    results = stream.select(F.col("user_id").alias("session_id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    at = f"{tables_dir(spark)}/sessions-{uuid.uuid4().hex}"
    sessions.summary_stream(results, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return sessions.latest_summaries(spark, f"{at}/out").drop("average_processing_time")  # text of a mean, whose ties round unlike elsewhere


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang ELSE lang END AS document FROM documents WHERE doc_id % 7 <> 0")
def collection_changes(spark, sf_dir):
    """A collection of all documents, then new rows for a third of them, then a seventh removed."""
    d = Tables(spark, sf_dir).documents
    row = lambda document: d.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), document.alias("document"), F.lit(None).cast("map<string,string>").alias("metadata"), "doc_id")
    store, name = collections.Collections(spark, 16), f"changes_{uuid.uuid4().hex[:12]}"
    store.put(name, row(F.col("lang")), "doc_id")
    store.put(name, row(F.concat(F.lit("new "), F.col("lang"))).where("doc_id % 3 = 0"), "doc_id")
    store.remove(name, d.where("doc_id % 7 = 0").select("doc_id"))
    out = saved(store.get(name).select("id", "document"), "changes")
    store.delete(name)
    return out


# ---- image search ----

_IMAGES = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    im AS (SELECT vec_id AS image_id, 'img/' || vec_id || '.png' AS image_path, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'caption ' || vec_id END AS caption, e, list_reverse(e) AS ce FROM v),
    asked AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 20 = 0),
    byi AS (SELECT query_id, image_id, list_cosine_similarity(asked.e, im.e) AS s FROM asked, im),
    byc AS (SELECT query_id, image_id, list_cosine_similarity(asked.e, im.ce) AS s FROM asked, im WHERE caption <> ''),
    ri AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, image_id) AS rank, image_id, round(s, 6) AS score FROM byi),
    rc AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, image_id) AS rank, image_id, round(s, 6) AS score FROM byc)
"""


def image_collection(t: Tables) -> DataFrame:
    """The vectors as images, their reversals as vectors of their captions."""
    name = F.col("vec_id").cast("string")
    return t.embeddings.select(F.col("vec_id").alias("image_id"), F.concat(F.lit("img/"), name, F.lit(".png")).alias("image_path"), F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit("caption "), name)).alias("caption"), "embedding", F.reverse("embedding").alias("caption_embedding"))


@query(f"WITH {_IMAGES} SELECT query_id, rank, image_id, image_path, caption, score, 'image_similarity' AS retrieval_type FROM ri JOIN im USING (image_id) WHERE rank <= 10")
def image_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return images.by_image(image_collection(t), asked_vectors(t))


@query(f"WITH {_IMAGES} SELECT query_id, rank, image_id, image_path, caption, score, 'caption_match' AS retrieval_type FROM rc JOIN im USING (image_id) WHERE rank <= 10")
def caption_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return images.by_caption(image_collection(t), asked_vectors(t))


@query(f"WITH {_IMAGES}, u AS (SELECT query_id, image_id, score, 'clip_text_image' AS retrieval_type FROM ri WHERE rank <= 10 UNION ALL SELECT query_id, image_id, score, 'caption_match' FROM rc WHERE rank <= 10), b AS (SELECT query_id, image_id, max(score) AS score, arg_max(retrieval_type, score) AS retrieval_type FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM b) SELECT query_id, rank, image_id, image_path, caption, score, retrieval_type FROM r JOIN im USING (image_id) WHERE rank <= 10")
def text_image_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return images.by_text(image_collection(t), asked_vectors(t), asked_vectors(t))


@query(f"WITH {_IMAGES} SELECT 'named ' || query_id AS caption, image_path, score FROM rc JOIN im USING (image_id) WHERE rank = 1")
def caption_top1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = asked_vectors(t).select(F.col("query_id").alias("caption_id"), F.concat(F.lit("named "), F.col("query_id").cast("string")).alias("caption"), "vector")
    return images.caption_matches(image_collection(t), named)


@query(f"""WITH {_IMAGES}, h AS (SELECT query_id, image_id, score, round(0.4 * (1 - e[1]) + 0.3 * e[2] + 0.3 * e[3], 9) AS sim FROM ri JOIN im USING (image_id) WHERE rank <= 10),
    n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN score ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8) END AS ns, CASE WHEN max(sim) OVER w = min(sim) OVER w THEN sim ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-8) END AS nr FROM h WINDOW w AS (PARTITION BY query_id)),
    k AS (SELECT query_id, image_id, sim, 0.5 * ns + 0.5 * nr AS blended FROM n WHERE round(sim, 6) >= 0.4)
    SELECT query_id, image_id, round(sim, 6) AS image_similarity, round(blended, 6) AS blended, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 6) DESC, image_id) AS new_rank FROM k""")
def image_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")  # noqa: E731  stand-ins for an image model's scores
    known = t.embeddings.select(F.col("vec_id").alias("doc_id"), similarity.perceptual_fusion(part(0), part(1), part(2)).alias("image_similarity"))
    hits = images.by_image(image_collection(t), asked_vectors(t)).withColumnRenamed("image_id", "doc_id").join(known, "doc_id")
    kept = similarity.filter_results(hits, "image", threshold=0.4)
    return kept.select("query_id", F.col("doc_id").alias("image_id"), F.round("image_similarity", 6).alias("image_similarity"), F.round("blended", 6).alias("blended"), "new_rank")


def rendered(t: Tables) -> DataFrame:
    """The vectors as grey pictures of 8 x 8 pixels."""
    bytes_of = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.round((v.cast("double") + 1) * 127.5).cast("int")), 2, "0")), ""))
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), bytes_of.alias("data")).alias("picture"))


@query()
def image_pixel_filter(spark, sf_dir):
    """The nearest images of each query, filtered by how alike their pixels are. The kernels have no SQL form; tests hold them against plain versions."""
    t = Tables(spark, sf_dir)
    made = rendered(t)
    hits = images.by_image(image_collection(t), asked_vectors(t)).withColumnRenamed("image_id", "doc_id").join(made, "doc_id")
    pairs = hits.join(made.select(F.col("doc_id").alias("query_id"), F.col("picture").alias("other")), "query_id").select("query_id", "doc_id", "score", "picture", "other")
    known = pixels.pixel_similarity(pairs, side=64)
    known = known.withColumn("image_similarity", similarity.perceptual_fusion(F.lit(None).cast("double"), F.col("structure"), F.col("wavelet")))
    kept = similarity.filter_results(known, "image", threshold=0.1)
    return kept.select("query_id", F.col("doc_id").alias("image_id"), F.round("structure", 6).alias("structure"), F.round("wavelet", 6).alias("wavelet"), F.round("blended", 6).alias("blended"), "new_rank")


@query(_FUSED + "SELECT query_id, doc_id, round(0.3 * raw_similarity, 6) AS multimodal_score, 'multimodal' AS filtered_by, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 6) DESC, doc_id) AS new_rank FROM kept")
def multimodal_filter(spark, sf_dir):
    rows = similarity.filter_results(similarity.text_similarity(candidates(Tables(spark, sf_dir))), "multimodal")
    return rows.select("query_id", "doc_id", F.round("multimodal_score", 6).alias("multimodal_score"), "filtered_by", "new_rank")
