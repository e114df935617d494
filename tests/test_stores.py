"""Stored indexes: equal to searches that read everything, through any sequence of changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import files
from lodestone.operators import dense, lexical, lexical_store, vector_store
from lodestone.operators.lexical_store import LexicalStore
from lodestone.operators.vector_store import VectorStore
from lodestone.plans import index

SCHEMA = "doc_id long, text string, term string, len int"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "的", "超声诊断", "x_1"]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA)


def same_as_rebuilt(spark, store, docs, asked):
    df = frame(spark, docs.items())
    want = {(r.term, r.df, round(r.idf, 9)) for r in lexical.build_index(df).terms.collect()}
    assert {(r.term, r.df, round(r.idf, 9)) for r in store.terms().collect()} == want
    stats = lexical.build_index(df).stats.first()
    n, avgdl = store.stats()
    assert n == stats.n == len(docs) and avgdl == pytest.approx(stats.avgdl)
    for pruned in (False, True):
        assert sorted(store.search(asked, 4, pruned=pruned).collect()) == sorted(lexical.bm25_search(df, asked, 4).collect())


def test_changes_equal_a_rebuild(spark, monkeypatch, tmp_path):
    """Random upserts with new, replaced, empty and null texts, deletes of known and unknown ids, a compaction; shards of three documents."""
    monkeypatch.setattr(lexical_store, "SHARD", 3)
    monkeypatch.setattr(lexical_store, "FIRST", 1)
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", *[" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(9)]])
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma 超声诊断"), (3, "none"), (4, ""), (5, "delta eps delta x_1")], "query_id long, query string")
    store, docs = LexicalStore.create(spark, str(tmp_path / "i")), {}
    assert store.search(asked, 4).collect() == [] and store.stats() == (0, 0.0)
    for step, change in enumerate(["upsert", "upsert", "delete", "upsert", "compact", "delete"]):
        if change == "upsert":
            new = {rng.randrange(30): text() for _ in range(14)}
            store.upsert(frame(spark, [*new.items(), (None, "alpha")]))
            docs |= new
        elif change == "delete":
            gone = [rng.randrange(40) for _ in range(7)]
            store.delete(spark.createDataFrame([(i,) for i in [*gone, None]], "id long"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        else:
            before = files.names(spark, store.path)
            store.compact()
            assert len(files.names(spark, store.path)) < len(before)
        if step in (1, 3, 5):
            same_as_rebuilt(spark, store, docs, asked)


def test_a_shard_is_gathered_in_one_piece(spark, monkeypatch, tmp_path):
    """Postings of repeated words, empty and null texts and ids of text, by shards of three; a row tells how many documents it has."""
    monkeypatch.setattr(lexical_store, "SHARD", 3)
    docs = {f"d{i}": t for i, t in enumerate(["alpha beta alpha", None, "", "beta", "alpha", "超声诊断 的 beta beta", "gamma", "x_1 X_1"])}
    store = LexicalStore.create(spark, str(tmp_path / "i"))
    gathered = []
    store._postings, write = (lambda words, at: gathered.append(words) or write(words, at)), store._postings
    store.upsert(spark.createDataFrame(list(docs.items()), "doc_id string, text string"))
    assert len(gathered) == 1
    segment = store._last()[1]["segments"][0]
    rows = spark.read.parquet(f"{store.path}/{segment}/postings").collect()
    words = {r.doc_id: r.tokens for r in gathered[0].collect()}
    got = {(r.term, d.doc_id): (d.tf, d.len) for r in rows for d in r.docs}
    assert got == {(t, i): (ts.count(t), len(ts)) for i, ts in words.items() for t in ts} and sum(r.n for r in rows) == len(got)
    assert all(r.tf == max(d.tf for d in r.docs) and r.len == min(d.len for d in r.docs) and r.n == len(r.docs) for r in rows)
    assert len({(r.term, r.shard) for r in rows}) == len(rows)


@pytest.mark.parametrize("texts", [False, True])
def test_groups_equal_the_whole(spark, monkeypatch, tmp_path, texts):
    """Scored in groups of three documents, with copies, repeated words, replaced and deleted documents and negative weights: the same hits, and no more of them than k a group."""
    monkeypatch.setattr(lexical_store, "SHARD", 3)
    monkeypatch.setattr(lexical_store, "GROUP", 3)
    monkeypatch.setattr(lexical, "GROUP", 3)
    rng = random.Random(5)
    docs = {i: rng.choice([None, "", "alpha beta beta", *[" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(9)]]) for i in range(60)}
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma 超声诊断"), (3, "none"), (4, ""), (5, "delta eps delta x_1")], "query_id long, query string")
    kind = (lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))) if texts else (lambda df: df)
    store = LexicalStore.create(spark, str(tmp_path / "i"))
    store.upsert(kind(frame(spark, docs.items())))
    new = {i: "alpha x_1" for i in range(0, 60, 7)}
    store.upsert(kind(frame(spark, new.items())))
    store.delete(kind(frame(spark, [(3, ""), (14, "")])).select("doc_id"))
    left = kind(frame(spark, [(i, t) for i, t in (docs | new).items() if i not in (3, 14)]))
    want = sorted(lexical.bm25_search(left, asked, 4).collect())
    assert want == sorted(store.search(asked, 4).collect())
    for module in (lexical, lexical_store):
        monkeypatch.setattr(module, "MEETINGS", 0)
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)  # the questions in several passes
    assert want == sorted(lexical.bm25_search(left, asked, 4).collect())
    for pruned in (False, True):
        assert want == sorted(store.search(asked, 4, pruned=pruned).collect())
    parts = spark.createDataFrame([(g, "alpha", [(d, 1, 1)]) for g in range(2) for d in range(g * 9, g * 9 + 9)], "group int, term string, docs array<struct<doc_id: long, tf: int, len: int>>")
    best = lexical.best_in_groups(parts, spark.createDataFrame([(1, "alpha", 2.0)], "query_id long, term string, w double"), 4, 1.0)
    assert sorted((r.query_id, r.doc_id) for r in best.collect()) == [(1, d) for d in (0, 1, 2, 3, 9, 10, 11, 12)]


def test_repeated_ids_and_other_writers(spark, tmp_path):
    store = LexicalStore.create(spark, str(tmp_path / "i"))
    twice = spark.createDataFrame([(1, "alpha", 1), (1, "beta", 2), (2, "gamma", 1)], "doc_id long, text string, at int")
    with pytest.raises(ValueError):
        store.upsert(twice)
    assert store.stats() == (0, 0.0)
    store.upsert(twice, ordinal="at")
    assert {r.term for r in store.terms().collect()} == {"beta", "gamma"}
    number, state = store._last()
    store._commit(number, state)
    with pytest.raises(FileExistsError):  # a second writer that started from the same state
        store._commit(number, state)
    with pytest.raises(FileExistsError):
        LexicalStore.create(spark, str(tmp_path / "i"))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_cells_give_exact_neighbours(spark, tmp_path):
    """Clusters, copies, a zero vector, nulls; queries in and outside the corpus, and a zero query."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * (0.1 if i % 2 else 1.0)).tolist()) for i in range(400)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, [0.0] * 12), (403, None), (404, []), (None, rows[3][1])]
    df = vectors(spark, rows)
    asked = spark.createDataFrame([(q, rows[q][1]) for q in range(0, 400, 25)] + [(402, [0.0] * 12), (900, rng.normal(size=12).tolist()), (901, None)], "query_id long, vector array<double>")
    store = VectorStore.build(spark, str(tmp_path / "v"), df, cells=20)
    want = sorted(map(tuple, dense.dense_search(df.where("vec_id is not null"), asked, 5).collect()))
    assert sorted(map(tuple, store.search(asked, 5, probes=2, exact=True).collect())) == want
    found, looked = store.looked_through(asked, 5, 2, True)
    shares = [r.looked / 403 for r in looked.where("query_id < 400").collect()]
    assert np.mean(shares) < 0.8  # cells that can't hold a better one are left out
    none = VectorStore.build(spark, str(tmp_path / "n"), df.limit(0))
    assert none.search(asked, 5).collect() == [] and store.search(asked.limit(0), 5).collect() == []


def test_probing_finds_most(spark, tmp_path):
    """Clustered vectors: a tenth of the cells holds at least 0.95 of the ten nearest."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = vectors(spark, rows)
    asked = df.where("vec_id % 60 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    store = VectorStore.build(spark, str(tmp_path / "v"), df, cells=40)
    want = {(r.query_id, r.id) for r in dense.dense_search(df, asked, 10).collect()}
    found, looked = store.looked_through(asked, 10, store.share(0.1), False)
    got = {(r.query_id, r.id) for r in store.search(asked, 10, store.share(0.1)).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert looked.agg(F.avg("looked")).first()[0] < 0.2 * 3000


def test_kept_indexes_follow_the_table(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    frame(spark, [(1, "alpha"), (2, "beta")]).write.parquet(path)
    first = index.lexical_index(spark, path)
    assert index.lexical_index(spark, path).path == first.path and first.stats()[0] == 2
    frame(spark, [(3, "gamma")]).write.mode("append").parquet(path)
    assert index.lexical_index(spark, path).stats()[0] == 3


def test_ann_probed_recall(spark):
    """On the test vectors, which have no clusters, three quarters of the cells: recall at ten of 0.95 or more."""
    from lodestone.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    want = {(r.query_id, r.id) for r in QUERIES["dense_topk"](spark, sf_dir).collect()}
    rows = QUERIES["ann_probed"](spark, sf_dir).collect()
    assert len({(r.query_id, r.id) for r in rows} & want) >= 0.95 * len(want)


def test_queries_of_a_cell_take_a_bit_each():
    where = np.random.default_rng(1).random((1000, 30)) < 0.9
    where[:, 4] = False
    packed = vector_store._asked_by_cell(where, np.arange(30) * 2)
    assert sorted(packed) == [c * 2 for c in range(30) if c != 4]
    assert all((np.unpackbits(v, count=1000) == where[:, c // 2]).all() for c, v in packed.items())
    assert sum(v.nbytes for v in packed.values()) <= 29 * 125
