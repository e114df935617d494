"""Hand-computed cases of the text, ranking and packing functions."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ranking, text as T
from lodestone.operators import answers, collections, evaluation, fusion, lexical


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["_"]).select(column.alias("x")).first().x


@pytest.mark.parametrize("scores, want", [([3, 1, 2], [1, 0, 0.5]), ([5], [1]), ([2, 2], [1, 1])])
def test_min_max(spark, scores, want):
    df = spark.createDataFrame([(i, 1, float(s)) for i, s in enumerate(scores)], "i int, k int, s double")
    assert [r.x for r in df.withColumn("x", ranking.min_max(F.col("s"), ["k"])).orderBy("i").collect()] == want


def test_min_max_or_same_keeps_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, s double")
    assert [r.x for r in df.select(ranking.min_max_or_same(F.col("s"), ["k"]).alias("x")).collect()] == [2.0, 2.0]


def test_combine_ties_put_dense_rows_first(spark):
    schema = "query_id int, doc_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2), (1, "c", 0.1, 3)], schema)
    sparse = spark.createDataFrame([(1, "b", 4.0, 1), (1, "d", 2.0, 2)], schema)
    got = [(r.doc_id, round(r.score, 6)) for r in fusion.combine(dense, sparse).orderBy("rank").collect()]
    assert got == [("a", 0.7), ("b", 0.65), ("c", 0.0), ("d", 0.0)]


def test_idf_may_be_negative(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "b c", "c", "d"])], "doc_id int, text string")
    idf = {r.term: r.idf for r in lexical.build_index(docs).terms.collect()}
    assert idf["a"] == pytest.approx(math.log(3.5 / 1.5)) and idf["b"] == 0 and idf["c"] == pytest.approx(math.log(1.5 / 3.5))


def test_bm25_keeps_zero_scores_above_negative_ones(spark):
    docs = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "x")], "query_id int, query string")
    rows = lexical.bm25_search(docs, asked, 5).orderBy("rank").collect()
    assert [r.doc_id for r in rows[:2]] == [3, 4] and rows[-1].score < 0


@pytest.mark.parametrize("reply, n, want", [("3, 1", 3, [2, 0, 1]), ("排序结果: 3,1,2\n排序理由: 文档3最好", 3, [2, 0, 1]), ("none", 3, []), ("", 3, []), ("9,9", 3, []), ("2,2,1", 3, [1, 0, 2])])
def test_parse_order(spark, reply, n, want):
    assert one(spark, T.parse_order(F.col("r"), F.col("n")), r=reply, n=n) == want


@pytest.mark.parametrize("limit, want", [(4, "一二三。"), (9, "一二三。四五六七。"), (3, "...")])
def test_truncate_sentences(spark, limit, want):
    assert one(spark, T.truncate_sentences(F.col("t"), limit), t="一二三。四五六七。八。") == want


def test_captions(spark):
    text = "见图3-12 胎儿心脏（四腔心）。另有图4-1 肝脏 右叶, 正常；"
    assert one(spark, T.captions(F.col("t")), t=text) == ["图3-12 胎儿心脏（四腔心）", "图4-1 肝脏 右叶, 正常"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The Été_1, 胎儿心 的 x") == ["the", "été_1", "胎儿", "儿心", "x"]


def test_scores_of_rules(spark):
    assert one(spark, T.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 0.5
    assert [one(spark, T.length_score(F.col("t")), t="x" * n) for n in (200, 100, 400, 0)] == [1, 0.5, 0, 0]
    assert one(spark, T.hash_similarity(F.lit("a"), F.lit("a"))) == 1.0


@pytest.mark.parametrize("images, want", [(0, 13932), (1, 9432), (2, 4932), (3, 432)])
def test_context_budget(images, want):
    assert answers.context_budget(images) == want


@pytest.mark.parametrize("sizes, want", [([200, 200, 200], 402), ([400, 50, 5], 400), ([150, 0, 300], 150 + 2 + 263), ([500], 415), ([], None)])
def test_pack_context(spark, sizes, want):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "query_id int, rank int, content string")
    got = [len(r.context) for r in answers.pack_context(rows, 432).collect()]
    assert got == ([] if want is None else [want])


def test_recall_and_summary(spark):
    ranks = spark.createDataFrame([(1,), (3,), (7,), (12,)], "rank int")
    assert tuple(evaluation.recall_at(ranks).first()) == (0.25, 0.5, 0.75)
    assert tuple(evaluation.recall_at(ranks.limit(0)).first()) == (0.0, 0.0, 0.0)
    batch = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 3.0), (False, 9.0)], "ok boolean, seconds double")
    assert tuple(evaluation.batch_summary(batch).first()) == (4, 3, 1, "75.00%", "6.00", "2.00")
    assert evaluation.batch_summary(batch.limit(0)).first().success_rate == "0%"


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "key string, v int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "key string, v int, o int")
    assert sorted(map(tuple, collections.upsert(old, new, "key", "o").collect())) == [("a", 3), ("b", 1), ("c", 4)]
