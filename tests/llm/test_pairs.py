"""N-gram join and embedding near-duplicates against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, ngram_join
from lodestone.llm._spark import Stage
from lodestone.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(20)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 30)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(rng.randint(0, 30))] + passage) for _ in range(60)]
    return texts + [texts[0]] * 5 + ["A b", "a B", "a", "", " \n", None, "É é", "x " * 400, "x " * 401]


@pytest.mark.parametrize("frequent, block, postings, rows_, keys", [(24, 256, 65_536, 1024, 1000), (1, 16, 40, 4, 1000), (1, 16, 40, 4, 0)])
def test_join_equals_brute_force(spark, monkeypatch, frequent, block, postings, rows_, keys):
    """With the production sizes, and with such that blocks, salts and the forms without a broadcast are used."""
    for name, value in (("FREQUENT", frequent), ("DOCUMENTS", block), ("POSTINGS", postings), ("ROWS", rows_), ("MOST_KEYS", keys)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, n string, component bigint, rep bigint")
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(sets, linked)
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_join_edges(spark):
    schema = "doc_id bigint, text string"
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], schema)).collect() == []
    same = "one two three four five six"
    rows = spark.createDataFrame([(None, same), (3, same), (3, same), (7, same)], schema)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_join(rows).collect()), key=str)
    assert got == [(3, 3), (3, 3), (7, 3), (None, None)]


def test_join_of_ids_with_several_texts(spark):
    a, b, c = ("{0}1 {0}2 {0}3 {0}4 {0}5 {0}6 {0}7".format(x) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, ""), (8, c), (9, c), (9, None), (2, ""), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()]
    want = {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 2: 2, None: None}
    assert sorted(got, key=str) == sorted(((i, want[i]) for i, _ in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(docs).collect()), key=str) == sorted([(3, a), (8, c), (2, ""), (None, b)], key=str)


def test_long_words_of_two_letters_are_told_apart(spark):
    """Words whose polynomial hashes modulo 2**64 agree; also a repeated word of 65 KB."""
    word = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    sizes = (1024, 2048, 4096, 8192)
    rows = [(10 * k + i, word(n, *p)) for k, n in enumerate(sizes) for i, p in enumerate((("t", "h"), ("h", "t")))]
    rows += [(100, "x" * 65_536), (101, "x" * 65_536), (102, "x" * 65_535)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (1, 100 if i == 101 else i) for i, _ in rows}


def test_choice_of_matches():
    assert ngram_join.choose_matches(np.zeros(40), 100, 21, 12) == 1
    costly = np.concatenate([np.full(21, 1000.0), np.zeros(19)])
    assert ngram_join.choose_matches(costly, 100, 21, 12) == 12


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5), (None, 1)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Stage(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{i: 20 for i in range(20, 61)}}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = np.repeat(base, 12, axis=0) + rng.normal(size=(144, 16)) * 0.03
    x = np.vstack([x, x[:10]])
    label = [int(i % 2) if i % 17 else None for i in range(len(x))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (904, [1.0, 2.0], 1), (None, x[0].tolist(), 0), (905, [None] * 16, 1)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))] + odd
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = (unit @ unit.T >= 0.98) & np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(close, False)
    want = roots(range(len(x)), [(int(i), int(j)) for i, j in np.argwhere(close)])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_embeddings(df).collect()}
    assert len(got) == len(rows)
    missed = sum(got[i].n_links != int(close[i].sum()) for i in range(len(x)))
    assert missed <= 3 and all(got[i].n_links <= int(close[i].sum()) for i in range(len(x)))
    assert sum(got[i].component_id != want[i] for i in range(len(x))) <= 3
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903, 904, 905))
    assert got[None].n_links == 0 and got[None].component_id is None
    assert embedding_dedup.near_duplicate_embeddings(df.limit(0)).collect() == []
    # the exact mode loses no link, also of vectors far apart and over several blocks
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    far = (unit @ unit.T >= 0.5) & np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(far, False)
    want = roots(range(len(x)), [(int(i), int(j)) for i, j in np.argwhere(far)])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_embeddings(df, least=0.5, found=1).collect()}
    assert all((got[i].n_links, got[i].component_id) == (int(far[i].sum()), want[i]) for i in range(len(x)))
