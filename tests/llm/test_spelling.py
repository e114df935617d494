"""Automata, near words and forms against plain versions."""

import collections
import random
import re
import zlib

import pytest

from lodestone.llm import spelling
from lodestone.llm._spark import Stage
from lodestone.llm.queries import op13_spelling_variants
from lodestone.llm.spelling import Automaton


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=2):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and differ_by_one(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(rows, slip=97):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if slip and i is not None and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_words(seed, n, letters="abé", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_automaton_numbers_and_edits():
    words = some_words(1, 400)
    a = Automaton(words)
    assert [a._rest(a.root, 0, w) for w in words] == list(range(len(words)))
    assert a._rest(a.root, 0, "zz") == -1
    for w in words + some_words(2, 50):
        for exact in range(len(w) + 1):
            want = {i for i, x in enumerate(words) if x.startswith(w[:exact]) and x != w and differ_by_one(w[exact:], x[exact:])}
            assert a.one_edit(w, exact) == want
    assert Automaton([]).one_edit("abc", 0) == set()
    # minimal: states differ in what they accept
    accepts = lambda s: (a.final[s], tuple(sorted((c, t) for c, (t, _) in a.edges[s].items())))
    assert len({accepts(s) for s in range(len(a.edges))}) == len(a.edges)


@pytest.mark.parametrize("size", [20_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, size):
    """With one automaton for each half, and with halves split into slices of three words."""
    monkeypatch.setattr(spelling, "SLICE", size)
    rng = random.Random(3)
    counts = {w: rng.choice([3, 3, 4, 6, 7, 12, 30, 60, 60]) for w in some_words(5, 700, "abcé", 8) if len(w) >= 5}
    df = spark.createDataFrame([(w, n, "x", 1, True) for w, n in counts.items()], "word string, n long, key string, half int, backward boolean")
    assert rows_of(spelling.spelling_variants(df)) == plain(counts)


def test_long_ways_and_ties(spark):
    way = ["aaaaaaaa"[:i] + "b" * (8 - i) for i in range(9)]
    counts = {w: 3 * 2**i for i, w in enumerate(way)} | {"zzzzz": 5, "zzzzy": 10, "zzzyz": 10, "lonely": 3}
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain(counts)
    assert got[way[0]][1] == way[-1] and got["zzzzz"][0] == "zzzyz" and got["lonely"] == (None, "lonely", 3, 0, None)
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_null_repeated_and_no_words(spark):
    df = spark.createDataFrame([("abcde", 2), ("abcde", 1), (None, 4), ("abcdf", None), ("abcdg", 6)], "word string, n long")
    assert rows_of(spelling.spelling_variants(df)) == plain({"abcde": 3, "abcdg": 6})
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_counts_of_texts(spark, monkeypatch):
    """Nulls, repeated ids, letters of Latin-1 with its two signs, other scripts, runs and texts longer than a part."""
    rng = random.Random(8)
    vocabulary = ["Maison", "maisons", "Élanée", "×÷ÿÀab", "straße", "word", "longer", "œuvre", "x" * 70]
    texts = [None, "", " ", "中文maison中", "a" * 300, *[rng.choice([" ", "-", "7"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(150)]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])] * 3
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    for part in (1 << 20, 40):
        monkeypatch.setattr(spelling, "PART", part)
        got = {r.word: r.n for r in spelling.word_counts(df, slip=97).collect()}
        assert got == plain_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == plain_counts(rows, None)
    assert spelling.word_counts(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows)
    assert len(counts) > 100
    assert rows_of(op13_spelling_variants(spark, sf_dir)) == plain(counts)


def test_pairs_come_once(spark):
    words = spark.createDataFrame([(w, 3) for w in some_words(11, 300, "ab", 9) if len(w) >= 5], "word string, n long")
    found = [(r.word, r.near) for r in spelling.near_words(words, Stage(spark, "t")).collect()]
    assert len(found) == len(set(found)) > 0
