"""Cuts against a plain search over all of them, and how many words of the documents come back."""

import collections
import itertools
import math
import random

from pyspark.sql import functions as F

from lodestone.operators import segmentation
from lodestone.operators.segmentation import Lattice, segmented, word_model


def plain(run, counts):
    """The cheapest of all cuts, by trying each."""
    total = sum(counts.values())
    cost = lambda w: math.log(total) - math.log(counts[w]) if w in counts else math.log(2 * total) if len(w) == 1 else math.inf
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        best = min(best, sum(cost(run[a:b]) for a, b in zip(at, at[1:])))
    return best, cost


def test_best_path_equals_all_cuts():
    rng = random.Random(1)
    counts = collections.Counter("".join(rng.choice("ab超声") for _ in range(rng.randint(1, 4))) for _ in range(60))
    lattice = Lattice(counts)
    for _ in range(300):
        run = "".join(rng.choice("ab超声z") for _ in range(rng.randint(1, 9)))
        best, cost = plain(run, counts)
        words = lattice.words(run)
        assert "".join(words) == run and abs(sum(map(cost, words)) - best) < 1e-9
    assert lattice.words("") == [] and Lattice({}).words("ab") == ["a", "b"]


def test_many_runs_at_once_equal_each_by_itself(monkeypatch):
    """All runs side by side give the cuts of each by itself, ties too, and far fewer steps than letters times words' lengths."""
    rng = random.Random(2)
    for alphabet, floor in (("ab超声", 1), ("éab\U00020000", 1), ("a", 3)):
        counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(floor, 6))): rng.choice([1, 1, 2, 9]) for _ in range(40)}
        lattice = Lattice(counts)
        runs = ["".join(rng.choice(alphabet + "z") for _ in range(rng.choice([0, 1, 5, 30, 70]))) for _ in range(300)] + ["ab" * 40]
        want = [lattice.words(r) for r in runs]
        assert lattice.all_words(runs) == want
        monkeypatch.setattr(segmentation, "CELLS", 100)
        monkeypatch.setattr(segmentation, "TALL", 60)
        assert lattice.all_words(runs) == want
        monkeypatch.undo()
    assert Lattice({}).all_words(["ab", "", "c"]) == [["a", "b"], [], ["c"]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(segmentation, "BASE", segmentation.np.uint64(1))  # words of the same letters hash alike
    assert Lattice({"abc": 5, "acb": 7, "x": 1}).all_words(["bcaabcx", "cabacb"]) == [["b", "c", "a", "abc", "x"], ["c", "a", "b", "acb"]]


def test_words_are_counted_over_distinct_runs(spark, monkeypatch):
    """A run that stands a thousand times is cut once."""
    given = []
    cut = segmentation.segmented
    monkeypatch.setattr(segmentation, "segmented", lambda texts, *a, **k: given.append(texts) or cut(texts, *a, **k))
    model = spark.createDataFrame([("ab", 5), ("cd", 4)], "word string, n long")
    texts = spark.createDataFrame([("abcd, AB",)] * 1000 + [("cdx",), (None,), ("",)], "text string").coalesce(1)
    found = segmentation.word_counts(texts, model)
    assert {r.term: r.n for r in found.collect()} == {"ab": 2000, "cd": 1001, "x": 1} and dict(found.dtypes)["n"] == "bigint"
    assert sorted(r.run for r in given[0].collect()) == ["ab", "abcd", "cdx"]


def test_search_mode_gives_parts(spark):
    model = spark.createDataFrame([("超声", 5), ("诊断", 4), ("超声诊断", 9), ("仪", 1)], "word string, n long")
    rows = segmented(spark.createDataFrame([(1, "超声诊断仪, X1"), (2, None), (3, "")], "id int, text string"), model).orderBy("id").collect()
    assert [r.tokens for r in rows] == [["超声", "诊断", "超声诊断", "仪", "x", "1"], [], []]


def test_words_come_back(spark, sf_dir):
    """Spaces out of every tenth document, words from the others: word F1 over spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    model = word_model(docs.where("doc_id % 10 <> 0"))
    runs = docs.where("doc_id % 10 = 0 and text is not null").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\s]", " "), r"\s+", " ").alias("text"))
    found = segmented(runs.select("doc_id", "text", F.regexp_replace("text", " ", "").alias("run")), model, "run", search=False).collect()
    spans = lambda words: set(zip(itertools.accumulate(map(len, words), initial=0), itertools.accumulate(map(len, words))))
    hits = size = want = 0
    for r in found:
        a, b = spans(r.tokens), spans(r.text.split())
        hits, size, want = hits + len(a & b), size + len(a), want + len(b)
    f1 = 2 * hits / (size + want)
    print("word F1", f1, want)
    assert want > 500 and f1 > 0.4  # the words are invented, many of them stand once
