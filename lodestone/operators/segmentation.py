"""Segmentation of runs without spaces: the best path through a lattice of known words.

A unigram model is counted over texts that have spaces, or given as counts. A run of letters is cut so that the sum of its
words' log probabilities is largest; what no word covers goes by single characters at a floor. Search mode
gives the known two- and three-letter parts of a longer word before the word itself, so that a question for a part finds it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.functions.text import raw_tokens
from lodestone.session import ship

#: Words that a model holds at most, the most frequent ones (a bound of the model, about 250 bytes a word in a worker), and letters of a word.
MOST_WORDS, LONGEST = 500_000, 20
#: Costs (letters x longest word) of the runs cut side by side, and letters of a run that is cut among others.
CELLS, TALL = 1 << 20, 1024
#: Hashes of words: polynomials of this base, times MIX, whose first bits name the bucket; 2 ** SPARSE buckets a word. NONE is no letter.
BASE, MIX, SPARSE, NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 2, 0xFFFFFFFF


def word_model(texts: DataFrame, text_col: str = "text", least: int = 2, most: int = MOST_WORDS) -> DataFrame:
    """(word, n) of the tokens that occur `least` times in all texts and have LONGEST letters at most; the `most` most frequent, ties by word."""
    words = texts.select(F.explode(raw_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= least) & (F.length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(most)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """Best cuts by a unigram model; ties go to the longer last word."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(sum(counts.values()) or 1)
        self.cost = {w: total - math.log(n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.floor = total + math.log(2)

    def words(self, run: str) -> list[str]:
        """The cut of one run, a letter at a time."""
        cost, longest = self.cost, self.longest
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            low, at = math.inf, end - 1
            for start in range(max(0, end - longest), end):
                c = cost.get(run[start:end])
                if c is None:
                    if start < end - 1:
                        continue
                    c = self.floor
                if best[start] + c < low:
                    low, at = best[start] + c, start
            best.append(low)
            back.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def all_words(self, runs: list[str]) -> list[list[str]]:
        """words() of each run: runs of like lengths are cut side by side; a run over TALL letters goes by itself."""
        out: list[list[str]] = [[] for _ in runs]
        order = sorted((i for i in range(len(runs)) if 0 < len(runs[i]) <= TALL), key=lambda i: len(runs[i]))
        while order:
            size = len(runs[order[-1]])
            some = order[-max(1, CELLS // (size * min(size, self.longest))) :]
            del order[-len(some) :]
            for i, words in zip(some, self._beside([runs[i] for i in some])):
                out[i] = words
        for i, run in enumerate(runs):
            if len(run) > TALL:
                out[i] = self.words(run)
        return out

    def _beside(self, runs: list[str]) -> list[list[str]]:
        """A letter of all runs is a row, so each step of the best path is taken for all of them."""
        sizes = np.array([len(r) for r in runs])
        height, wide, longest = int(sizes.max()), len(runs), min(self.longest, int(sizes.max()))
        letters = np.full((wide, height), NONE, np.uint32)
        letters[np.arange(height) < sizes[:, None]] = _letters("".join(runs))
        letters = np.ascontiguousarray(letters.T)
        # by the end of a word: costs[end, i] is that of the word of longest - i letters, longer ones first
        costs = np.full((height + 1, longest, wide), np.inf)
        costs[1:, longest - 1] = self.floor
        key = np.zeros_like(letters, np.uint64)
        for size in range(1, longest + 1):
            key = key[: height - size + 1] * BASE + letters[size - 1 :]
            if size in self._tables:
                start, run, cost = self._known(key, letters, size)
                costs[start + size, longest - size, run] = cost
        best = np.full((height + longest + 1, wide), np.inf)  # rows before the first letter stay out of reach
        best[longest] = 0.0
        back = np.zeros((height + 1, wide), np.int32)
        for end in range(1, height + 1):
            reached = best[end : end + longest] + costs[end]
            first = reached.argmin(axis=0)
            back[end] = longest - first
            best[end + longest] = reached[first, np.arange(wide)]
        out = []
        for run, size, steps in zip(runs, sizes.tolist(), back.T.tolist()):
            words = []
            while size:
                words.append(run[size - steps[size] : size])
                size -= steps[size]
            out.append(words[::-1])
        return out

    @functools.cached_property
    def _tables(self) -> dict[int, tuple[np.ndarray, ...]]:
        """The words of each length by hash: hashes in order, costs, letters (a word a column), and where each bucket of hashes begins."""
        by_size: dict[int, list[str]] = {}
        for word in self.cost:
            by_size.setdefault(len(word), []).append(word)
        out = {}
        for size, words in by_size.items():
            letters = _letters("".join(words)).reshape(len(words), size).T
            key = np.zeros(len(words), np.uint64)
            for row in letters:
                key = key * BASE + row
            key *= MIX
            order = np.argsort(key)
            bits = len(words).bit_length() + SPARSE
            first = np.searchsorted(key[order], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            out[size] = key[order], np.array([self.cost[w] for w in words])[order], letters[:, order], np.append(first, len(words)).astype(np.int32)
        return out

    def _known(self, key: np.ndarray, letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words of that many letters begin (row, run) and what they cost. Equal hashes are held against the letters themselves."""
        keys, cost, known, first = self._tables[size]
        key = (key * MIX).ravel()
        bucket = (key >> np.uint64(65 - len(first).bit_length())).astype(np.int32)
        at = first[bucket]
        left = np.flatnonzero(at < first[1:][bucket])
        at, end, mine = at[left], first[1:][bucket[left]], key[left]
        found, which = [], []
        while len(left):
            same = keys[at] == mine
            found.append(left[same])
            which.append(at[same])
            at = at + 1
            more = at < end
            left, at, end, mine = left[more], at[more], end[more], mine[more]
        found, which = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found, which))
        flat, wide = letters.ravel(), letters.shape[1]
        for i in range(size):
            equal = flat[found + i * wide] == known[i, which]
            found, which = found[equal], which[equal]
        start, run = np.divmod(found, wide)
        return start, run, cost[which]

    def search_words(self, run: str) -> list[str]:
        return self.with_parts(self.words(run))

    def with_parts(self, words: list[str]) -> list[str]:
        """Each word of a cut, before it its known parts of two and three letters."""
        out = []
        for word in words:
            for size in (2, 3):
                if len(word) > size:
                    out += [word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in self.cost]
            out.append(word)
        return out


def _runs(text_col: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), 0), F.array().cast("array<string>"))


def segmented(texts: DataFrame, model: DataFrame, text_col: str = "text", out: str = "tokens", search: bool = True) -> DataFrame:
    """texts with their tokens: runs of letters and digits, lowered, cut by the model (word, n).

    search: with the known parts of long words. A null text has none. The model is collected and broadcast; word_model bounds it.
    """
    spark = texts.sparkSession
    ship(spark)
    lattice = spark.sparkContext.broadcast(Lattice({r.word: r.n for r in model.toLocalIterator()}))
    kept = [f for f in texts.schema.fields if f.name != out]
    runs = texts.withColumn("_runs", _runs(text_col)).select(*[f.name for f in kept], "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lattice.value
        for rb in batches:
            lists = rb.column(rb.num_columns - 1).to_pylist()
            words = iter(cut.all_words([r for runs in lists for r in runs]))
            tokens = [[w for _ in runs for w in (cut.with_parts(next(words)) if search else next(words))] for runs in lists]
            yield pa.record_batch([*rb.columns[:-1], pa.array(tokens, pa.list_(pa.string()))], [*rb.schema.names[:-1], out])

    return runs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))]))


def word_counts(texts: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each word comes out of all texts. A run is cut once however often it stands, and runs are dealt by a shuffle, not by the files of the texts."""
    runs = texts.select(F.explode(_runs(text_col)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    cut = segmented(runs, model, "run", search=False)
    return cut.select(F.explode("tokens").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))
