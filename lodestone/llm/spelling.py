"""Spelling variants: near words by forward and backward minimal acyclic automata.

If one edit turns a word into another, either its first half stands unchanged at the other's beginning or its
second half at the other's end (Mihov and Schulz, "Fast Approximate Search in Large Dictionaries", 2004). So every
word is dealt by the halves that words of its length and of one more or less could ask for, forward and reversed, and
every word asks under its own two halves. A unit of work builds one minimal acyclic automaton of the words
dealt to it, in which the sum of the skips on a path is the word's place in sorted order (a perfect hash), walks the
half exactly and completes it with one error. Two ways to one word meet in its number; a word that the forward
search finds is skipped by the backward one. Halves that very many words share are split into slices, and
the words that ask visit all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._spark import Stage

#: Distinct words a counting task holds before it hands them on; words of one automaton; rows of one task aimed at.
HELD, SLICE, ROWS = 300_000, 20_000, 100_000
#: Characters of a text that are split into runs at a time.
PART = 1 << 20

RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; numbers are places in their order."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        path, last = [(False, {})], ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            self._shorten(path, last, same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._shorten(path, last, 0)
        self.root = self._state(*path[0])
        del self._known, self._sizes

    def _shorten(self, path: list, last: str, depth: int) -> None:
        """Turn the open nodes below `depth` into states."""
        while len(path) > depth + 1:
            done = self._state(*path.pop())
            path[-1][1][last[len(path) - 1]] = done

    def _state(self, final: bool, targets: dict[str, int]) -> int:
        key = (final, *targets.items())
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.edges)
            size, edges = int(final), {}
            for letter, target in targets.items():
                edges[letter] = (target, size)
                size += self._sizes[target]
            self.edges.append(edges)
            self.final.append(final)
            self._sizes.append(size)
        return at

    def _rest(self, state: int, number: int, rest: str) -> int:
        """Number of the word that `rest` completes from a state, or -1."""
        edges = self.edges
        for letter in rest:
            step = edges[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def one_edit(self, word: str, exact: int) -> set[int]:
        """Numbers of the words one insertion, deletion or replacement away, made after the first `exact` letters."""
        state, number, found = self.root, 0, set()
        for letter in word[:exact]:
            step = self.edges[state].get(letter)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for i in range(exact, len(word) + 1):
            here, rest = word[i : i + 1], word[i + 1 :]
            for letter, (target, skip) in self.edges[state].items():
                found.add(self._rest(target, number + skip, here + rest))
                if here and letter != here:
                    found.add(self._rest(target, number + skip, rest))
            if not here:
                break
            found.add(self._rest(state, number, rest))
            step = self.edges[state].get(here)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def _parts(text: str) -> Iterator[bytes]:
    """The text in Latin-1, A-Z lowered, other characters as marks; long ones in parts that break no run."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        raw = text[at:end].encode("latin-1", "replace").lower()
        if end < len(text):
            whole = len(raw)
            while whole and (0x61 <= raw[whole - 1] <= 0x7A or raw[whole - 1] >= 0xC0):
                whole -= 1
            if not whole:  # a run longer than a part
                tail = re.match(r"[A-Za-zÀ-ÿ]*", text[end:]).end()
                raw += text[end : end + tail].encode("latin-1").lower()
                whole = len(raw)
            raw = raw[:whole]
        yield raw
        at += len(raw)


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lowered, of at least `shortest` letters, that occur at least `least` times.

    Whole texts are read. slip: a run whose crc32 of `<id>:<run>` it divides loses the letter at that number modulo
    its length, a reproducible typing error. A null text has no runs; a null id makes no slips; rows that repeat an id or a text count
    each; other columns aren't read; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for rb in batches:
            for key, text in zip(rb.column(0), rb.column(1)):
                key, text = key.as_py(), text.as_py()
                base = None if slip is None or key is None else zlib.crc32(f"{key}:".encode())
                for raw in _parts(text or ""):
                    for word, n in Counter(RUN.findall(raw)).items():
                        if base is not None:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
                            if h % slip == 0:
                                h %= len(word)
                                word = word[:h] + word[h + 1 :]
                        if len(word) >= shortest:
                            held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) of rows in order of unit, dictionary before questions, spelling: each unit's automaton, then its questions as they stream by."""
    unit, words, counts, automaton = None, [], [], None
    for rb in batches:
        at, near, near_n = [], [], []
        for backward, half, part, asks, spelled, n in zip(*(c.to_pylist() for c in rb.columns)):
            if unit != (backward, half, part):
                unit, words, counts, automaton = (backward, half, part), [], [], None
            if not asks:
                words.append(spelled)
                counts.append(n)
                continue
            if automaton is None:
                automaton = Automaton(words)
            other = spelled[half:]
            for k in automaton.one_edit(spelled, half):
                found = words[k]
                if backward and found.endswith(other):  # found forward
                    continue
                at.append(spelled[::-1] if backward else spelled)
                near.append(found[::-1] if backward else found)
                near_n.append(counts[k])
        if at:
            yield pa.record_batch([pa.array(at), pa.array(near), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, stage: Stage) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) that differ by exactly one code point inserted, deleted or replaced."""
    size = F.length("word")
    rows = []
    for backward in (False, True):
        spelled = F.reverse("word") if backward else F.col("word")
        mine = (size - F.floor(size / 2)) if backward else F.floor(size / 2)
        # the halves that words shorter by one, as long and longer by one ask for
        asked = [F.floor((size + d) / 2) + (F.pmod(size + d, F.lit(2)) if backward else 0) for d in (-1, 0, 1)]
        for asks, halves in ((False, F.array_distinct(F.array(*[a.cast("int") for a in asked]))), (True, F.array(mine.cast("int")))):
            rows.append(words.select(F.lit(backward).alias("backward"), F.explode(halves).alias("half"), F.lit(asks).alias("asks"), spelled.alias("spelled"), "n"))
    dealt = rows[0]
    for more in rows[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.where("half > 0").withColumn("key", F.expr("substring(spelled, 1, half)"))
    many = dealt.where("not asks").groupBy("backward", "half", "key").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("slices > 1")
    many = stage.save(many, "many")
    by = ["backward", "half", "key"]
    dealt = dealt.join(many, by, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("spelled"), "slices").cast("int")))))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-6 * words.count() // ROWS))
    dealt = dealt.repartition(parts, *by, "part").sortWithinPartitions("backward", "half", "part", "asks", "spelled")
    return dealt.select("backward", "half", "part", "asks", "spelled", "n").mapInArrow(_search, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least `factor` times the
    word's own, else null; root: the last word on the way of forms, the word itself where it has none; n_near: near
    words, 0 if none. factor must be over 1, so that forms lead to ever larger counts and end. A null word or n is left
    out, words that repeat are added up, no rows give no rows.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    stage = Stage(words.sparkSession, "spelling")
    words = stage.save(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = near_words(words, stage).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.join(near, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    formed = formed.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"))
    formed = stage.save(formed, "formed")
    # pointers double their reach in each round; the way ends as counts grow by the factor at each step
    links, i = stage.save(formed.where("form is not null").select("word", F.col("form").alias("to")), "links-0"), 0
    while True:
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        jumped = stage.save(links.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"links-{i + 1}")
        stage.drop(f"links-{i}")
        links, i = jumped.select("word", "to"), i + 1
        if not jumped.where("moved").limit(1).count():
            break
    return formed.join(links.withColumnRenamed("to", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
