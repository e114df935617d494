"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as A-Z-lowered UTF-8 with white space runs as one space. Each benchmark item is cut into
overlapping segments of two lengths: the shorter, densely set, find verbatim excerpts however they are aligned
(from 74 bytes on), the longer allow more edits; an item up to a length is itself a segment. A region of a document leaks a segment if their edit distance is within the segment's edit
budget k. By the q-gram lemma such a region shares at least m - q + 1 - k q of the segment's q-grams, on diagonals
(position in the document less position in the segment) that differ by at most k. So shared q-grams are counted in
diagonal bands of width 2 (k + 1) that overlap by half, which cover every such set of diagonals; bands
that meet the bound are verified by banded alignment, vectorised over candidates. Runs of one repeated q-gram, such as
rules of dashes, are paired as runs with the runs of a segment, whose positions in a band form an interval, and of long
periodic stretches only the ends are searched, since all windows between hold what those hold. The documents are read once and
not shuffled; the benchmark is broadcast in slices of a fixed number of bytes, one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import LOWER, SPACE, U64, chunks, mix, powers, rolling_sums
from lodestone.llm._spark import Stage, ship

#: Length of the q-grams, of segments and the step between them, all in bytes; edits allowed per byte.
Q, SEGMENT, STEP, EDITS = 10, 120, 60, 0.075
#: The same of the shorter segments: of any SHORT + SHORT_STEP - 1 bytes of an item, some are a whole one.
SHORT, SHORT_STEP = 60, 15
#: Benchmark bytes broadcast at a time.
SLICE = 4 << 20
#: Pairs of runs expanded at a time, pairs beyond which periodic stretches are looked for, and their longest period.
PAIRS, MANY, PERIOD = 1 << 20, 1 << 20, 32
_FILTER_BITS = 24


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes with single spaces and none at a document's ends, their offsets, and the place of each in data."""
    low = LOWER[data]
    space = SPACE[low]
    low[space] = 0x20
    n = len(low)
    keep = np.ones(n, dtype=bool)
    if n:
        keep[1:] = ~(space[1:] & space[:-1])
        first = off[:-1][off[:-1] < off[1:]]
        keep[first] = ~space[first]
        # a space that opens a document after dropped ones, or closes it
        place = np.flatnonzero(keep)
        doc = np.searchsorted(off, place, side="right") - 1
        edge = np.zeros(len(place), dtype=bool)
        edge[1:] = doc[1:] != doc[:-1]
        if len(edge):
            edge[0] = True
        last = np.append(edge[1:], True) if len(edge) else edge
        keep[place[(edge | last) & space[place]]] = False
    place = np.flatnonzero(keep)
    return low[place], np.searchsorted(place, off), place


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q bytes from each position on."""
    if len(data) < q:
        return np.zeros(0, dtype=U64)
    sums = rolling_sums(data)
    return mix((sums[q:] - sums[:-q]) * powers(len(sums))["inv"][: len(sums) - q])


class Patterns:
    """Segments of one slice of the benchmark, with their q-grams by hash."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, segment: int = SEGMENT, step: int = STEP, edits: float = EDITS, short: int = SHORT, short_step: int = SHORT_STEP):
        self.q = q
        self.whole: dict[bytes, list[int]] = {}  # items under a q-gram, which leak only as whole texts
        self.item, self.number, self.text = [], [], []
        for item, text in items:
            cuts = set()
            for size, by in ((segment, step), (short, short_step)):
                cuts |= {(0, len(text))} if len(text) <= size else {(a, a + size) for a in range(0, len(text) - size, by)} | {(len(text) - size, len(text))}
            for number, (a, b) in enumerate(sorted(cuts)):
                if b - a < q:
                    self.whole.setdefault(text, []).append(len(self.text))
                self.item.append(item)
                self.number.append(number)
                self.text.append(text[a:b])
        self.item, self.number = np.array(self.item, dtype=np.int64), np.array(self.number, dtype=np.int64)
        size = np.array([len(t) for t in self.text], dtype=np.int64)
        budget = np.floor(size * edits).astype(np.int64)
        # few q-grams survive many edits in a short segment: lower its budget until two must remain
        need = size - q + 1 - budget * q
        while (low := (need < np.minimum(2, size - q + 1)) & (budget > 0)).any():
            budget[low] -= 1
            need = size - q + 1 - budget * q
        self.size, self.budget, self.need = size, budget, need
        # segments of equal text are searched once, as the first of them
        first_of: dict[bytes, int] = {}
        self.same: dict[int, list[int]] = {}
        for s, t in enumerate(self.text):
            self.same.setdefault(first_of.setdefault(t, s), []).append(s)
        hashes, which, low, high = [], [], [], []
        for s in self.same:
            g = gram_hashes(np.frombuffer(self.text[s], dtype=np.uint8), q)
            if len(g):
                start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                hashes.append(g[start])
                which.append(np.full(len(start), s, dtype=np.int32))
                low.append(start.astype(np.int32))
                high.append(np.append(start[1:], len(g)).astype(np.int32) - 1)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        every = join(hashes, U64)
        by = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[by], return_index=True)
        self.first = np.append(first, len(by))
        self.which, self.low, self.high = (join(x, np.int32)[by] for x in (which, low, high))
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _inner(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Positions inside long periodic stretches, so far from both ends that every window there repeats one nearer an end."""
        inner = np.zeros(len(data), dtype=bool)
        reach = int(self.size.max() + 2 * self.budget.max()) + self.q
        for p in range(1, PERIOD + 1):
            if len(data) <= p:
                break
            same = np.zeros(len(data) + 1, dtype=bool)
            same[: len(data) - p] = data[p:] == data[:-p]
            for k in range(p):  # a stretch stays within its document
                edge = off[1:] - 1 - k
                same[edge[edge >= 0]] = False
            cut = np.flatnonzero(~same)
            start, end = np.append(0, cut[:-1] + 1), cut  # data[start : end + p] has the period
            for a, b in zip(start[long := end - start > 2 * (reach + p)], end[long]):
                inner[a + reach + p : b - reach - p] = True
        return inner

    def candidates(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, segment, least diagonal, width) of the bands that meet the q-gram bound; diagonals in positions of data.

        Of segments with equal texts only the first is named. A run of one q-gram may be counted more often than it
        should where a segment has several: that adds candidates, never loses one.
        """
        none = np.zeros(0, dtype=np.int64)
        grams = gram_hashes(data, self.q)
        at = np.flatnonzero(self.maybe[(grams >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return none, none, none, none
        found = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        hit = self.hashes[found] == grams[at]
        at, found = at[hit], found[hit]
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + self.q <= off[doc + 1]
        at, found, doc = at[inside], found[inside], doc[inside]

        def runs(at, found, doc):
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            return at[head], at[np.append(head[1:], len(at)) - 1] if len(at) else at, found[head], doc[head]

        low, high, found_, doc_ = runs(at, found, doc)
        many = self.first[found_ + 1] - self.first[found_]
        if int((many * (1 + (high - low) // 8)).sum()) > MANY:
            keep = ~self._inner(data, off)[at]
            low, high, found_, doc_ = runs(at[keep], found[keep], doc[keep])
            many = self.first[found_ + 1] - self.first[found_]
        # pairs of runs, so many at a time; the hits of each band are added up over the parts
        keys, counts = [], []
        total = np.concatenate([[0], np.cumsum(many)])
        i = 0
        while i < len(low):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
            part = slice(i, j)
            n = many[part]
            row = i + np.repeat(np.arange(j - i), n)
            post = np.repeat(self.first[found_[part]], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            for key, count in self._bands(low[row], high[row], doc_[row], post):
                keys.append(key)
                counts.append(count)
            if sum(map(len, counts)) > 4 * PAIRS:
                keys, counts = self._added(keys, counts)
            i = j
        keys, counts = self._added(keys, counts)
        key, count = (keys[0], counts[0]) if keys else (np.zeros((0, 4), np.int64), none)
        d, s, shift, band = key[count >= np.maximum(1, self.need[key[:, 1]])].T
        half = self.budget[s] + 1
        return d, s, band * 2 * half - shift * half, 2 * half

    def _bands(self, low, high, doc, post):
        """(key, positions) per band of each pair of runs; key: document, segment, shift, band."""
        segment = self.which[post].astype(np.int64)
        start, end = self.low[post].astype(np.int64), self.high[post].astype(np.int64)
        half = self.budget[segment] + 1
        for shift in (0, 1):
            first, last = (low - end + shift * half) // (2 * half), (high - start + shift * half) // (2 * half)
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            band = np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            least = band * 2 * half[row] - shift * half[row]
            # positions p of the run for which some place of the segment's run is on a diagonal of the band
            count = np.minimum(high[row], least + 2 * half[row] - 1 + end[row]) - np.maximum(low[row], least + start[row]) + 1
            for a in range(0, len(row), 4 * PAIRS):
                part = slice(a, a + 4 * PAIRS)
                r = row[part]
                keys, counts = self._added([np.stack([doc[r], segment[r], np.full(len(r), shift), band[part]], axis=1)], [np.maximum(count[part], 0)])
                yield from zip(keys, counts)

    @staticmethod
    def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if not keys:
            return [], []
        key, count = np.concatenate(keys), np.concatenate(counts)
        by = np.lexsort(key.T[::-1])
        key, count = key[by], count[by]
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, np.int64)
        return [key[head]], [np.add.reduceat(count, head) if len(head) else count]

    def align(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, segment: np.ndarray, least: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each candidate's segment against some part of its band, and where that part ends; edits over the budget are not exact."""
        edits, ends = np.full(len(doc), 1 << 20), np.zeros(len(doc), dtype=np.int64)
        padded = np.append(data, 0)
        for m, k in sorted({(int(a), int(b)) for a, b in zip(self.size[segment], self.budget[segment])}):
            mine = np.flatnonzero((self.size[segment] == m) & (self.budget[segment] == k))
            for a in range(0, len(mine), 2048):
                c = mine[a : a + 2048]
                pattern = np.stack([np.frombuffer(self.text[s], dtype=np.uint8) for s in segment[c].tolist()])
                low, high = off[doc[c]][:, None], off[doc[c] + 1][:, None]
                span = np.arange(int(width[c[0]]) + 2 * k)
                column = least[c][:, None] - k + span[None, :]  # place in data before row i: column + i
                big = 1 << 20
                # row 0: any place of the document may begin the part
                row = np.where((column >= low) & (column <= high), 0, big)
                for i in range(m):
                    place = column + i
                    letter = padded[np.clip(place, 0, len(data))]
                    both = np.where((place >= low) & (place < high), row + (letter != pattern[:, i : i + 1]), big)
                    missing = np.append(row[:, 1:], np.full((len(c), 1), big), axis=1) + 1  # a byte of the segment isn't there
                    here = np.minimum(both, missing)
                    here = np.minimum.accumulate(here - span, axis=1) + span  # bytes of the document are extra
                    row = np.where((place + 1 >= low) & (place + 1 <= high), here, big)
                best = row.argmin(axis=1)
                edits[c] = row[np.arange(len(c)), best]
                ends[c] = column[np.arange(len(c)), best] + m
        return edits, ends

    def regions(self, data: np.ndarray, off: np.ndarray):
        """(document, segment, edits, end) of the verified regions, offsets of the normalised texts and the place in data of their bytes."""
        text, cut, place = normalised(data, off)
        doc, segment, least, width = self.candidates(text, cut)
        edits, ends = self.align(text, cut, doc, segment, least, width)
        ok = np.flatnonzero(edits <= self.budget[segment])
        found = [(doc[ok], segment[ok], edits[ok], ends[ok])]
        if self.whole:
            size = np.diff(cut)
            for d in np.flatnonzero((size > 0) & (size < self.q)).tolist():
                if s := self.whole.get(text[cut[d] : cut[d + 1]].tobytes()):
                    found.append((np.array([d]), np.array(s[:1]), np.zeros(1, np.int64), cut[d + 1 : d + 2]))
        doc, segment, edits, ends = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        return doc, segment, edits, ends, cut, place

    def named(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each found segment all those of its text: (index into `segment`, segment)."""
        every = [self.same[s] for s in segment.tolist()]
        return np.repeat(np.arange(len(every)), [len(x) for x in every]), np.array([s for x in every for s in x], dtype=np.int64)


def _scan(patterns):
    """Rows (doc, item, number of the segment in it, edits, start, end) of the verified regions; start and end in characters of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = patterns.value
        for rb in batches:
            for i, _, data, off in chunks(rb.column(1)):
                doc, segment, edits, ends, cut, place = p.regions(data, off)
                if not len(doc):
                    continue
                starts = np.maximum(ends - p.size[segment], cut[doc])
                # characters before each byte of the batch, to count from the document's start
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin, end = char[place[starts]] - char[off[doc]], char[place[ends - 1] + 1] - char[off[doc]]
                row, every = p.named(segment)
                yield pa.record_batch([rb.column(0).take(pa.array(i + doc[row])), pa.array(p.item[every]), pa.array(p.number[every]), *(pa.array(x[row].astype(np.int64)) for x in (edits, begin, end))], ["doc_id", "item_id", "at", "edits", "begin", "end"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """(id, item, n_segments, min_edits, begin, end): one row per document and benchmark item that it leaks.

    n_segments: the item's segments found; begin, end: span of the found regions in characters of the text, end
    exclusive. A document without a row is clean. Null or empty texts, and items with a null id, leak nothing; an item
    shorter than a q-gram leaks only as the whole of a text. Repeated items count each under its id, repeated documents are returned
    once with the widest span; ids are longs. Other columns aren't read. No rows on either side give no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "decontaminate")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, at long, edits long, begin long, end long"
    out = None
    for items in _slices(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), slice_bytes):
        part = texts.mapInArrow(_scan(spark.sparkContext.broadcast(Patterns(items))), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    out = stage.save(out, "regions")
    return out.groupBy(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col)).agg(F.count_distinct("at").alias("n_segments"), F.min("edits").alias("min_edits"), F.min("begin").alias("begin"), F.max("end").alias("end"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """The rows of docs, with all their columns, that leak no benchmark item."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(patterns):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                keep = np.ones(rb.num_rows, dtype=bool)
                for i, _, data, off in chunks(rb.column(at)):
                    keep[i + patterns.value.regions(data, off)[0]] = False
                yield rb.filter(pa.array(keep))

        return run

    for items in _slices(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), slice_bytes):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(Patterns(items))), docs.schema)
    return docs


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The normalised items, at most about `limit` bytes at a time; never the whole benchmark on the driver."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(row.text.encode("utf-8", "replace"), dtype=np.uint8)
        text = normalised(data, np.array([0, len(data)]))[0].tobytes()
        if not text:
            continue
        held.append((row.item_id, text))
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
