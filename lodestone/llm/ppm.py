"""Language-model scoring: prediction by partial matching over bytes, and a unigram base score.

The model is pretrained on the training documents of the corpus: counts of (context, byte) for contexts of
up to ORDER bytes, of the A-Z-lowered UTF-8 text with one end symbol. A symbol not seen after a
context escapes to the next shorter one (method C: d / (T + d) with d distinct symbols among T),
where the symbols of the longer context are excluded; below order 0 the symbols not yet excluded are
equally likely. The symbols seen after a context are a subset of those seen after its suffix,
so the exclusion set at each step is fixed by the context just left, and each context has four costs: of its
total and of its escape, where it is met first and where it was left for its suffix. A symbol's cost is then a
walk down the suffixes of its context, vectorised over symbols.

Counts are taken over all training documents and shuffled by context, and all of them are used. Texts meet the model by
a join, at every size alike: a group of documents asks for each of its distinct (context, symbol) once, at the bucket that
holds the context, and adds up the costs that come back. A bucket is the trie below some last symbols of contexts, so it
holds all longer suffixes too; the few contexts shorter than those go with every bucket. Frequent buckets
are dealt over salts with a copy of their cells. Work and shuffles grow with the texts, not with texts times model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import LOWER, SPACE, chunks, prefix_sums, span_hashes, spans
from lodestone.llm._spark import Stage, units

#: Longest context in bytes (packed n-grams hold 6 at most), and the seen (context, symbol) cells of a bucket.
ORDER, MOST_CELLS = 5, 1 << 17
#: Last symbols of a context that decide its bucket; where those have more cells, a hash of the one before does as well.
SHARED = 2
#: Symbols in packed n-grams: a byte + 1, END, or 0 for "before the text".
END, BITS = 257, 9
#: Symbols whose packed n-grams are held at a time, and text bytes whose questions to one bucket are a unit of work on the average.
WINDOW, SPAN = 512 << 10, 32 << 20
#: Shuffle partitions at most; beyond, a task takes several units one after another.
MOST_PARTS = 20_000


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents in a row, each with its end symbol: values, first index of each document (n + 1)."""
    n = len(off) - 1
    at = off + np.arange(n + 1)
    out = np.empty(len(data) + n, dtype=np.uint16)
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = LOWER[data]
    out[keep] += 1
    out[~keep] = END
    return out, at


def _windows(data: np.ndarray, off: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Each symbol packed with the `order` symbols before it in its document, the symbol lowest, a window at a time.

    Codes of a window, its first document, and where in the window each of its documents begins (0 if before it).
    """
    symbols, at = _symbols(data, off)
    for s in range(0, len(symbols), WINDOW):
        e = min(s + WINDOW, len(symbols))
        code = symbols[s:e].astype(np.int64)
        lo = int(np.searchsorted(at, s, side="right")) - 1
        starts = at[lo : np.searchsorted(at, e)]
        for j in range(1, order + 1):
            back, a = np.zeros(e - s, dtype=np.int64), max(s - j, 0)
            if e - j > a:
                back[a + j - s :] = symbols[a : e - j]
            for i in range(j):
                place = starts + i
                back[place[(place >= s) & (place < e)] - s] = 0
            code |= back << (BITS * j)
        yield code, lo, np.maximum(starts - s, 0)


def _grams(order: int):
    """Counts of all (context of `order` symbols, symbol) of one partition, in bounded runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(inverse, weights=np.concatenate([n for _, n in held]), minlength=len(code)).astype(np.int64)

        for rb in batches:
            for _, _, data, off in chunks(rb.column(0)):
                for codes, _, _ in _windows(data, off, order):
                    held.append(np.unique(codes, return_counts=True))
                    size += len(held[-1][0])
                    if size > 1_000_000:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > 750_000:
                            yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], ["gram", "n"])
                            held, size = [], 0
        if held:
            code, n = merged()
            for i in range(0, len(code), 100_000):
                yield pa.record_batch([pa.array(code[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["gram", "n"])

    return run


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trie:
    """One bucket of the model: its seen cells by order, and what its contexts cost."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for each order from 0 the packed (context, symbol), the symbol lowest, and their counts."""
        self.grams, self.log_n, self.contexts, self.costs = [], [], [], []
        before = None
        for j, (gram, n) in enumerate(levels):
            by = np.argsort(gram)
            gram, n = gram[by], n[by].astype(np.float64)
            context, start, row = np.unique(gram >> BITS, return_index=True, return_inverse=True)
            seen = np.diff(np.append(start, len(gram))).astype(np.float64)
            total = np.bincount(row, weights=n, minlength=len(context))
            costs = np.zeros((4, len(context)))  # met first: total, escape; left for its suffix: the same there without its symbols
            costs[0], costs[1] = -np.log10(total + seen), np.log10(seen / (total + seen))
            if j:
                same, _ = _find(self.grams[-1], gram & (1 << BITS * j) - 1)
                up, _ = _find(self.contexts[-1], context & (1 << BITS * (j - 1)) - 1)
                t = before[1][up] - np.bincount(row, weights=before[0][same], minlength=len(context))
                d = before[2][up] - seen
                left = d > 0
                costs[2, left], costs[3, left] = -np.log10(t[left] + d[left]), np.log10(d[left] / (t[left] + d[left]))
            self.grams.append(gram)
            self.log_n.append(np.log10(n))
            self.contexts.append(context)
            self.costs.append(costs)
            before = n, total, seen
        self.unseen = -np.log10(max(1, 257 - len(self.grams[0])))  # 256 bytes and END

    def costs_of(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each packed symbol after its context, by escapes from the longest seen context down."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        below, longer, costs = np.zeros(len(code), dtype=bool), left, None
        for j in range(len(self.grams) - 1, -1, -1):
            at, seen = _find(self.contexts[j], (code[left] >> BITS) & (1 << BITS * j) - 1)
            cell, hit = _find(self.grams[j], code[left] & (1 << BITS * (j + 1)) - 1)
            for here, which, add, of in ((seen & ~below, at, 0, self.costs[j]), (below, longer, 2, costs)):
                got, gone = np.flatnonzero(here & hit), np.flatnonzero(here & ~hit)
                if len(got):
                    out[left[got]] += self.log_n[j][cell[got]] + of[add][which[got]]
                if len(gone):
                    out[left[gone]] += of[add + 1][which[gone]]
            left, below, longer, costs = left[~hit], seen[~hit], at[~hit], self.costs[j]
        out[left] += self.unseen
        return out


class Owners:
    """Which bucket holds a context: of the first bucket of its last SHARED symbols, and how many those are dealt over by the symbol before."""

    def __init__(self, cells: list[tuple[int, int]], most_cells: int):
        """cells: the number of cells under each packed SHARED symbols."""
        self.first, self.subs = np.zeros(1 << BITS * SHARED, np.int32), np.ones(1 << BITS * SHARED, np.int32)
        bucket, size = 0, 0
        for key, n in sorted(cells):
            if size and size + n > most_cells:
                bucket, size = bucket + 1, 0
            self.first[key], size = bucket, size + n
            if n > most_cells:
                self.subs[key] = min(END, -(-n // most_cells))
                bucket, size = bucket + int(self.subs[key]), 0
        self.buckets = bucket + 1

    def key(self, code: np.ndarray) -> np.ndarray:
        return (code >> BITS) & (1 << BITS * SHARED) - 1

    def of(self, code: np.ndarray) -> np.ndarray:
        key, third = self.key(code), (code >> BITS * (SHARED + 1)) & (1 << BITS) - 1
        return self.first[key] + (third * 40_503 >> 4) % self.subs[key]


class Model:
    """All seen cells: those of contexts of SHARED or more symbols as a table, the shorter ones at hand, and who holds which."""

    def __init__(self, nodes: DataFrame, short: list[tuple[np.ndarray, np.ndarray]], owners: Owners, order: int):
        self.nodes, self.short, self.owners, self.order = nodes, short, owners, order


def train(texts: DataFrame, stage: Stage, order: int = ORDER, most_cells: int = MOST_CELLS) -> Model:
    """The model of all texts, in buckets of about most_cells seen (context, symbol) cells; contexts that share three last symbols stay together."""
    if not 0 <= order <= 6:
        raise ValueError("order must be from 0 to 6")
    counts = stage.save(texts.mapInArrow(_grams(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    orders = F.array(*[F.struct(F.lit(j).alias("j"), F.col("gram").bitwiseAND((1 << BITS * (j + 1)) - 1).alias("gram")) for j in range(order + 1)])
    nodes = stage.save(counts.select(F.explode(orders).alias("o"), "n").groupBy("o.j", "o.gram").agg(F.sum("n").alias("n")), "nodes")
    stage.drop("grams")
    found = nodes.where(F.col("j") < SHARED).toArrow()  # 257 + 258 * 257 cells at most
    j, gram, n = (found.column(i).to_numpy().astype(np.int64) for i in range(3))
    nodes = nodes.where(F.col("j") >= SHARED)
    key = F.shiftright("gram", BITS).bitwiseAND((1 << BITS * SHARED) - 1)
    cells = [tuple(r) for r in nodes.groupBy(key).count().collect()]  # 66,049 keys at most
    return Model(nodes, [(gram[j == i], n[j == i]) for i in range(min(order + 1, SHARED))], Owners(cells, most_cells), order)


def _squeeze(x: np.ndarray, planes: bool = True) -> bytes:
    """An array's length and its bytes, compressed; as planes, byte by byte from the lowest, where high bytes are mostly zero."""
    raw = np.ascontiguousarray(x).view(np.uint8)
    raw = raw.reshape(-1, x.itemsize).T.tobytes() if planes else raw.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: pa.Scalar, kind: type, planes: bool = True) -> np.ndarray:
    buffer, size = packed.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(buffer[:8], "little")
    raw = np.frombuffer(pa.decompress(buffer[8:], n * size, codec="zstd"), dtype=np.uint8)
    return (np.ascontiguousarray(raw.reshape(size, -1).T) if planes else raw).reshape(-1).view(kind)


UNIT = "bucket int, salt int, grp long, j int, gram long, n long, keys binary"


def _deal(owners, salts: int):
    """Cells with the units of work that need them: every salt of their bucket, and those of SHARED symbols every bucket of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = owners.value
        for rb in batches:
            j, gram, n = (rb.column(i).to_numpy().astype(np.int64) for i in range(3))
            times = np.where(j == SHARED, own.subs[own.key(gram)], 1)
            at = np.repeat(np.arange(len(j)), times)
            sub = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            bucket = np.where(j[at] == SHARED, own.first[own.key(gram[at])] + sub, own.of(gram[at]))
            for salt in range(salts):
                m = len(at)
                columns = [bucket.astype(np.int32), np.full(m, salt, np.int32), np.full(m, -1, np.int64), j[at].astype(np.int32), gram[at], n[at]]
                yield pa.record_batch([*map(pa.array, columns), pa.nulls(m, pa.binary())], [c.split()[0] for c in UNIT.split(", ")])

    return run


def _answer(short, order: int):
    """Costs of each group's codes. Rows come by unit, its cells first; they are held as a trie while the questions go by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, trie = None, [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            k = np.stack([rb.column(0).to_numpy(), rb.column(1).to_numpy(), rb.column(2).to_numpy() < 0], axis=1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(cut[:-1], cut[1:]):
                if (unit := tuple(k[a, :2].tolist())) != key:
                    key, held, trie = unit, [], None
                if k[a, 2]:
                    held.append(np.stack([rb.column(c).slice(a, b - a).to_numpy().astype(np.int64) for c in (3, 4, 5)]))
                    continue
                if trie is None:
                    j, gram, n = np.concatenate([np.zeros((3, 0), np.int64), *held], axis=1)
                    held, trie = [], Trie([*short.value, *((gram[j == i], n[j == i]) for i in range(SHARED, order + 1))])
                for i in range(a, b, 16):
                    part = rb.slice(i, min(16, b - i))
                    costs = [_squeeze(trie.costs_of(_expand(x, np.int64).cumsum()).astype(np.float32), False) for x in part.column(6)]
                    yield pa.record_batch([part.column(2), part.column(0), pa.array(costs, pa.binary())], ["grp", "bucket", "counts"])

    return run


# ---- both scores of every document ----

#: Text bytes of one group of documents, and those whose words make up a bucket on the average: a task counts one bucket at a time.
GROUP, BUCKET = 4 << 20, 32 << 20
TEXTS = "grp long, data binary, off binary, ids binary, learn binary, n_learn long"


def _cut(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of about `limit` bytes that end at the end of a document or behind a space; only a longer word makes a longer one."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        if b < len(data):
            space = np.flatnonzero(SPACE[data[a:b]])
            c = max(int(off[np.searchsorted(off, b, side="right") - 1]), a + int(space[-1]) + 1 if len(space) else a)
            while c <= a:
                space = np.flatnonzero(SPACE[data[b : b + limit]])
                c, b = min(int(off[np.searchsorted(off, b)]), b + int(space[0]) + 1 if len(space) else len(data)), b + limit
                c = c if c <= b else a
            b = c
        yield a, b
        a = b


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word."""
    found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _cut(data, off):
        low, o = LOWER[data[a:b]], np.clip(off, a, b) - a
        starts, ends, first = spans(low, o, ~SPACE[low])
        found.append(span_hashes(prefix_sums(low), starts, ends))
        docs.append(np.repeat(np.arange(len(off) - 1), np.diff(first)))
    return np.concatenate(found), np.concatenate(docs)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes; by a plain sort, which is several times faster on these than np.unique's hashing."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def _distinct_grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    held, size = [np.zeros(0, np.int64)], 0
    for code, _, _ in _windows(data, off, order):
        held.append(_distinct(code))
        size += len(held[-1])
        if size > 4 * WINDOW:
            held = [_distinct(np.concatenate(held))]
            size = 0
    return _distinct(np.concatenate(held))


class Places:
    """Where a code stands in an array of distinct sorted codes that holds it: by one slot of its hash, else by bisection."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.shift = codes, np.uint64(64 - max(10, (4 * len(codes)).bit_length()))
        self.slots = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slots[self._slot(codes)] = np.arange(len(codes))

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(code)]
        rest = np.flatnonzero(self.codes[at] != code)
        at[rest] = np.searchsorted(self.codes, code[rest])
        return at


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and each bucket's part of it."""
    order = np.argsort(bucket, kind="stable")
    values, start = np.unique(bucket[order], return_index=True)
    return order, list(zip(values.tolist(), start.tolist(), [*start[1:].tolist(), len(order)]))


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text, learn) in groups of about GROUP bytes, one row each."""
    group = TaskContext.get().partitionId() << 32
    for rb in batches:
        ids, learns = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for i, j, data, off in chunks(rb.column(1), GROUP):
            group += 1
            learn = learns[i:j].astype(bool)
            columns = [_squeeze(data), _squeeze(off), ids[i:j].astype(np.int64).tobytes(), learn.tobytes()]
            yield pa.record_batch([pa.array([group]), *(pa.array([x], pa.binary()) for x in columns), pa.array([int(learn.sum())])], [c.split()[0] for c in TEXTS.split(", ")])


def _ask_words(buckets: int):
    """Each group's distinct words with their number in its training documents, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for group, data, off, learn in zip(*(rb.column(i) for i in range(4))):
                words, doc = _words(_expand(data, np.uint8), _expand(off, np.int64))
                words, at = np.unique(words, return_inverse=True)
                seen = np.bincount(at, weights=np.frombuffer(learn.as_buffer(), dtype=bool)[doc], minlength=len(words)).astype(np.uint32)
                by, parts = _by_bucket(_word_bucket(words, buckets))
                columns = [[x for x, _, _ in parts], [words[by[a:b]].tobytes() for _, a, b in parts], [seen[by[a:b]].tobytes() for _, a, b in parts]]
                yield pa.record_batch([pa.array([group.as_py()] * len(parts), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary())))], ["grp", "bucket", "words", "seen"])

    return run


def _ask_grams(owners, order: int):
    """Each group's distinct n-grams, as differences, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for group, data, off in zip(*(rb.column(i) for i in range(3))):
                grams = _distinct_grams(_expand(data, np.uint8), _expand(off, np.int64), order)
                by, parts = _by_bucket(owners.value.of(grams))
                keys = [_squeeze(np.diff(grams[by[a:b]], prepend=0)) for _, a, b in parts]
                yield pa.record_batch([pa.array([group.as_py()] * len(parts), pa.int64()), pa.array([x for x, _, _ in parts], pa.int32()), pa.array(keys, pa.binary())], ["grp", "bucket", "keys"])

    return run


def _word_counts(rows: pa.Table) -> pa.RecordBatch:
    """Answers each group's distinct words of one bucket with their counts over all training documents."""
    words = [np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in rows.column("words")]
    seen = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in rows.column("seen")]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(seen), minlength=len(distinct)).astype(np.int64)
    back = np.split(count[at], np.cumsum([len(w) for w in words])[:-1])
    first = np.arange(len(words)) == 0
    counts = pa.array([_squeeze(c) for c in back], pa.binary())
    return pa.record_batch([rows.column("grp").combine_chunks(), rows.column("bucket").combine_chunks(), counts, pa.array(first * int(count.sum())), pa.array(first * int((count > 0).sum()))], ["grp", "bucket", "counts", "tokens", "distinct"])


def _finish(total: int, distinct: int, ends: int, owners, order: int, buckets: int):
    """Both scores of one group from its texts and the counts and costs that came back."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), range(group.num_rows)))
        data, off, ids = (group.column(c)[rows[0][2]] for c in ("data", "off", "ids"))
        data, off, ids = _expand(data, np.uint8), _expand(off, np.int64), np.frombuffer(ids.as_buffer(), dtype=np.int64)
        n = len(ids)

        def answers(of: int, bucket: np.ndarray, kind: type, planes: bool) -> np.ndarray:
            """What the buckets of a kind sent back, in the order of the questions before _by_bucket."""
            out = np.zeros(len(bucket))
            out[np.argsort(bucket, kind="stable")] = np.concatenate([np.zeros(0), *(_expand(group.column("counts")[i], kind, planes) for k, _, i in rows if k == of)])
            return out

        word, doc = _words(data, off)
        word, at = np.unique(word, return_inverse=True)
        c = answers(1, _word_bucket(word, buckets), np.int64, True)[at]
        tokens = np.bincount(doc, minlength=n) + 1
        known = np.bincount(doc, weights=c > 0, minlength=n) + (ends > 0)
        base = np.bincount(doc, weights=np.log10(c + 0.1), minlength=n) + np.log10(ends + 0.1)
        base -= tokens * np.log10(total + 0.1 * (distinct + 1))
        grams, score = _distinct_grams(data, off, order), np.zeros(n)
        costs, places = answers(2, owners.value.of(grams), np.float32, False), Places(grams)
        for code, first, starts in _windows(data, off, order):
            score[first : first + len(starts)] += np.add.reduceat(costs[places.of(code)], starts)
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array(ids), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)], names)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, most_cells: int = MOST_CELLS, folds: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, from all whole texts.

    Both models learn from rows whose crc32 of the id as text leaves a remainder by `folds`; the others are held out.
    score: log10 probability of the A-Z-lowered UTF-8 text and its end under the byte model. base_score: the same for
    its words and end under add-0.1 unigrams. A null or empty text is just its end. Ids are longs; a null id is
    neither learned from nor held out (held_out is null). Repeated rows are learned from and
    returned each time. Other columns aren't read. No rows give no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ppm")
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(fold != 0, F.lit(False)).alias("learn"))
    model = train(rows.where("learn").select("text"), stage, order, most_cells)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size) // BUCKET + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners, short = spark.sparkContext.broadcast(model.owners), spark.sparkContext.broadcast(model.short)
    # the id travels as bytes; a null one as the least long, which is turned back at the end
    least = -(2**63)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(least)))
    texts = stage.save(rows.mapInArrow(_grouped, TEXTS), "texts")
    asked = texts.select("grp", "data", "off", "learn").mapInArrow(_ask_words(buckets), "grp long, bucket int, words binary, seen binary")
    asked = asked.select("bucket", "grp", "words", "seen").repartition(max(parts, min(buckets, MOST_PARTS)), "bucket").sortWithinPartitions("bucket")
    counts = stage.save(asked.mapInArrow(units(1, _word_counts), "grp long, bucket int, counts binary, tokens long, distinct long"), "counts")
    salts = int(size) // (model.owners.buckets * SPAN) + 1
    cells = model.nodes.select("j", "gram", "n").mapInArrow(_deal(owners, salts), UNIT)
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("j", "int"), ("gram", "long"), ("n", "long"))]
    asked = texts.select("grp", "data", "off").mapInArrow(_ask_grams(owners, order), "grp long, bucket int, keys binary")
    asked = asked.select("bucket", F.pmod(F.xxhash64("grp"), F.lit(salts)).cast("int").alias("salt"), "grp", *nulls, "keys")
    asked = cells.unionByName(asked).repartition(max(parts, min(model.owners.buckets * salts, MOST_PARTS)), "bucket", "salt").sortWithinPartitions("bucket", "salt", "grp")
    costs = stage.save(asked.mapInArrow(_answer(short, order), "grp long, bucket int, counts binary"), "costs")
    stage.drop("nodes")

    words = counts.agg(F.sum("tokens"), F.sum("distinct")).first()
    ends = texts.agg(F.sum("n_learn")).first()[0] or 0
    total, distinct = (words[0] or 0) + ends, (words[1] or 0) + (ends > 0)
    texts = texts.select("grp", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "data", "off", "ids")
    for kind, answers in ((1, counts), (2, costs)):
        texts = texts.unionByName(answers.select("grp", F.lit(kind).alias("kind"), "bucket", "counts"), allowMissingColumns=True)
    finish = _finish(total, distinct, ends, owners, order, buckets)
    out = texts.groupBy("grp").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), (F.crc32(F.col("doc_id").cast("string")) % folds == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
