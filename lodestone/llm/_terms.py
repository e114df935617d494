"""Terms, shapes and labelled samples for the text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import LOWER, SPACE, U64, mix, prefix_sums, span_hashes, spans

UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
#: ASCII letters and digits, and every byte of a non-ASCII character.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    low = LOWER[data]
    if len(low) > 1:
        accent = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[accent] += 0x20
    return low


def words_and_prefixes(data: np.ndarray, off: np.ndarray, lengths: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lowered) and of their first 3, 4 and 5 characters where they are longer; document of each."""
    low = lowered(data)
    starts, ends, first = spans(low, off, LETTER[low])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    sums = prefix_sums(low)
    out, docs = [span_hashes(sums, starts, ends)], [doc]
    char = np.flatnonzero((low & 0xC0) != 0x80)
    rank = np.searchsorted(char, starts)
    for n in lengths:
        stop = np.append(char, np.full(n, len(low)))[rank + n]
        longer = np.flatnonzero(stop < ends)
        out.append(mix(span_hashes(sums, starts[longer], stop[longer]) + U64(n)))
        docs.append(doc[longer])
    return np.concatenate(out), np.concatenate(docs)


def distinct_pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) in order of document."""
    by = np.lexsort((term, doc))
    doc, term = doc[by], term[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def shapes_and_ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, their documents, shape n-gram hashes, their documents).

    Tokens are runs of letters and digits, and runs of other visible characters. N-grams: tokens
    and pairs of neighbours. A token's shape: its characters where it is a run of
    others, else whether it repeats the token before, is in capitals, begins with one, has digits or none of these;
    shape n-grams: runs of one to three shapes.
    """
    visible = ~SPACE[data]
    letter = LETTER[data]
    a = spans(data, off, visible & letter)
    b = spans(data, off, visible & ~letter)
    starts, ends = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    by = np.argsort(starts, kind="stable")
    starts, ends, word = starts[by], ends[by], (np.arange(len(by)) < len(a[0]))[by]
    doc = np.searchsorted(off, starts, side="right") - 1
    token = span_hashes(prefix_sums(lowered(data)), starts, ends)
    upper, digit = np.concatenate([[0], np.cumsum(UPPER[data])]), np.concatenate([[0], np.cumsum(DIGIT[data])])
    size, caps = ends - starts, upper[ends] - upper[starts]
    same = np.zeros(len(token), dtype=bool)
    same[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    kind = np.where(same, 5, np.where(digit[ends] > digit[starts], 4, np.where((caps == size) & (size > 1), 3, np.where(caps > 0, 2, 1))))
    shape = np.where(word | same, mix(kind.astype(U64) + U64(1 << 40)), token)

    def runs(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        out, docs = [mix(x + U64(1))], [doc]
        total = x.copy()
        for n in range(2, most + 1):
            if len(x) < n:
                break
            total = mix(total[: len(x) - n + 1] * U64(31) + x[n - 1 :])
            inside = np.flatnonzero(doc[n - 1 :] == doc[: len(x) - n + 1])
            out.append(mix(total[inside] + U64(n)))
            docs.append(doc[inside])
        return np.concatenate(out), np.concatenate(docs)

    return *runs(token, 2), *runs(shape, 3)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """(key, text, y): at most `bound` labelled rows outside the held-out fold, by the order of a hash of their ids.

    The ids are broadcast: `bound` of them, 24 bytes each, so that no text is shuffled.
    """
    ids = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % folds != 0))
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y")).withColumn("key", F.xxhash64("_id"))
    ids = ids.orderBy("key", "_id").limit(bound)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").select("key", "text", "y")


def held_out(id_col: str, folds: int = 5):
    return (F.crc32(F.col(id_col).cast("string")) % folds == 0).alias("held_out")
