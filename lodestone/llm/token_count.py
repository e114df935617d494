"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Two facts about a byte-level BPE with the usual word-splitting pattern carry this module. A stable
boundary is a place where an ASCII space with a non-space on either side begins: the splitting
pattern takes a space only at the start of a piece, so a piece always begins there, and
nothing before it changes how the rest is encoded. So

* the text between two stable boundaries has one token count wherever it stands, and each worker
  encodes every distinct stretch once per batch (equal by its bytes, not just by a hash);
* a huge document is encoded in overlapping chunks with offsets, and two neighbouring chunks are
  spliced at a stable boundary inside the overlap at which both have a token border. Where
  there is none, the overlap is doubled, up to the whole rest of the document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._bytes import SPACE, chunks, prefix_sums, span_hashes
from lodestone.llm._spark import ship

#: Documents beyond HUGE bytes are cut into chunks of CHUNK characters that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP = 16_384, 8192, 256

#: First bytes of the non-ASCII white space characters in UTF-8.
WIDE_SPACE = np.zeros(256, dtype=bool)
WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def stable_at(text: str, i: int) -> bool:
    """Whether a token always begins at i, whatever stands before and after."""
    return 0 < i < len(text) - 1 and text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()


def _offsets(tokenizer, text: str) -> list[tuple[int, int]]:
    return tokenizer.encode(text, add_special_tokens=False).offsets


def _splice(left: list[tuple[int, int]], left_at: int, right: list[tuple[int, int]], right_at: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable boundary p in (low, high) where both encodings have a border: p, tokens of left before p, tokens of right before p."""
    p = (low + high) // 2
    for step in range(high - low):
        at = p + (step // 2 if step % 2 else -(step // 2))
        if not low < at < high or not stable_at(text, at):
            continue
        # offsets leave the leading space out, so a token that begins at the boundary may report at + 1
        i = next((k for k, (a, b) in enumerate(left) if a + left_at >= at), None)
        j = next((k for k, (a, b) in enumerate(right) if a + right_at >= at), None)
        if i is None or j is None or (i and left[i - 1][1] + left_at > at) or (j and right[j - 1][1] + right_at > at):
            continue
        return at, i, j
    return None


def count_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, encoded in overlapping chunks."""
    start, total, n = 0, 0, len(text)
    end = min(n, chunk)
    current = _offsets(tokenizer, text[:end])
    while end < n:
        width, found = overlap, None
        while not found:
            begin = max(start, end - width)
            if begin == start:  # widened over the whole chunk: take a longer one instead
                end = min(n, start + 2 * (end - start))
                current = _offsets(tokenizer, text[start:end])
                break
            stop = min(n, end + chunk)
            following = _offsets(tokenizer, text[begin:stop])
            found = _splice(current, start, following, begin, text, begin, end)
            width *= 2
        if found:
            at, i, j = found
            total += i
            # what follows starts at the boundary: nothing before it matters
            current, start, end = [(a + begin - at, b + begin - at) for a, b in following[j:]], at, stop
    return total + len(current)


def _segments(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the stretches between stable boundaries, document borders included."""
    n = len(data)
    space = SPACE[data]
    stable = np.zeros(n, dtype=bool)
    if n > 2:
        # a byte that may begin a non-ASCII white space is no neighbour to rely on
        stable[1:-1] = (data[1:-1] == 0x20) & ~space[:-2] & ~(space | WIDE_SPACE[data])[2:]
    # at the first or last byte of a document there is no neighbour on that side
    edge = off[:-1]
    stable[edge[edge < n]] = False
    last = off[1:] - 1
    stable[last[(last >= 0) & (last < n)]] = False
    full = off[:-1] < off[1:]
    stable[off[:-1][full]] = True
    return np.flatnonzero(stable)


def count_batch(tokenizer, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens of each document, every distinct stretch encoded once."""
    starts = _segments(data, off)
    if not len(starts):
        return np.zeros(len(off) - 1, dtype=np.int64)
    ends = np.append(starts[1:], len(data))
    keys = span_hashes(prefix_sums(data), starts, ends)
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    # a stretch shares the count of the first of its hash only if it has its very bytes
    model = first[inverse]
    unlike = np.flatnonzero(ends - starts != ends[model] - starts[model])
    place = np.repeat((starts[model] - starts).astype(np.int32), ends - starts)
    place += np.arange(len(data), dtype=np.int32)
    wrong = np.flatnonzero(data != data[np.minimum(place, len(data) - 1, out=place)])
    unlike = np.union1d(unlike, np.searchsorted(starts, wrong, side="right") - 1)
    inverse[unlike] = len(first) + np.arange(len(unlike))
    first = np.concatenate([first, unlike])
    raw = data.tobytes()
    parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    sizes = np.fromiter(map(len, tokenizer.encode_batch_fast(parts, add_special_tokens=False)), np.int64, len(parts))
    per = np.concatenate([[0], np.cumsum(sizes[inverse])])
    return np.diff(per[np.searchsorted(starts, off)])


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row.

    n_tokens is what the tokenizers library gives for the whole text, without added special tokens,
    truncation or padding; special strings inside a text are one token each, the library's default. The file
    must hold a byte-level BPE that splits words by its usual pattern. A null text counts as empty: no bytes, no tokens.
    Repeated rows and null ids are kept; other columns aren't read; no rows give no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for rb in batches:
            for i, j, data, off in chunks(rb.column(1), 8 << 20):
                size = np.diff(off)
                huge = np.flatnonzero(size > HUGE)
                if len(huge):  # the others are counted together
                    keep = np.repeat(size <= HUGE, size)
                    small = np.where(size > HUGE, 0, size)
                    counts = count_batch(tokenizer, data[keep], np.concatenate([[0], np.cumsum(small)]))
                    for h in huge.tolist():
                        counts[h] = count_huge(tokenizer, data[off[h] : off[h + 1]].tobytes().decode("utf-8", "replace"))
                else:
                    counts = count_batch(tokenizer, data, off)
                yield pa.record_batch([rb.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(counts > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
