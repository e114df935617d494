"""Vectorised work on the raw UTF-8 bytes of Arrow text columns.

Texts stay in Arrow's buffers; numpy computes words, their 64-bit hashes and shingles
for a few megabytes of documents at a time, so memory is bounded by one Arrow batch
and no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 512 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A Mersenne prime and a base below it for the second hash, with the base's inverse.
PRIME, BASE_P = (1 << 31) - 1, 1_540_483_477
INVERSE_P = pow(BASE_P, -1, PRIME)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
VALUES_P = mix(np.arange(257, 513, dtype=U64) * U64(BASE)) % U64(PRIME)


def powers(n: int) -> dict[str, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 ("n", "inv"), BASE_P**i and BASE_P**-i modulo PRIME ("n_p", "inv_p"), for i < n."""
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for key, base in (("n", BASE), ("inv", INVERSE)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
        for key, base in (("n_p", BASE_P), ("inv_p", INVERSE_P)):
            a = np.ones(size, dtype=U64)
            done = 1
            while done < size:
                more = min(done, size - done)
                a[done : done + more] = a[:more] * U64(pow(base, done, PRIME)) % U64(PRIME)
                done += more
            _powers[key] = a
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null text has length zero."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may cover bytes; give it none
        column = column.fill_null("")
        return text_buffers(column)
    return raw, off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of documents of about `limit` bytes."""
    raw, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """Sums of VALUES[byte] * BASE**i modulo 2**64, one longer than data: enough to tell short spans apart.

    For long ones it is not: for any odd base there are texts of 1,024 letters (Thue-Morse words) that collide.
    """
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(VALUES[data] * powers(len(data) + 1)["n"][: len(data)], out=sums[1:])
    return sums


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rolling_sums and the same modulo PRIME, of other values: any span's hash is two subtractions away."""
    second = VALUES_P[data] * powers(len(data) + 1)["n_p"][: len(data)]
    second = (second & U64(PRIME)) + (second >> U64(31))  # under 2**32, so that 2**31 of them fit
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(second, out=sums[1:])
    return rolling_sums(data), sums


def span_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand.

    They mix a polynomial modulo 2**64, one over the field of PRIME elements and the length: spans of n bytes that a
    weakness of the first makes equal still differ but for a share of about n / 2**31.
    """
    p, (first, second) = powers(len(sums[0])), sums
    other = (second[end] - second[start]) % U64(PRIME) * p["inv_p"][start] % U64(PRIME)
    return mix((first[end] - first[start]) * p["inv"][start] + mix((other << U64(32)) ^ (end - start).astype(U64)))


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs where `inside` holds, broken at document borders: starts, ends, first run of each document (n + 1)."""
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off[off <= n]] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = True
        np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
    starts = np.flatnonzero(inside & before)
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = True
        np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lowered bytes: hashes, starts, ends, first word of each document (n + 1)."""
    low = LOWER[data]
    starts, ends, first = spans(low, off, ~SPACE[low])
    return span_hashes(prefix_sums(low), starts, ends), starts, ends, first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (document borders are the caller's concern)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    factor = 1
    for i in range(k):
        factor = factor * BASE % (1 << 64)
        total += hashes[i : i + n] * U64(factor)
    return mix(total)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; under k words the whole sequence counts as one."""
    hashes, _, _, first = words(data, off)
    whole = shingles(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix(shingles(hashes[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
