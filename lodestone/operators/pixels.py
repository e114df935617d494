"""Image similarity on pixels: multi-scale structural similarity and Haar wavelet similarity.

A picture is what Spark's image source gives: height, width, nChannels and rows of bytes (grey, BGR or BGRA). Pairs of
pictures stay in Spark; a worker decodes the bytes of a pair, brings both to one size and compares them with numpy.
Published measures: Wang, Simoncelli and Bovik, "Multi-scale Structural Similarity" (2003); Reisenhofer et al.,
"A Haar Wavelet-Based Perceptual Similarity Index" (2018).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.session import ship

#: Side that pictures are brought to; weights of the scales, window and constants of the structural measure.
SIDE = 224
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
WINDOW, SIGMA, K1, K2 = 11, 1.5, 0.01, 0.03
#: Pairs of a batch whose bytes a worker takes apart at a time.
PAIRS = 64
#: Constants of the wavelet measure, and the YIQ matrix.
C, ALPHA = 30.0, 4.2
YIQ = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Pixels (height, width, 3) in 0..1; None for what is no picture."""
    if data is None or channels not in (1, 3, 4) or min(height or 0, width or 0) < 1 or len(data) != height * width * channels:
        return None
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64) / 255
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def resized(x: np.ndarray, side: int) -> np.ndarray:
    """Bilinear to side x side, pixel centres aligned."""
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, high, axis) * part
    return x


def _blurred(x: np.ndarray) -> np.ndarray:
    """Gaussian window over the first two axes, where it fits whole."""
    g = np.exp(-((np.arange(WINDOW) - WINDOW // 2) ** 2) / (2 * SIGMA**2))
    g /= g.sum()
    for axis in (0, 1):
        n = x.shape[axis] - WINDOW + 1
        x = sum(w * np.take(x, range(i, i + n), axis) for i, w in enumerate(g))
    return x


def structural(a: np.ndarray, b: np.ndarray) -> float:
    """Multi-scale structural similarity of two pictures of one size; as many scales as the window fits in."""
    scales = sum(min(a.shape[:2]) // 2**s >= WINDOW for s in range(len(SCALES)))
    if not scales:
        raise ValueError(f"pictures must have {WINDOW} pixels a side at least")
    weights = np.array(SCALES[:scales]) / sum(SCALES[:scales])
    out = np.ones(3)
    for s, weight in enumerate(weights):
        ma, mb = _blurred(a), _blurred(b)
        va, vb, both = _blurred(a * a) - ma * ma, _blurred(b * b) - mb * mb, _blurred(a * b) - ma * mb
        contrast = (2 * both + K2**2) / (va + vb + K2**2)
        if s == scales - 1:
            contrast = contrast * (2 * ma * mb + K1**2) / (ma * ma + mb * mb + K1**2)
        out *= np.maximum(contrast.mean(axis=(0, 1)), 0) ** weight
        if s < scales - 1:
            h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
            a, b = (x[:h, :w].reshape(h // 2, 2, w // 2, 2, 3).mean(axis=(1, 3)) for x in (a, b))
    return float(out.mean())


def _sums(x: np.ndarray, height: int, width: int, up: int, left: int) -> np.ndarray:
    """Sum of the rectangle at each pixel that begins `up` rows above and `left` columns before it; zeros outside."""
    rows, cols = x.shape
    total = np.pad(np.pad(x, ((up, height), (left, width))).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    at = lambda r, c: total[r : r + rows, c : c + cols]
    return at(height, width) - at(0, width) - at(height, 0) + at(0, 0)


def _haar(x: np.ndarray, k: int) -> np.ndarray:
    """Lower less upper half of the 2**k x 2**k square around each pixel, over 2**k."""
    n, h = 2**k, 2 ** (k - 1)
    return (_sums(x, h, n, 0, h) - _sums(x, h, n, h, h)) / n


def wavelet(a: np.ndarray, b: np.ndarray) -> float:
    """Haar wavelet similarity of two pictures of one size, of brightness and both colours."""

    def parts(x: np.ndarray) -> np.ndarray:
        h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
        return (x[:h, :w].reshape(h // 2, 2, w // 2, 2, 3).mean(axis=(1, 3)) * 255) @ YIQ.T

    def like(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (2 * p * q + C) / (p * p + q * q + C)

    x, y = parts(a), parts(b)
    similar, weights = [], []
    for turn in (lambda m: m, np.transpose):
        one, two = ([np.abs(turn(_haar(turn(m[:, :, 0]), k))) for k in (1, 2, 3)] for m in (x, y))
        similar.append((like(one[0], two[0]) + like(one[1], two[1])) / 2)
        weights.append(np.maximum(one[2], two[2]))
    mean = lambda m: np.abs(_sums(m, 2, 2, 1, 1) / 4)
    similar.append((like(mean(x[:, :, 1]), mean(y[:, :, 1])) + like(mean(x[:, :, 2]), mean(y[:, :, 2]))) / 2)
    weights.append((weights[0] + weights[1]) / 2)
    s, w = np.stack(similar), np.stack(weights)
    if not w.sum():
        return 1.0 if np.array_equal(a, b) else float(s.mean())
    m = (w / (1 + np.exp(-ALPHA * s))).sum() / w.sum()
    return float((np.log(m / (1 - m)) / ALPHA) ** 2)


def pixel_similarity(pairs: DataFrame, a: str = "picture", b: str = "other", side: int = SIDE) -> DataFrame:
    """pairs with structure and wavelet (doubles), of two picture columns (struct of height, width, nChannels, data); null where either is no picture.

    Both pictures are brought to side x side. Columns of those names are replaced.
    """
    ship(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in ("structure", "wavelet")]
    fields = ("height", "width", "nChannels", "data")
    flat = pairs.select(*kept, *[F.col(f"{c}.{f}").alias(f"_{c}_{f}") for c in (a, b) for f in fields]).drop(a, b)
    others = [c for c in kept if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS)):
            get = [[rb.column(rb.schema.get_field_index(f"_{c}_{f}")).to_pylist() for f in fields] for c in (a, b)]
            found: list[list[float | None]] = [[], []]
            for i in range(rb.num_rows):
                x, y = (rgb(*(column[i] for column in one)) for one in get)
                if x is None or y is None:
                    found[0].append(None)
                    found[1].append(None)
                    continue
                x, y = resized(x, side), resized(y, side)
                found[0].append(structural(x, y))
                found[1].append(wavelet(x, y))
            yield pa.record_batch([*(rb.column(rb.schema.get_field_index(c)) for c in others), *(pa.array(f, pa.float64()) for f in found)], [*others, "structure", "wavelet"])

    schema = flat.select(*others).schema.add("structure", "double").add("wavelet", "double")
    return flat.mapInArrow(run, schema)
