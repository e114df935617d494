"""Pixel kernels against plain versions with loops, pictures from files, and failures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pixels
from lodestone.sources import readers


def plain_structural(a, b, scales):
    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    g = np.outer(g, g) / np.outer(g, g).sum()
    weights = np.array([0.0448, 0.2856, 0.3001, 0.2363, 0.1333][:scales])
    weights /= weights.sum()
    total = 0.0
    for c in range(3):
        x, y, value = a[:, :, c], b[:, :, c], 1.0
        for s in range(scales):
            full, part = [], []
            for i in range(x.shape[0] - 10):
                for j in range(x.shape[1] - 10):
                    p, q = x[i : i + 11, j : j + 11], y[i : i + 11, j : j + 11]
                    mp, mq = (g * p).sum(), (g * q).sum()
                    vp, vq, pq = (g * p * p).sum() - mp**2, (g * q * q).sum() - mq**2, (g * p * q).sum() - mp * mq
                    part.append((2 * pq + 0.0009) / (vp + vq + 0.0009))
                    full.append(part[-1] * (2 * mp * mq + 0.0001) / (mp**2 + mq**2 + 0.0001))
            value *= max(np.mean(full if s == scales - 1 else part), 0) ** weights[s]
            half = lambda m: np.array([[m[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for j in range(m.shape[1] // 2)] for i in range(m.shape[0] // 2)])
            x, y = half(x), half(y)
        total += value / 3
    return total


def plain_wavelet(a, b):
    def prepared(x):
        half = np.array([[x[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean(axis=(0, 1)) for j in range(x.shape[1] // 2)] for i in range(x.shape[0] // 2)]) * 255
        return np.einsum("ijc,kc->ijk", half, np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]]))

    def at(m, i, j):
        return m[i, j] if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] else 0.0

    def coefficient(m, i, j, k, upright):
        h, total = 2 ** (k - 1), 0.0
        for p in range(-h, h):
            for q in range(-h, h):
                total += (1 if (p if upright else q) >= 0 else -1) * at(m, i + p, j + q)
        return abs(total / 2**k)

    x, y = prepared(a), prepared(b)
    like = lambda p, q: (2 * p * q + 30) / (p * p + q * q + 30)
    logistic, up, down = lambda v: 1 / (1 + np.exp(-4.2 * v)), 0.0, 0.0
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            ws = []
            for upright in (True, False):
                one, two = ([coefficient(m[:, :, 0], i, j, k, upright) for k in (1, 2, 3)] for m in (x, y))
                ws.append(max(one[2], two[2]))
                up += ws[-1] * logistic((like(one[0], two[0]) + like(one[1], two[1])) / 2)
                down += ws[-1]
            colours = []
            for c in (1, 2):
                one, two = (abs(sum(at(m[:, :, c], i + p, j + q) for p in (-1, 0) for q in (-1, 0)) / 4) for m in (x, y))
                colours.append(like(one, two))
            up += sum(ws) / 2 * logistic(sum(colours) / 2)
            down += sum(ws) / 2
    m = up / down
    return (np.log(m / (1 - m)) / 4.2) ** 2


def test_kernels_equal_plain_versions():
    rng = np.random.default_rng(1)
    a = pixels.resized(rng.random((9, 7, 3)), 24)
    for b in (np.clip(a + 0.1 * rng.normal(size=a.shape), 0, 1), rng.random(a.shape), 1 - a):
        assert pixels.structural(a, b) == pytest.approx(plain_structural(a, b, 2), abs=1e-9)
        assert pixels.wavelet(a, b) == pytest.approx(plain_wavelet(a, b), abs=1e-9)
        assert pixels.structural(a, b) == pytest.approx(pixels.structural(b, a)) and 0 <= pixels.wavelet(a, b) < 1
    assert pixels.structural(a, a) == pytest.approx(1) and pixels.wavelet(a, a) == pytest.approx(1)
    flat = np.full((24, 24, 3), 0.5)
    assert pixels.wavelet(flat, flat) == pytest.approx(1) and pixels.structural(flat, flat) == pytest.approx(1)
    with pytest.raises(ValueError):
        pixels.structural(a[:5], a[:5])


def png(x):
    """A grey PNG file."""
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_of_files(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 256, (12, 15), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(png(255 - x))
    (tmp_path / "no.png").write_bytes(b"no picture")
    rows = readers.pictures(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    first = rows.where("name = 'a.png'").select(F.col("picture").alias("other"))
    got = {r.name: (r.structure, r.wavelet) for r in pixels.pixel_similarity(rows.crossJoin(first), side=32).collect()}
    assert got["a.png"] == (pytest.approx(1), pytest.approx(1)) and got["no.png"] == (None, None)
    a, b = (pixels.resized(pixels.rgb(12, 15, 1, v.tobytes()), 32) for v in (x, 255 - x))
    assert got["b.png"] == (pytest.approx(pixels.structural(a, b)), pytest.approx(pixels.wavelet(a, b)))
    assert pixels.rgb(2, 2, 3, b"\1\2\3" * 4)[0, 0].tolist() == [3 / 255, 2 / 255, 1 / 255]
    assert pixels.rgb(2, 2, 3, b"x") is None and pixels.rgb(-1, -1, -1, b"") is None and pixels.rgb(1, 1, 1, None) is None


def test_pairs_of_a_batch_go_in_pieces(spark):
    """A worker takes apart PAIRS of a batch at a time; every pair keeps its row."""
    rng = np.random.default_rng(3)
    picture = lambda: (32, 32, 3, bytes(rng.integers(0, 256, 3072, dtype=np.uint8)))
    n = 2 * pixels.PAIRS + 5
    some = [picture() for _ in range(5)]
    kind = "struct<height: int, width: int, nChannels: int, data: binary>"
    df = spark.createDataFrame([(i, some[i % 5], some[i % 3]) for i in range(n)], f"id long, picture {kind}, other {kind}").coalesce(1)
    got = {r.id: (r.structure, r.wavelet) for r in pixels.pixel_similarity(df, side=32).collect()}
    assert sorted(got) == list(range(n)) and all(got[i] == got[i % 15] for i in range(n))
    assert got[0][0] == pytest.approx(1) and got[3][0] < 0.9
