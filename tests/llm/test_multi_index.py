"""Multi-index hashing against plain searches over codes and over vectors."""

import numpy as np
import pytest

from lodestone.llm import multi_index
from lodestone.llm.multi_index import BITS, WIDTH, fit, nearest_neighbours, thresholds
from lodestone.llm.queries import op12_multi_index_search

SCHEMA = "vec_id long, embedding array<{}>, label int, class long, lanes string, score double"


def frame(spark, rows, one="double"):
    """Rows with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, 1, 2, "l", 0.5) for i, v in rows], SCHEMA.format(one))


def plain(rows, k=20, every=20):
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    width = max((len(v) for _, v in fine), default=0)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in fine])
    out = {}
    for a, (i, _) in enumerate(fine):
        if i % every == 0:
            score = x @ x[a]
            found = sorted(((-score[b], j) for b, (j, _) in enumerate(fine) if j != i))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [r[:2] for r in got[q]] == [r[:2] for r in rows]
        assert np.allclose([r[2] for r in got[q]], [r[2] for r in rows], rtol=1e-12, atol=1e-12)


def some_rows(seed=1, n=300, d=12):
    """Whole numbers, so that scores are exact and ties many; copies, unusable vectors, ids that repeat."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, d)]) for i in range(n)]
    rows += [(i, rows[20][1]) for i in range(n, n + 90)] + [(5, rows[5][1])] * 2
    odd = [None, [], [0.0] * d, [1.0, None], [float("nan")] * d, [float("inf"), 1.0], [2.0, -1.0], [-0.0, 3.0, *[0.0] * (d - 2)]]
    return rows + [(1000 + 20 * j, v) for j, v in enumerate(odd)] + [(None, [1.0] * d)]


@pytest.mark.parametrize("unit", [1 << 20, 12 * 24])
def test_whole_radius_is_exact(spark, monkeypatch, unit):
    """With one place for each substring, and with split places and several ones."""
    monkeypatch.setattr(multi_index, "UNIT", unit)
    rows = some_rows()
    same(answers(nearest_neighbours(frame(spark, rows), "vec_id % 20 = 0", radius=BITS)), plain(rows))


def test_own_radius_widens_until_all_are_found(spark, monkeypatch):
    """Radii from a sample that promises too near neighbours: queries ask again, and none gets fewer than k."""
    monkeypatch.setattr(multi_index.Codes, "limits", lambda self, z: (np.ones(len(z), dtype=np.int64), np.full(len(z), -np.inf)))
    rows = some_rows(2, 120)
    got, want = answers(nearest_neighbours(frame(spark, rows), "vec_id % 20 = 0")), plain(rows)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    for q, found in got.items():
        score = dict((j, s) for _, j, s in plain(rows, k=1000)[q])
        assert all(abs(score[j] - s) < 1e-9 for _, j, s in found)


def test_pigeonhole():
    """Every code within the radius differs in some substring by its limit or less, for all radii."""
    rng = np.random.default_rng(3)
    m = BITS // WIDTH
    for radius in range(0, 60):
        limit = thresholds(np.array([radius]), m)[0]
        for _ in range(200):
            spread = rng.multinomial(radius, rng.dirichlet(np.full(m, 0.5)))
            assert (np.minimum(spread, WIDTH) <= limit).any()
        assert limit.sum() + m == radius + 1  # no looser than needed


def test_fixed_radius_meets_every_code(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 10)) + rng.normal(size=(4, 10))[rng.integers(0, 4, 400)] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(nearest_neighbours(frame(spark, rows), "vec_id % 20 = 0", k=400, radius=30))
    # the same sample in the same order teaches the same codes
    held = spark.createDataFrame(rows, "i long, v array<double>").selectExpr("i", "v", "xxhash64(v) as h").orderBy("h").collect()
    sample = np.array([r.v for r in held])
    scale = max(np.sqrt((sample**2).sum(axis=1)))
    codes = fit(sample, scale, 400, 400)
    stored, asked = codes.lanes(codes.stored(x)), codes.lanes(codes.asked(x))
    for q in range(0, 400, 20):
        off = np.bitwise_count(stored ^ asked[q]).sum(axis=1)
        assert {j for _, j, _ in got.get(q, [])} == set(np.flatnonzero(off <= 30).tolist()) - {q}


def test_float_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [2.0, 2.0])]
    same(answers(nearest_neighbours(frame(spark, rows, "float"), "vec_id % 20 = 0")), plain(rows))
    same(answers(nearest_neighbours(frame(spark, rows[:1]), "vec_id % 20 = 0")), {})
    assert nearest_neighbours(frame(spark, []), "vec_id % 20 = 0").collect() == []
    with pytest.raises(ValueError):
        nearest_neighbours(frame(spark, rows), "true", bits=100)


def test_query_finds_the_nearest(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = answers(op12_multi_index_search(spark, sf_dir)), plain(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({r[1] for r in got[q]} & {r[1] for r in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
