"""Every engine query runs, and equals its SQL in DuckDB where it has one."""

import math

import duckdb
import pytest

from lodestone.plans.queries import QUERIES, SQL, TABLES


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert rows == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_no_llm_import_outside():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "lodestone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestone\.llm|from \.+llm", p.read_text()), p


def test_recall_needs_no_score_of_all(spark, sf_dir, monkeypatch):
    """The cut-offs are told from each query's nearest; scores of all rows never leave the scan."""
    from lodestone.operators import dense

    asked, scores = [], dense.vector_scores
    monkeypatch.setattr(dense, "vector_scores", lambda corpus, queries, k=None, *rest: asked.append(k) or scores(corpus, queries, k, *rest))
    assert 0 <= QUERIES["recall_at_k"](spark, sf_dir).first().recall_10 <= 1
    assert asked == [11]


def test_all_scores_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    """One file of one row group, yet no task makes more scores than about its share, and none is lost or made twice."""
    from pyspark.sql import functions as F

    from lodestone.operators import dense

    monkeypatch.setattr(dense, "BLOCK", 7)
    before = {tuple(r) for r in QUERIES["similarity_matrix"](spark, sf_dir).collect()}
    monkeypatch.setattr(dense, "TASK_SCORES", 1000, raising=False)
    monkeypatch.setattr(dense, "AT_A_TIME", 20, raising=False)
    rows = QUERIES["similarity_matrix"](spark, sf_dir).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len(before) and {tuple(r)[:3] for r in rows} == before
    made = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(made) >= len(rows) / 1000 and max(made) <= 2000


def test_all_scores_come_by_id():
    """A row's scores stand together, in pieces of bounded size: each id once for a block of queries."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import dense

    x = np.random.default_rng(1).normal(size=(3000, 4))
    asked = SimpleNamespace(value=(np.arange(50), dense._unit(pa.array(list(x[:50])))))
    batch = pa.record_batch([pa.array(np.arange(3000)), pa.array(list(x))], ["id", "vector"])
    got = list(dense._scores(asked, None)(iter([batch])))
    assert all(b.num_rows <= 1 << 16 for b in got)
    t = pa.Table.from_batches(got)
    assert (t["id"].to_numpy() == np.repeat(np.arange(3000), 50)).all() and (t["query_id"].to_numpy() == np.tile(np.arange(50), 3000)).all()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(t["score"].to_numpy(), (unit @ unit[:50].T).ravel())


def test_many_scores_come_by_value(monkeypatch):
    """Each pair once, with its own score, in slices of bounded size that are in order; also where vectors are alike, zero or not finite."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import dense

    for name, value in {"BY_VALUE": 1000, "IN_ORDER": 4096, "BLOCK": 7, "AT_A_TIME": 500}.items():
        monkeypatch.setattr(dense, name, value, raising=False)
    x = np.random.default_rng(1).normal(size=(900, 4))
    x[200:500], x[500:503], x[503] = x[200], 0, (np.inf, 1, 1, 1)
    with np.errstate(all="ignore"):
        unit = dense._unit(pa.array(list(x)))
        asked = SimpleNamespace(value=(np.arange(0, 1800, 20), unit[:90]))
        got = pa.Table.from_batches(dense._scores(asked, None)(iter([pa.record_batch([pa.array(np.arange(900) * 3), pa.array(list(x))], ["id", "vector"])])))
        want = unit[:90] @ unit.T
    q, v, score = (got[c].to_numpy() for c in got.column_names)
    assert len(got) == 90 * 900 == len(set(zip(q, v)))
    assert np.allclose(score, want[q // 20, v // 3], equal_nan=True)
    assert (np.diff(score) < 0).sum() < 2 * len(got) / 4096 + 30


def test_a_file_of_many_scores_is_small(spark, tmp_path):
    """A value stands once for many pairs, so a file takes less than the eight bytes of a score for each."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import dense

    x = np.random.default_rng(1).normal(size=(4000, 16))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(4000), "embedding": pa.array(list(x))})).coalesce(1)
    asked = rows.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    dense.vector_scores(rows, asked).selectExpr("query_id", "id", "round(score, 6) AS similarity").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * 4_000_000


def test_scores_are_rounded_as_spark_does(spark):
    """Halves, their neighbours and signs of zero too."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestone.operators import dense

    half = (np.arange(-3000, 3000) * 337 + 0.5) / 1e6
    x = np.concatenate([half, np.nextafter(half, 9), np.nextafter(half, -9), np.random.default_rng(1).uniform(-1, 1, 20000), [0.0, -0.0, -1e-9, 1.0, -1.0, np.nan]])
    want = np.array([r[0] for r in spark.createDataFrame(pa.table({"x": x})).select(F.round("x", 6)).collect()])
    got = dense.rounded(x, 6)
    assert got.tobytes() == want.tobytes()
