"""The pipeline against a plain version on a small corpus, and every query over the small tables."""

import math
import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_pairs import roots, shingles
from test_texts import plain, plain_terms

from lodestone.llm._spark import Stage, remove_tables, table
from lodestone.llm.queries import ORACLE_SQL, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark; the documents' rows; the toxic, leaking and private ones."""
    rng = random.Random(21)
    langs = {"en": "the of and to in er on", "fr": "le la les des un et ou", "de": "der die das und ein im zu", "es": "el los las del y que una"}
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "li", "mo", "nu"]

    def text(lang, n):
        return [rng.choice(langs[lang].split()) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    items = [(k, " ".join(text("en", 30))) for k in range(3)]
    rows, toxic = [], set()
    for i in range(240):
        lang = rng.choice(list(langs))
        t = text(lang, rng.randint(15, 60))
        if i % 6 == 0:
            toxic.add(i)
            t.insert(rng.randrange(len(t)), rng.choice(["vequx", "vequxo"]))
        elif i % 20 == 1:
            t.insert(rng.randrange(len(t)), items[i % 3][1])
        elif i % 20 == 2:
            t.insert(rng.randrange(len(t)), rng.choice(["jo@x.org", "1.2.3.4", 'key "04dbebab91ab85687d33eeaaf9ac699e1188f962"']))
        if i % 10 == 3:
            t = rows[i - 2][1].split(" ")
            t[rng.randrange(len(t))] += "x" * (i % 20 == 3)
        rows.append((i, " ".join(t), lang, f"src{i % 7}", len(" ".join(t))))
    rows += [(300, None, "en", None, None), (301, "", None, "src1", 0), (None, "une page sans nombre", "fr", "src2", 20), rows[8], (302, "ha " * 20_000, "en", "src1", 60_000)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items + [(9, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, toxic, items


def near(item, text, size=60, step=15):
    """Whether a verbatim piece of the item that is always searched for stands in the text."""
    return any(item[a : a + size] in text for a in [*range(0, len(item) - size, step), len(item) - size])


def test_pipeline_equals_a_plain_version(spark, fixture):
    root, rows, toxic, items = fixture
    kept = [r for r in rows if not (r[1] and "vequx" in r[1])]
    sets = {i: set().union(*(shingles(r[1]) for r in kept if r[0] == i)) for i in {r[0] for r in kept} - {None}}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root_of = roots(sets, linked)
    kept = [r for r in kept if r[0] is None or root_of[r[0]] == r[0]]
    assert any(root_of[i] != i for i in root_of)
    kept = [r for r in kept if not any(near(t, r[1] or "") for _, t in items)]
    pairs, holders = plain_terms([r[1] for r in kept])
    assert any("04dbeb" in w for w in holders)
    got = corpus_pipeline.run(spark, root).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None)
    got, kept = sorted(got, key=key), sorted(kept, key=key)
    assert [r.doc_id for r in got] == [r[0] for r in kept]
    for r, want in zip(got, kept):
        held = {(want[1] or "")[a:b] for _, a, b in plain(want[1])}
        touched = held or any(w in (want[1] or "") for w in holders)
        if touched:
            assert not any(v in r.text for v in held | {h for h in holders if "04" in h}) and r.n_chars == len(r.text)
        else:
            assert tuple(r)[:5] == want
        assert r.mix_rate >= 0 and math.floor(r.mix_rate) <= r.mix_copies <= math.floor(r.mix_rate) + 1
    # the expected tokens of all domains together are those of the texts; test_models holds each domain's
    tokens = [len((r.text or "").split()) for r in got]
    assert sum(r.mix_rate * n for r, n in zip(got, tokens)) == pytest.approx(sum(tokens), rel=1e-3)


def test_stages_take_odd_tables(spark, fixture, tmp_path):
    """Each stage on an empty table, on one of repeated rows, and on one with further columns of the operators' own names."""
    root, rows, _, _ = fixture
    docs = table(spark, root, "documents")
    extra = docs.where("doc_id % 5 = 0 or doc_id is null").withColumns({c: F.lit(i) for i, c in enumerate(("_base", "_terms", "_key", "_drop", "row", "key", "rep", "score", "mix_rate", "domain"))})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).collect() == []
        out = stage(spark, extra, root)
        assert set(extra.columns) <= set(out.columns) and 0 < (n := out.count()) <= extra.count()
        assert stage(spark, extra.unionByName(extra), root).count() == 2 * n


def test_stages_keep_the_columns(spark, sf_dir):
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "test")
    before = docs.count()
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = stage.save(f(spark, docs, sf_dir), f"s{i}")
        assert docs.columns[:5] == COLUMNS
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("mix_rate < 0 or mix_copies < 0").count() == 0 and docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_every_query(spark, sf_dir, name):
    """Equal to its SQL; without SQL a row for each document, or for op3 ids of both tables."""
    got = queries()[name](spark, sf_dir)
    rows = got.collect()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = c.sql(ORACLE_SQL[name])
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        at = [want.columns.index(x) for x in cols]
        assert sorted(str(tuple(r[x] for x in cols)) for r in rows) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
        return
    docs = {r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect()}
    if name.startswith("op3"):
        items = {r.item_id for r in table(spark, sf_dir, "benchmark").select("item_id").collect()}
        assert rows and {r.doc_id for r in rows} <= docs and {r.item_id for r in rows} <= items
    else:
        assert len(rows) == len(docs) and {r.doc_id for r in rows} == docs


def test_tables_can_be_removed(spark):
    saved = Stage(spark, "test").save(spark.range(3), "t")
    assert saved.count() == 3
    remove_tables(spark)
    with pytest.raises(Exception):
        spark.read.parquet(Stage(spark, "test").root.rsplit("/", 1)[0])
