"""The classifiers and the mixture against plain versions that share no code with them."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import mixing, quality, toxicity
from lodestone.llm._spark import Stage
from lodestone.llm._terms import words_and_prefixes

LATIN = {i: i + 32 for i in [*range(65, 91), *range(0xC0, 0xDF)] if i != 0xD7}
TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\U0010ffff]+")
fold = lambda i: zlib.crc32(str(i).encode()) % 5


def corpus(bad):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice(["ab", "cé", "d", "É", "F", "7"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(160):
        text = [word() for _ in range(rng.randint(3, 25))]
        rows.append((i, " ".join(text) if i % 3 else bad(text, rng)))
    return rows + [(7, rows[7][1]), (200, None), (201, ""), (202, "ab " * 9000), (203, "x" * 70_000), (None, "ab cé")]


def frames(spark, rows, label):
    d = spark.createDataFrame([(i, t, 1, 2.0, "k") for i, t in rows], "doc_id bigint, text string, y int, score double, key string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(160)] + [(5, None, 1), (5, 0, 1), (999, 1, 1)], f"doc_id bigint, {label} int, y int")
    order = {r.doc_id: r.k for r in d.selectExpr("doc_id", "xxhash64(doc_id) as k").collect()}
    # the sample is fitted in the order of the hashes of its ids
    sample = sorted(((i, t) for i, t in rows if i is not None and i < 160 and fold(i)), key=lambda r: order[r[0]])
    return d, labels, sample


def quality_features(text):
    tokens = [m.group() for m in TOKEN.finditer(text or "")]
    low = [t.translate(LATIN) for t in tokens]
    grams = {(t,) for t in low} | set(zip(low, low[1:]))
    shape = []
    for k, t in enumerate(tokens):
        caps, size = sum("A" <= c <= "Z" for c in t), len(t.encode())
        if k and low[k] == low[k - 1]:
            shape.append(5)
        elif not re.match(r"[0-9A-Za-z\x80-\U0010ffff]", t):
            shape.append(low[k])
        else:
            shape.append(4 if re.search("[0-9]", t) else 3 if caps == size > 1 else 2 if caps else 1)
    x = {("g", g): 1 / math.sqrt(len(grams)) for g in grams}
    return x | {("s", tuple(shape[k : k + n])): 1.0 for n in (1, 2, 3) for k in range(len(shape) - n + 1)}


def test_quality_equals_plain_ftrl(spark):
    rows = corpus(lambda text, rng: " ".join(w + rng.choice(["!!", "$$", " " + w]) for w in text))
    d, labels, sample = frames(spark, rows, "quality")
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    q = quality

    def weight(k):
        if k == "bias":
            return -z[k] / ((q.BETA + math.sqrt(n[k])) / q.ALPHA)
        return 0.0 if abs(z[k]) <= q.L1 else -(z[k] - math.copysign(q.L1, z[k])) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for _ in range(q.EPOCHS):
        for i, t in sample:
            x = {"bias": 1.0} | quality_features(t)
            err = chance(x) - (i % 3 == 0)
            for k, v in x.items():
                w, g = weight(k), err * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / q.ALPHA * w
                n[k] += g * g
    want = {i: chance({"bias": 1.0} | quality_features(t)) for i, t in rows}
    got = quality.quality(d, labels).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id], abs=2e-4) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (None if r.doc_id is None else fold(r.doc_id) == 0) for r in got)


def toxic_terms(text):
    low = (text or "").translate(LATIN)
    words = {m.group() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", low)}
    return {(w, 0) for w in words} | {(w[:n], n) for w in words for n in (3, 4, 5) if len(w) > n}


def test_toxicity_equals_plain_machine(spark):
    rows = corpus(lambda text, rng: " ".join([*text, rng.choice(["vequx", "idiotic"]), "group"]))
    d, labels, sample = frames(spark, rows, "toxic")
    model = toxicity.train(d, labels, Stage(spark, "test"))
    # the terms: chi-square with Yates's correction over the sample
    total, positive = len(sample), sum(i % 3 == 0 for i, _ in sample)
    count = collections.Counter((t, i % 3 == 0) for i, text in sample for t in toxic_terms(text))
    p, chosen = positive / total, set()
    for t in {t for t, _ in count}:
        n, pos = count[t, True] + count[t, False], count[t, True]
        chi = max(abs(pos - n * p) - 0.5, 0) ** 2 / (n * p * (1 - p) * (1 - n / (total + 1)) + 1e-9)
        if chi >= toxicity.CHI_SQUARE:
            chosen.add(t)
    assert len(model.terms.hashes) == len(chosen) and ("group", 0) in chosen

    def number(term):
        word, n = term
        data = np.frombuffer((word + "x" * bool(n)).encode(), np.uint8)
        hashes = words_and_prefixes(data, np.array([0, len(data)]))[0]
        return int(np.searchsorted(model.terms.hashes, hashes[len(word) - 2 if n else 0]))

    at = {t: number(t) for t in chosen}

    def score(text):
        x = sorted({at[t] for t in toxic_terms(text) & chosen})
        s = model.bias + sum(model.w[i] for i in x) + sum(float(model.v[i] @ model.v[j]) for a, i in enumerate(x) for j in x[:a])
        return 1 / (1 + math.exp(-s))

    want = {i: score(t) for i, t in rows}
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 160) >= 155


def test_mixed_documents_get_soft_memberships_and_least_squares_rates(spark):
    """Unlabelled documents that mix domains: shares between 0 and 1, and rates as good as a plain nonnegative solver's."""
    rng = random.Random(18)
    vocab = {"a": "the of and to in", "b": "le la les des un", "c": "der die das und ein"}
    pick = lambda k, n: [rng.choice((vocab[k] + " x y z").split()) for _ in range(n)]
    rows, known = [], []
    for i in range(90):
        k = "abc"[i % 3]
        rows.append((i, " ".join(pick(k, rng.randint(5, 30)))))
        known.append((i, k))
    for i in range(90, 240):
        k, l = rng.sample("abc", 2)
        rows.append((i, " ".join(pick(k, rng.randint(4, 12)) + pick(l, rng.randint(4, 12)))))
    rows += [(7, rows[7][1]), (300, None), (None, "le la")]
    d = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id bigint, text string, rate int, posterior string")
    labelled = spark.createDataFrame(known, "id bigint, domain string")
    stage = Stage(spark, "test")
    model = mixing.train(d, labelled, stage, "doc_id", "text")
    members = mixing.members(d, model, stage, "doc_id", "text").collect()
    p, n = np.array([r.posterior for r in members]), np.array([r.n_tokens for r in members], float)
    mixed = np.array([r.doc_id is not None and 90 <= r.doc_id < 240 for r in members])
    assert np.mean(p[mixed].max(axis=1) < 0.9) > 0.5 and np.allclose(p.sum(axis=1), 1)
    for weights in ({"a": 1, "b": 1, "c": 2}, {"a": 1, "b": 0, "c": 0}, {"a": 0.9, "c": 0.1}):
        got = mixing.mix_to_targets(d, labelled, weights).collect()
        r = np.array([x.rate for x in got])
        assert sorted(x.n_tokens for x in got) == sorted(n) and (r >= 0).all()
        share = np.array([weights.get(x, 0.0) for x in "abc"])
        target = share / share.sum() * n.sum()
        a = (n[:, None] * p).T  # domain tokens of each document at rate 1
        miss = lambda x: np.linalg.norm(a @ x - target) / n.sum()
        best = np.ones(len(n))  # plain projected gradient of the same length, rates in units of 1 / tokens
        step = 1 / np.linalg.norm(a @ p, 2)
        for _ in range(mixing.STEPS):
            best = np.maximum(0, best - step * p @ (a @ best - target))
        by = {(x.doc_id, x.n_tokens, round(x.posterior, 9)): x.rate for x in got}
        mine = np.array([by[m.doc_id, m.n_tokens, round(max(m.posterior), 9)] for m in members])
        assert miss(mine) <= (1e-5 if min(share) else miss(best) + 1e-3)
    out = mixing.with_rates(d, labelled, {"a": 1, "b": 1, "c": 2})
    rates = {(x.doc_id, x.text): (x.mix_rate, x.mix_copies) for x in out.collect()}
    assert len(rates) == len(rows) - 1 and all(x >= 0 and math.floor(x) <= c <= math.floor(x) + 1 for x, c in rates.values())
    assert mixing.with_rates(d.limit(0), labelled, {"a": 1}).collect() == [] and {x.mix_rate for x in mixing.with_rates(d, labelled.limit(0), {"a": 1}).collect()} == {1.0}
