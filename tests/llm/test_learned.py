import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import mix
from tessera.llm.learn import Rows, sample_texts

SF = "/root/testdata/sf0.1"


def auc(y, x):
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    rank[order] = np.arange(1, len(x) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_toxicity_of_held_out_texts(spark, labels):
    docs, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = [r for r in toxicity.score_toxicity(docs, lab).collect() if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id][1] for r in got])
    assert auc(y, np.array([r.score for r in got])) > 0.95  # some 300 toxic texts to learn from
    said = np.array([r.predicted for r in got])
    assert said[y == 1].mean() > 0.8 and said[y == 0].mean() < 0.08
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_held_out_texts(spark, labels):
    docs, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = [r for r in quality.score_quality(docs, lab).collect() if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id][0] for r in got])
    assert auc(y, np.array([r.tail for r in got])) > 0.99
    kept = np.array([r.kept for r in got])
    assert kept[y == 1].mean() > 0.99 and kept[y == 0].mean() < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "x " * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, lab).count() == 5
    assert toxicity.score_toxicity(docs, lab.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0
    got = quality.score_quality(docs, lab)
    assert got.count() == 5 and got.where("NOT kept").count() == 0  # one grade teaches nothing
    clash = docs.selectExpr("*", "1 AS _id", "'t' AS _text", "2.0 AS tail", "true AS kept", "3 AS expected_grade")
    assert sorted(map(str, quality.keep_good(clash, lab).collect())) == sorted(map(str, clash.collect()))
    assert quality.keep_good(clash.limit(0), lab).columns == clash.columns


def test_thresholds_of_several_grades_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 2))
    z = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=3000)
    grade = (z > -1).astype(int) + (z > 0.5) + (z > 2)
    rows = Rows(np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000), x.ravel(), 3000, 2)
    weight, cuts = quality.fit(rows, grade, 4, steps=600, rate=0.05)
    assert np.allclose(weight, [2, -1], atol=0.25) and np.allclose(cuts, [-1, 0.5, 2], atol=0.25)


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    n, d = 200, 400
    pos, unl = (rng.random((n, d)) < 0.05 for _ in range(2))
    pos[:, 0] = True
    unl[:20, 0] = True
    sparse = lambda m: Rows(*np.nonzero(m), np.ones(m.sum()), n, d)
    weight, bias = toxicity.fit(sparse(pos), sparse(unl), 0.1)
    p, u = pos @ weight + bias, unl @ weight + bias
    assert np.logaddexp(0, u).mean() - 0.1 * np.logaddexp(0, p).mean() > -0.02
    assert weight[0] > np.abs(weight[1:]).max()


def plain_adam(theta, gradient, steps, rate):
    """The same descent, number by number."""
    m, v = [0.0] * len(theta), [0.0] * len(theta)
    for t in range(1, steps + 1):
        for j, g in enumerate(gradient(theta)):
            m[j] += 0.1 * (g - m[j])
            v[j] += 0.001 * (g * g - v[j])
            theta[j] -= rate * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return theta


def squash(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def word_hash(word):
    h = 0
    for i, b in enumerate(word):
        h = (h + (b + 1) * pow(0x100000001B3, i + 1, 1 << 64)) % (1 << 64)
    return int(mix(np.array([h], np.uint64))[0])


def mixed(x):
    return int(mix(np.array([x % (1 << 64)], np.uint64))[0])


def plain_quality_features(text):
    raw, out = (text or "").encode(), {}
    kinds = [int(quality.CLASSES[b]) for b in raw]

    def add(column, value):
        out[column] = out.get(column, 0.0) + value

    for g, width in enumerate(quality.GRAMS):
        n = len(kinds) - width + 1
        for i in range(n):
            code = 0
            for k in kinds[i : i + width]:
                code = code * 272 + k
            add(mixed(code + (width << 60)) % quality.BUCKETS + g * quality.BUCKETS, 1 / n)
    low = [word_hash(w) for w in raw.lower().split()]
    for h in low:
        add(h % quality.BUCKETS + 2 * quality.BUCKETS, 1 / len(low))
    n = max(len(low), 1)
    for k, share in enumerate((sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n)):
        add(quality.BUCKETS * quality.PARTS + k * quality.STEPS + min(int(share * quality.STEPS), quality.STEPS - 1), 0.2)
    return out


def graded(rng, n=36):
    words = ["alpha", "beta,", "Gamma", "delta.", "eps", "zeta!"]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 4]) for _ in range(rng.randrange(1, 25))) + ("!!" * (i % 3))) for i in range(n)]
    return rows + [(n, ""), (n + 1, None)], [(i, i % 3) for i in range(n)]


def test_quality_against_plain_python(spark):
    """Features, fit and tails of three grades, number by number."""
    rows, rated = graded(random.Random(2))
    got = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rated, "doc_id long, quality int"), keep_from=2).collect()}
    texts = dict(rows)
    used = [(plain_quality_features(texts[i]), g) for i, g in rated if zlib.crc32(str(i).encode()) % 4 != 2]
    columns = sorted({c for f, _ in used for c in f})
    at = {c: j for j, c in enumerate(columns)}
    n, shares = len(columns), [sum(g > k for _, g in used) / len(used) for k in (0, 1)]
    cuts = [-math.log(x / (1 - x)) for x in shares]

    def gradient(theta):
        first, second = theta[n], theta[n] + math.exp(theta[n + 1])
        out = [1e-5 * x for x in theta[:n]] + [0.0, 0.0]
        for f, g in used:
            z = sum(v * theta[at[c]] for c, v in f.items())
            tails = [1.0, squash(z - first), squash(z - second), 0.0]
            p = max(tails[g] - tails[g + 1], 1e-9)
            above, below = (tails[g + j] * (1 - tails[g + j]) / p / len(used) for j in (0, 1))
            for c, v in f.items():
                out[at[c]] -= (above - below) * v
            for k in (1, 2):
                d = (above if g == k else 0.0) - (below if g + 1 == k else 0.0)
                out[n] += d
                out[n + 1] += d * math.exp(theta[n + 1]) if k == 2 else 0.0
        return out

    theta = plain_adam([0.0] * n + [cuts[0], math.log(cuts[1] - cuts[0])], gradient, 200, 0.3)
    for i, t in rows:
        z = sum(v * theta[at[c]] for c, v in plain_quality_features(t).items() if c in at)
        low, high = squash(z - theta[n]), squash(z - theta[n] - math.exp(theta[n + 1]))
        assert abs(got[i].tail - high) < 2e-3 and abs(got[i].expected_grade - low - high) < 4e-3
        assert got[i].kept == (got[i].tail >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def plain_toxic_features(text):
    low = (text or "").encode().lower()
    found = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    out = {word_hash(w) % toxicity.BUCKETS for w in found}
    for w in found:
        if len(w) > toxicity.OPENING:
            code = 0
            for b in w[: toxicity.OPENING]:
                code = code * 257 + b + 1
            out.add(mixed(code + (1 << 63)) % toxicity.BUCKETS)
    return out


def test_toxicity_against_plain_python(spark):
    """Features, their choice, the non-negative risk and scores, number by number."""
    rng = random.Random(3)
    calm, rude = ["stone", "river", "mountain", "window", "garden"], ["awful", "nastiest", "vile"]
    rows = [(i, " ".join(rng.choice(calm + (rude * 3 if i % 5 == 0 else [])) for _ in range(12)) + f" n{i}") for i in range(120)] + [(120, ""), (121, None)]
    marked = [(i, int(i % 5 == 0)) for i in range(0, 120, 1)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marked, "doc_id long, toxic int")).collect()}
    free = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    labelled = [(i, y) for i, y in marked if free(i)]
    prior = sum(y for _, y in labelled) / len(labelled)
    texts = dict(rows)
    positive = [plain_toxic_features(t) for t in {texts[i] for i, y in labelled if y}]
    others = [plain_toxic_features(t) for t in {t for i, t in rows if free(i)}]
    np_, nu = len(positive), len(others)
    chosen = []
    for b in set().union(*positive, *others):
        p, u = sum(b in f for f in positive), sum(b in f for f in others)
        share = (p + u) / (np_ + nu)
        z = (p / np_ - u / nu) / math.sqrt(max(share * (1 - share) * (1 / np_ + 1 / nu), 1e-12))
        if abs(z) >= 4 and (p >= max(5, 0.005 * np_) or u >= max(5, 0.005 * nu)):
            chosen.append(b)
    assert chosen
    n = len(chosen)

    def score(theta, f):
        return theta[n] + sum(theta[j] for j, b in enumerate(chosen) if b in f)

    def gradient(theta):
        zp, zu = [score(theta, f) for f in positive], [score(theta, f) for f in others]
        soft = lambda x: math.log1p(math.exp(-abs(x))) + max(x, 0.0)
        negative = sum(map(soft, zu)) / nu - prior * sum(map(soft, zp)) / np_
        sign = 1.0 if negative >= 0 else -1.0
        up = [(prior * (squash(z) - 1) / np_ if sign > 0 else 0.0) - sign * prior * squash(z) / np_ for z in zp]
        uu = [sign * squash(z) / nu for z in zu]
        out = [1e-4 * x for x in theta[:n]] + [sum(up) + sum(uu)]
        for d, f in zip(up + uu, positive + others):
            for j, b in enumerate(chosen):
                if b in f:
                    out[j] += d
        return out

    theta = plain_adam([0.0] * n + [math.log(prior / (1 - prior))], gradient, 400, 0.05)
    for i, t in rows:
        assert abs(got[i] - squash(score(theta, plain_toxic_features(t)))) < 1e-6


def test_samples_are_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (2, "two"), (3, "three"), (None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0.0)] * 9 + [(2, 1.0), (3, 2.0), (None, 1.0)], "doc_id long, grade double")
    found = sample_texts(docs, ids, 10).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3]
    assert found == sample_texts(docs.repartition(3), ids, 10).collect() or sorted(map(str, found)) == sorted(map(str, sample_texts(docs.repartition(3), ids, 10).collect()))
    assert sample_texts(docs, ids, 2).count() == 2
