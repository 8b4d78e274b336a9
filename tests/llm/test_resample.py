"""Resampling against plain Python, and its cutoff against a full sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import resample
from tessera.llm.queries import op13_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    found = WORD.findall((text or "").encode().lower().decode())
    return found, [" ".join(found[i : i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]


def plain(docs, target, buckets, longest, least, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in docs for g in grams(text, longest)[1])
    t = Counter(bucket(g) for text in target for g in grams(text, longest)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets))))
    rows = []
    for doc_id, text in docs:
        found, features = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in features)
        rows.append([len(found) >= least, doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    rows.sort(key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[3], r[2]))
    draw = sum(r[0] for r in rows) * percent // 100
    out, rank = [], 0
    for fits, *row in rows:
        rank += fits
        out.append((*row, rank if fits and rank <= draw else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_twin(spark, sf):
    sf = f"/root/testdata/{sf}"
    compare.check(spark, compare.connect(sf), sf, op13_resample, resample.ORACLE_SQL)


def awkward(rng):
    vocabulary = [*"abcdefghij", "Änder", "naïve", "日本", "x" * 200, "42"]
    text = lambda n: rng.choice([" ", "-", "\n\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(rng.choice([None, rng.randrange(40)]), text(rng.randrange(12))) for _ in range(300)]
    docs += [(5, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None), (7, ""), (None, "d c b a"), (3, "word " * 50_000)]
    return docs, [text(6) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("longest", "least", "percent"), [(1, 4, 10), (3, 0, 50), (2, 3, 100), (1, 100, 1)])
def test_runs_nulls_ties_repeats_and_long_texts(spark, longest, least, percent):
    docs, target = awkward(random.Random(longest))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, weight int, rank string").repartition(7)
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 64, longest, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, 64, longest, least, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    assert resample.resample(none, some.select("text")).count() == 0
    assert {r.doc_id: r.rank for r in resample.resample(some, none.select("text"), percent=100).collect()} == {1: 1, 2: None}


def test_bracket_is_widened_until_it_holds_the_cutoff(spark, monkeypatch):
    """With a coarse sketch of heavily tied scores the row is still the one that a full sort finds, and only a bracket is sorted if the sketch is fine."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 1, 1, 2, rng.randrange(100_000)]), i, 0, 0) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "score long, doc_id long, weight long, n_features long")
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    sorted_rows = []
    numbered = resample.numbered
    monkeypatch.setattr(resample, "numbered", lambda df, name: (sorted_rows.append(df.count()), numbered(df, name))[1])
    for draw in (1, 200, 2_000, 3_334, 10_000, 19_999, 20_000):
        for accuracy in (2, 50, 10_000):
            assert tuple(resample.cutoff(frame, draw, draw / 20_000, accuracy))[:4] == want[draw - 1]
    assert sorted_rows[5] < 200  # draw 200 of 20,000 with a fine sketch


def test_checksums():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5_000).astype(np.uint8)
    first = rng.integers(0, 4_000, 500)
    length = np.where(rng.random(500) < 0.9, rng.integers(0, 70, 500), rng.integers(0, 1_000, 500))
    assert resample.crc32(raw, first, length).tolist() == [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(first, length, strict=True)]


def test_ranks_are_dealt_over_ranges(spark):
    frame = spark.range(10_000).select((F.col("id") % 50).alias("score"), F.col("id").alias("doc_id"), F.lit(0).alias("weight"), F.lit(0).alias("n_features"))
    got = {r.doc_id: r.position for r in resample.numbered(frame, "test").collect()}
    want = sorted(range(10_000), key=lambda i: (-(i % 50), i))
    assert [got[i] for i in want] == list(range(1, 10_001))
