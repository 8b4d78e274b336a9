import random
from collections import Counter, defaultdict
from math import comb

from pyspark.sql import functions as F

from tessera.llm import mixing


def test_targets_quotas_and_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs, block_words=500, shard_blocks=4).collect()
    size, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    shards = defaultdict(set)
    for r in plan:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert r.taken == r.size * len(r.placements) <= 2 * r.size
        for p in r.placements:
            shards[p.shard].add(r.source)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= most[s]
    assert len(shards) > 8
    again = mixing.mix(docs, block_words=500, shard_blocks=4).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_tree_keeps_quotas_and_balances(spark):
    quotas = spark.createDataFrame([([(0, 40), (2, 7), (3, 100), (5, 3_000_000)],)], "counts array<struct<at:int,n:bigint>>")
    leaves = [{c["at"]: c["n"] for c in r.counts} for r in mixing.splitting_tree(quotas, 5).collect()]
    assert len(leaves) == 32
    assert {at: sum(c.get(at, 0) for c in leaves) for at in (0, 2, 3, 5)} == {0: 40, 2: 7, 3: 100, 5: 3_000_000}
    sums = [sum(c.values()) for c in leaves]
    assert max(sums) - min(sums) <= 1 and all(n > 0 for c in leaves for n in c.values())


def test_draws_are_hypergeometric(spark):
    cases = [(10, 4, 5), (7, 7, 3), (9, 0, 4), (50, 20, 25), (1, 1, 1), (30, 2, 29), (400, 150, 200)]
    units = [(float(whole), float(kind), float(drawn), i / 1000) for whole, kind, drawn in cases for i in range(1000)]
    df = spark.createDataFrame(units, "whole double, kind double, drawn double, unit double")
    got = defaultdict(lambda: defaultdict(int))
    for r in df.select("*", mixing.hypergeometric(*(F.col(c) for c in ("unit", "whole", "kind", "drawn"))).alias("n")).collect():
        got[(r.whole, r.kind, r.drawn)][r.n] += 1
    for whole, kind, drawn in cases:
        n = got[(whole, kind, drawn)]
        assert sum(n.values()) == 1000
        for x in range(max(0, drawn - whole + kind), min(kind, drawn) + 1):
            assert abs(n.pop(x, 0) / 1000 - comb(kind, x) * comb(whole - kind, drawn - x) / comb(whole, drawn)) <= 0.0021
        assert not n


def test_nothing_is_taken_that_no_shard_draws(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, levels: quotas.selectExpr("0L AS shard", "filter(counts, x -> false) AS counts"))
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] == 0


def test_written_mix_has_every_placement(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 2, "ab"[i % 2] if i % 7 else None, " ".join(rng.choice("xyz") for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(5, "a", "same same")] * 4 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("row_id", F.lit("clash")).withColumn("shard", F.lit(1))
    how = {"block_words": 20, "shard_blocks": 2}
    mixing.write_mix(docs, f"{tmp_path}/mix", **how)
    out = spark.read.parquet(f"{tmp_path}/mix").collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size)
    want = Counter()
    for r in mixing.mix(docs, **how).collect():
        want[key(r)] += len(r.placements)
    assert +want == Counter(map(key, out))
    assert sum(r.taken for r in out) > 1.3 * sum(len((t or "").split()) for _, _, t in rows)
    assert len({r.shard for r in out}) > 4
    texts = Counter((str(i), str(s), t) for i, s, t in rows)
    assert all(n <= 2 * texts[k] for k, n in Counter((str(r.doc_id), str(r.source), r.text) for r in out).items())


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, "x y  z"), (3, "b", ""), (None, "b", "w " * 50), (4, "b", "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == 6
    assert {r.doc_id: r.size for r in got}[2] == 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_rows_without_ids_and_with_one_id_are_taken_whatever_their_size(spark):
    """A target of 1.05 of a source: the documents taken twice have about the mean size, without ids and with one id for half the rows; another partitioning changes nothing."""
    rng = random.Random(9)
    texts = [f"t{i} " + "w " * rng.randrange(5, 60) for i in range(4_000)]
    mean = sum(len(t.split()) for t in texts) / len(texts)
    how = {"share": 1.05, "block_words": 2_000, "shard_blocks": 32}
    for ids in ([None] * 4_000, [7] * 2_000 + [8] * 2_000):
        docs = spark.createDataFrame([(i, "a", t) for i, t in zip(ids, texts, strict=True)], "doc_id long, source string, text string")
        out = [tuple(r) for r in mixing.mixed(docs, **how).select("shard", "rank", "copy", "doc_id", "text").collect()]
        taken = Counter(r[4] for r in out)
        twice = [len(t.split()) for t, n in taken.items() if n == 2]
        assert len(taken) == 4_000 and 150 < len(twice) < 250
        assert abs(sum(twice) / len(twice) / mean - 1) < 0.1
        if ids[0] is None:
            again = [tuple(r) for r in mixing.mixed(docs.repartition(7), **how).select("shard", "rank", "copy", "doc_id", "text").collect()]
            assert sorted(out, key=str) == sorted(again, key=str)
