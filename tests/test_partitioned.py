"""Tables in parts: only what changes is rewritten, and what is there equals the plain operators."""

import os
import random

from pyspark.sql import functions as F

from tessera.sources import partitioned, tables


def listed(path):
    return {(d[len(path) :], f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    target = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(300)] + [(None, "no key", 0)], "id long, name string, n int")
    partitioned.write_keyed(target, path, ["id"], 16)
    assert rows_of(partitioned.read_keyed(spark, path)) == rows_of(target)
    source = spark.createDataFrame([(5, "new", 1, 10), (5, "newer", 2, 20), (900, "added", None, 1), (7, "v7", 1, 1)], "id long, name string, n int, at int")
    before = listed(path)
    touched = partitioned.upsert_keyed(spark, path, source, ["id"], 16, newest="at")
    want = tables.upsert_by_key(target, source, ["id"], "at")
    assert rows_of(partitioned.read_keyed(spark, path)) == rows_of(want)
    after = listed(path)
    changed = {int(d.split("=")[1]) for d, _ in before ^ after}
    assert changed == set(touched) and 1 <= len(touched) <= 2  # 7 is as it was
    assert partitioned.upsert_keyed(spark, path, source, ["id"], 16, newest="at") == []
    assert listed(path) == after


def test_children_are_replaced_where_they_differ(spark, tmp_path):
    path = f"{tmp_path}/t"
    target = spark.createDataFrame([(i, i % 40, f"c{i}") for i in range(200)], "id long, parent long, name string")
    partitioned.write_keyed(target, path, ["parent"], 8)
    new = spark.createDataFrame([(1_000, 3, "x"), (1_001, 3, "y"), (1_002, 77, "z")] + [(i, 4, f"c{i}") for i in range(4, 200, 40)], "id long, parent long, name string")
    before = listed(path)
    touched = partitioned.replace_children_keyed(spark, path, new, "parent", 8)
    assert rows_of(partitioned.read_keyed(spark, path).select("id", "parent", "name")) == rows_of(tables.replace_children(target, new, "parent"))
    assert {int(d.split("=")[1]) for d, _ in before ^ listed(path)} == set(touched) and 1 <= len(touched) <= 2
    assert partitioned.replace_children_keyed(spark, path, new, "parent", 8) == []


def test_counts_come_with_the_write(spark, tmp_path, sf_dir):
    from tessera.plans.fixtures import Tables

    logs = Tables(spark, sf_dir)("kb_logs")
    ok, failed, counts = tables.validate_records(logs)
    found = partitioned.write_validated(logs, f"{tmp_path}/logs")
    assert found == counts.first().asDict()
    written = spark.read.parquet(f"{tmp_path}/logs")
    assert written.where("valid = 'true'").count() == ok.count() == found["ok"] > 0
    assert written.where("valid = 'false'").count() == failed.count() == found["failed"] > 0
    assert partitioned.write_validated(logs.limit(0), f"{tmp_path}/none") == {"ok": 0, "failed": 0}


def test_retention_by_day(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["error", "info"]), rng.random() < 0.5, rng.randrange(60 * 24 * 60)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, level string, resolved boolean, m int").select("id", "level", "resolved", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)").alias("ts"))
    as_of = "2024-02-29 10:30:00"
    for kind in ("logs", "metrics", "errors"):
        path = f"{tmp_path}/{kind}"
        partitioned.write_by_day(df, path)
        want = rows_of(tables.retention(df, kind, as_of))
        found = partitioned.retained(spark, path, kind, as_of)
        assert rows_of(found) == want
        if kind != "errors":
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
        before = listed(path)
        changed = partitioned.expire(spark, path, kind, as_of)
        assert rows_of(spark.read.parquet(path).select(*df.columns)) == want
        assert {d.split("=")[1] for d, _ in before ^ listed(path)} == set(changed) and len(changed) > 20
        after = listed(path)
        assert partitioned.expire(spark, path, kind, as_of) == [] and listed(path) == after
