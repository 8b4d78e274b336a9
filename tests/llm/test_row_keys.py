import random

from tessera.llm import decontaminate, simhash


def rows(rng):
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    one, two, three, four, five, item = (text() for _ in range(6))
    docs = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, three), (9, five), (None, five), (None, item), (7, item)]
    return docs, item


def test_near_duplicates_go_row_by_row(spark):
    docs, item = rows(random.Random(13))
    out = simhash.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"]
    gone = {(8, docs[3][1]), (None, docs[6][1]), (None, item)}  # copies of a row with a lesser id, null last
    assert sorted(map(tuple, out.collect()), key=str) == sorted(set(docs) - gone, key=str)


def test_leaks_go_row_by_row(spark, tmp_path):
    docs, item = rows(random.Random(13))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in docs if r[1] != item), key=str)
