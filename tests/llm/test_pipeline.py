from collections import Counter

import corpus_pipeline
from tessera.llm.decontaminate import find_leaks


def test_stages_on_what_is_left(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, left = docs, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert out.columns == first.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and out.count() == len(ids)
        if name == "quality_classifier":
            known = [i for i in labels if i in before]
            assert sum(labels[i] == int(i in ids) for i in known) / len(known) > 0.97
        if name == "simhash_near_dedup":
            assert docs.select("text").distinct().count() >= len(ids)
        if name == "suffix_array_dedup":
            assert out.selectExpr("bool_and(length(text) = n_chars)").first()[0]
        if name == "benchmark_decontamination":
            assert find_leaks(out, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        docs, left = out, [*left, len(ids)]
    assert left == sorted(left, reverse=True) and left[-1] > 0.5 * left[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = {i: len((t or "").split()) for i, t in texts.items()}
    assert all(r.text == texts[r.doc_id] and r.taken == r.size == size[r.doc_id] for r in mixed)
    assert sum(r.taken for r in mixed) > 1.4 * sum(size.values())
    assert max(Counter(r.doc_id for r in mixed).values()) == 2


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_rows_without_or_with_repeated_ids_and_clashing_columns(spark, tmp_path):
    """All stages over rows with null and repeated ids, repeated rows, null and empty texts, and columns named as the stages name theirs."""
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    base = read("documents").where("doc_id < 120").select("doc_id", "text", "source").collect()
    good = {r.doc_id for r in read("labels").where("quality = 1 AND toxic = 0").collect()}
    items = [r.text for r in read("benchmark").orderBy("item_id").limit(6).collect()]
    long = [r for r in base if r.doc_id in good and len((r.text or "").split()) > 60 and not any(i in r.text for i in items)]
    own = " ".join(long[0].text.split()[:40]) + " " + " ".join(reversed(long[1].text.split()))
    rows = [(r.doc_id, r.text, r.source) for r in base]
    rows += [(None, long[2].text, "x"), (None, own, "x"), (None, own, "x"), (long[3].doc_id, long[4].text + " again", None), (None, f"{long[5].text} {items[0]} {long[6].text}", "x"), (None, None, None), (None, "", "x"), (7, None, None)]
    clash = ("row", "row_key", "group", "key", "shard", "size", "digest", "bucket", "normal_text", "c")
    docs = spark.createDataFrame([(*r, *("v" for _ in clash)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clash)).repartition(5)
    read("labels").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, items[0])] + [(i, t) for i, t in enumerate(items[1:])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "simhash_near_dedup":
            assert (None, long[2].text) not in held and (long[2].doc_id, long[2].text) in held
            assert held.count((None, own)) == 1  # of rows that repeat one stays
        if name == "benchmark_decontamination":
            assert not any(items[0] in (t or "") for _, t in held)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    placed = Counter((r.doc_id, r.text) for r in out)
    assert set(placed) <= set(held) and max(placed.values()) <= 2 * max(Counter(held).values())
    assert sum(r.taken for r in out) > 1.2 * sum(len((t or "").split()) for _, t in held)
