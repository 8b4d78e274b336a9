"""Folders of files: manifests, texts and uploads in parts."""

import os
import random

from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources import files, tables


def folder(tmp_path):
    (tmp_path / "a" / "b.c").mkdir(parents=True)
    texts = {"a/one.txt": "  Ünïcode \n", "a/b.c/two.MD": "# T", "a/b.c/three.pdf": "%PDF", "four.txt": "", "a/none": "x", "a/.hidden.txt": "no", "five.txt": "long " * 1_000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return texts


def test_manifest_reads_no_content(spark, tmp_path):
    texts = folder(tmp_path)
    found = files.manifest(files.read_files(spark, str(tmp_path)))
    want = {(os.path.basename(n), ext, len(texts[n].encode())) for n, ext in (("a/one.txt", ".txt"), ("a/b.c/two.MD", ".md"), ("a/b.c/three.pdf", ".pdf"), ("a/none", ""), ("five.txt", ".txt"))}
    assert {(r.name, r.ext, r.length) for r in found.collect()} == want
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    some = files.manifest(files.read_files(spark, str(tmp_path), "*.txt", most_bytes=100))
    assert {r.name for r in some.collect()} == {"one.txt"}
    assert "LessThanOrEqual(length,100)" in some._jdf.queryExecution().toString()


def test_texts_of_a_folder(spark, tmp_path):
    folder(tmp_path)
    got = {os.path.basename(r.path): (r.ext, r.content_text, r.status) for r in files.ingest_folder(spark, str(tmp_path)).collect()}
    assert got["one.txt"] == (".txt", tables_trim("  Ünïcode \n"), "completed") and got["two.MD"] == (".md", "# T", "completed")
    assert "four.txt" not in got and got["three.pdf"][1:] == (None, "error")
    first = {r.path: r.id for r in files.ingest_folder(spark, str(tmp_path)).collect()}
    (tmp_path / "aaa.txt").write_text("new")
    assert first.items() <= {r.path: r.id for r in files.ingest_folder(spark, str(tmp_path)).collect()}.items()


def tables_trim(text):
    return text.strip(" ")  # as text_ingest does


def test_sessions_are_put_together_part_by_part(spark, tmp_path):
    rng = random.Random(5)
    data = {"s1": rng.randbytes(100_003), "s2": rng.randbytes(10), "gap": rng.randbytes(5_000), "empty": b""}
    for session, raw in data.items():
        (tmp_path / "up" / "chunks" / session).mkdir(parents=True)
        for i in range(0, max(1, -(-len(raw) // 1_000))):
            if session != "gap" or i != 2:
                (tmp_path / "up" / "chunks" / session / f"chunk_{i}").write_bytes(raw[i * 1_000 : (i + 1) * 1_000])
    (tmp_path / "up" / "chunks" / "s1" / "notes.txt").write_text("not a part")
    expected = spark.createDataFrame([(s, max(1, -(-len(raw) // 1_000))) for s, raw in data.items()] + [("absent", 3)], "session string, expected int")
    found = files.read_files(spark, f"{tmp_path}/up", "chunk_*")
    out = f"{tmp_path}/out"
    for _ in range(2):  # repeating it changes nothing
        files.write_sessions(found, expected, out, parts_a_file=16)
        rows = spark.read.parquet(out).orderBy("session", "part").collect()
        assert {r.session for r in rows} == {"s1", "s2"}
        for session in ("s1", "s2"):
            mine = [r for r in rows if r.session == session]
            assert b"".join(bytes(r.content) for r in mine) == data[session]
            assert [r.first_byte for r in mine] == [1_000 * i for i in range(len(mine))]
    assert len([f for f in os.listdir(f"{out}/session=s1") if f.endswith(".parquet")]) == 7  # 101 parts, 16 a file
    for first, n in ((0, 10), (995, 10), (50_500, 3_000), (99_990, 1_000), (0, 200_000)):
        got = files.session_bytes(spark, out, "s1", first, n)
        assert b"".join(bytes(r.content) for r in got.collect()) == data["s1"][first : first + n]
    ordered = tables.ordered_parts(found, tables.blob_manifest(found, expected).select("session", "complete"))
    held = ordered.withColumn("at", F.spark_partition_id()).collect()
    assert {s: b"".join(bytes(r.content) for r in held if r.session == s) for s in ("s1", "s2")} == {s: data[s] for s in ("s1", "s2")}
    assert all(len({r["at"] for r in held if r.session == s}) == 1 for s in ("s1", "s2"))


def test_the_input_s_own_files(spark, sf_dir):
    got = {r.name: r.length for r in registry.queries()["S3_file_manifest"](spark, sf_dir).collect()}
    assert got == {n: os.path.getsize(f"{sf_dir}/{n}") for n in os.listdir(sf_dir) if n.endswith(".parquet")}
