"""Rules that hold for any input, and hand-made cases of odd rules."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import udtf
from tessera.operators import fulltext, ranking, text, vectors, web
from tessera.plans import registry
from tessera.sources import tables
from tessera.streaming import streams

WORDS = st.lists(st.text("abc.!? \n", min_size=1, max_size=6), max_size=2_000)


@settings(max_examples=40, deadline=None)
@given(WORDS)
def test_chunks_cover_a_section(pieces):
    body = " ".join(pieces)
    words = re.split(r"\s+", body)
    at, ends = 0, []
    for chunk, tokens in text.chunks(body, least=0):
        n = len(chunk.split(" "))
        assert chunk == " ".join(words[at : at + n]) and tokens == int(n * 1.3 + 1e-9)
        assert n <= 770 and (n >= 385 or at + n == len(words))
        ends.append(at + n)
        at = at + n - 76
    assert ends and ends[-1] == len(words)


def test_chunk_limits():
    assert text._words_for(500) == 385 and text._words_for(1_000) == 770


def test_sections_titles():
    md = "intro\n# One\nfirst body\n## Two\nsecond body"
    assert text.sections(md) == [("", "intro\n"), ("One", "\nfirst body\n"), ("Two", "\nsecond body")]
    assert [t for t, _ in text.sections(md, legacy_titles=True)] == ["One", "Two", ""]
    assert text.packed(["a" * 3000, "b" * 999, "c" * 10]) == ["a" * 3000 + "\n\n" + "b" * 999, "c" * 10]


def test_texts_are_packed_and_split_in_pieces(spark):
    """Python holds a few texts at once, not a whole batch; the rows are those of each text for itself."""
    texts = [f"# t{i}\n" * (i % 3 == 0) + "\n\n".join("p" * (i * 37 % 3000) for _ in range(i % 7)) for i in range(300)]
    batch = text.pa.RecordBatch.from_pydict({"id": list(range(300)), "content_text": texts})
    parts = list(text.pieces([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 64 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(300))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content_text string").coalesce(1)
    want = {(i, n, b) for i, t in enumerate(texts) if t for n, b in enumerate(text.packed(re.split(r"\n\n+", t)))}
    assert {tuple(r) for r in text.pack_paragraphs(df).collect()} == want
    want = {(i, n, *s) for i, t in enumerate(texts) if t for n, s in enumerate(text.sections(t))}
    assert {tuple(r) for r in text.split_sections(df).collect()} == want


def test_cosine_rules(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, [0.0, 0.0], [1.0, 2.0]), (4, None, [1.0]), (5, [3.0, 4.0], [4.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {r.id: (round(r.x, 6), round(r.y, 6)) for r in df.select("id", C.cosine_similarity("a", "b").alias("x"), C.cosine_similarity("b", "a").alias("y")).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0.96, 0.96)}


def test_top_k_is_a_prefix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    few, more = ({(r.query_id, r["rank"]): r.id for r in vectors.best(vectors.scored(q, e), k).collect()} for k in (4, 5))
    assert few.items() <= more.items()


def test_ann_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = {(r.query_id, r.id) for r in registry.queries()["V12_ann_search"](spark, "/root/testdata/sf0.01").collect()}
    exact = {(r.query_id, r.id) for r in vectors.best(vectors.scored(q, e), 10).collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, v string")
    b = spark.createDataFrame([(3, "new"), (12, "more")], "id int, v string")
    once = tables.upsert_by_key(a, b, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert_by_key(once, b, ["id"]).collect()))


def test_retention_keeps_more_for_longer(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d} 00:00:00", i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts string, resolved boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = [{r.id for r in tables.retention(df, "errors", "2024-01-31 00:00:00", d).collect()} for d in (5, 10, 20)]
    assert kept[0] <= kept[1] <= kept[2]


def test_websearch_syntax():
    assert fulltext.parse_websearch('alpha -beta or "gamma delta"') == [[(True, ["alpha"]), (False, ["beta"])], [(True, ["gamma", "delta"])]]


def test_cover_density_by_hand(spark):
    docs = spark.createDataFrame([(1, "red x blue red"), (2, "red"), (3, "blue red")], "id int, t string")
    terms = spark.createDataFrame([(9, 0, "red"), (9, 1, "blue")], "query_id int, term_no int, term string")
    got = {r.id: round(r.text_rank, 6) for r in fulltext.text_rank_cd(fulltext.tokenize_index(docs, "id", "t"), terms).collect()}
    assert got == {1: round(0.1 / 2 + 0.1, 6), 3: 0.1}


def test_expected_strategies(spark):
    asked = {
        "How do I change the database configuration?": "chunk-based",
        "performance strategies": "hybrid",
        "what was said about the meeting notes": "semantic",
        "code examples for API integration": "chunk-based",
        "similar documents to manufacturing processes": "semantic",
        '"exact phrase"': "keyword",
    }
    df = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    assert [r.strategy for r in ranking.classify_intent(df).orderBy("query_id").collect()] == list(asked.values())


def test_page_reading():
    html = '<html lang="de"><head><title> A &amp; B </title><meta name="keywords" content="x, y,"><meta property="article:published_time" content="2024-02-03T04:05:06Z"></head><body><nav><a href="/n">no</a></nav><article><p>One</p><p>two<script>bad()</script></p><a href="b#c">link</a><img src="i.png" alt="pic"></article></body></html>'
    got = web.read_page("http://h.example/a/", html)
    assert got["title"] == "A & B" and got["language"] == "de" and got["keywords"] == ["x", "y"] and got["content"] == "One two link"
    assert got["links"] == ["http://h.example/n", "http://h.example/a/b#c"] and got["images"] == [{"src": "http://h.example/a/i.png", "alt": "pic"}]
    assert str(got["published"]) == "2024-02-03 04:05:06"
    assert web.read_page("", "")["title"] == "Untitled"


def test_robots_rules(spark):
    txt = "User-agent: *\nDisallow: /Private\nDisallow: /\nSitemap: https://h/s.xml\nUser-agent: other\nDisallow: /x"
    robots = spark.createDataFrame([("h", txt)], "host string, content string")
    now = {(r.kind, r.value) for r in web.robots_rules(robots).collect()}
    assert now == {("disallow", "/Private"), ("disallow", "/"), ("sitemap", "https://h/s.xml")}
    old = {(r.kind, r.value) for r in web.robots_rules(robots, legacy=True).collect()}
    assert old == {("disallow", "/private")}


def test_frontier_parents(spark):
    edges = spark.createDataFrame([("a", 0, "c"), ("a", 1, "b"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "a"), ("d", 1, "e")], "src string, pos int, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r.url: (r.depth, r.parent, r.place) for r in web.crawl_frontier(edges, seeds, 3, 4).collect()}
    assert got == {"a": (0, None, 1), "c": (1, "a", 2), "b": (1, "a", 3), "d": (2, "c", 4)}


def test_analysis_records(spark):
    rows = [(1, 'Sure: {"description": "d", "technicalContent": {"containsCode": true, "technicalTerms": ["t"]}} ok'), (2, "a flowchart with a button {broken"), (3, "{not json}")]
    got = {r.id: r.analysis for r in text.parse_analysis_json(spark.createDataFrame(rows, "id int, said string"), "said").collect()}
    assert got[1].contains_code and got[1].technical_terms == ["t"] and got[1].confidence == 0.5
    assert got[2].contains_diagrams and got[2].contains_ui and got[2].confidence == 0.3 and got[3].confidence == 0.3


def test_long_queries_are_answered_whole(spark):
    """Nine and twenty terms: a row that lacks one is no hit, and ranks are those of a plain count of minimal spans."""
    names = [f"w{i}x" for i in range(20)]
    texts = [" ".join(names), " ".join(names[:19]), " ".join(reversed(names)) + " gap " + " ".join(names), " ".join(n + " pad" for n in names), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = fulltext.tokenize_index(docs, "id", "text")
    for n in (1, 9, 20):
        terms = fulltext.query_terms(spark.createDataFrame([(7, " ".join(names[:n]))], "query_id long, query string"))
        assert terms.count() == n
        want = {}
        for i, t in enumerate(texts):
            places = [(p, names.index(w)) for p, w in enumerate(t.split()) if w in names[:n]]
            last, before, rank = {}, -1, 0.0
            for p, w in places:
                last[w] = p
                start = min(last.values())
                if len(last) == n and start > before:
                    before, rank = start, rank + 0.1 / (1 + p - start + 1 - n)
            if len(last) == n:
                want[i] = round(rank, 9)
        assert {r.id for r in fulltext.match_all_terms(index, terms).collect()} == set(want)
        assert {r.id: round(r.text_rank, 9) for r in fulltext.text_rank_cd(index, terms).collect()} == want


def test_packed_paragraphs(spark):
    rows = [(1, "a\n\nb"), (2, "\n\n".join("x" * n for n in (900, 900, 900, 2500, 10, 4000, 1))), (3, ""), (4, None), (5, "y" * 9000)]
    got = {}
    for r in sorted(text.pack_paragraphs(spark.createDataFrame(rows, "id long, content_text string"), 2000).collect(), key=lambda r: (r.id, r.section)):
        got.setdefault(r.id, []).append(r.body)
    for i, t in rows:
        want, held = [], ""
        for p in (t or "").split("\n\n"):
            if held and len(held) + len(p) < 2000:
                held += "\n\n" + p
            else:
                want, held = want + [held] * bool(held), p
        want += [held] * bool(held)
        assert got.get(i, []) == want


def test_all_links_of_a_page(spark):
    html = "<html><body>" + "".join(f'<a href="/p{i}">x</a>' for i in range(300)) + "</body></html>"
    pages = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
    assert web.extract_links(pages).count() == 100
    assert web.extract_links(pages, 250).count() == 250


def test_table_functions_give_what_the_operators_give(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, "# A\nsome words here. " * 600 + "\n# B\nmore of them! " * 400), (2, None), (3, "")], "id long, content_text string").createOrReplaceTempView("udtf_docs")
    got = spark.sql("SELECT id, chunk_index, chunk_text, token_count FROM udtf_docs, LATERAL text_chunks(content_text)").collect()
    want = text.chunk_documents(spark.table("udtf_docs")).select("document_id", "chunk_index", "chunk_text", "token_count").collect()
    assert len(got) > 3 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    spark.createDataFrame([(1, "https://a.example/x/", '<a href="y">1</a><a href="/z">2</a><a href="y">3</a>')], "page_id long, url string, html string").createOrReplaceTempView("udtf_pages")
    links = spark.sql("SELECT page_id, pos, link FROM udtf_pages, LATERAL page_links(url, html)").collect()
    assert sorted(map(tuple, links)) == sorted(map(tuple, web.extract_links(spark.table("udtf_pages")).collect())) and len(links) == 2


def plain_chunks(body):
    """The rule of chunks in closed form: 385 words, on to the first that ends a sentence, 770 at most; the next begins 76 back."""
    words, s, out = re.split(r"\s+", body), 0, []
    while True:
        last = min(s + 770, len(words))
        e = next((i + 1 for i in range(s + 385, last) if words[i][-1:] in (".", "!", "?")), last)
        if len(" ".join(words[s:e])) >= 100:
            out.append((" ".join(words[s:e]), int((e - s) * 13) // 10))
        if e >= len(words):
            return out
        s = max(e - 76, s + 1)


def test_chunks_of_whole_tables_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in sorted(registry.queries()["T10_chunk_section"](spark, sf_dir).collect(), key=lambda r: (r.document_id, r.chunk_index)):
        got.setdefault(r.document_id, []).append((r.n_chars, r.token_count))
    want = {i: [(len(c), n) for c, n in plain_chunks(re.sub(r"\n\s*\n", "\n", t))] for i, t in docs.items() if t}
    assert got == {i: c for i, c in want.items() if c}
    found = {}
    for r in sorted(registry.queries()["T12_chunk_documents"](spark, sf_dir).collect(), key=lambda r: (r.document_id, r.chunk_index)):
        assert r.chunk_index == len(found.setdefault(r.document_id, []))
        found[r.document_id].append((r.digest, r.token_count))
    whole = {i: plain_chunks(t) for i, t in docs.items() if t and i % 13 and not re.search(r"(?m)^#{1,6}\s|\n\n", t)}
    assert len(whole) > 0.9 * len([i for i in docs if i % 13])
    for i, chunks in whole.items():
        assert found.get(i, []) == [(hashlib.sha256(c.encode()).hexdigest(), n) for c, n in chunks]
