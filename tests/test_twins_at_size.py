"""Twins on tables that the given ones don't show: long pages, ranks and times that are equal."""

import os
import random

import duckdb

import compare
from tessera.operators import web as W
from tessera.plans import registry


def changed(tmp_path, **tables):
    """sf0.001 with some tables made anew by SQL of DuckDB."""
    source = "/root/testdata/sf0.001"
    for f in os.listdir(source):
        if f.split(".")[0] not in tables:
            os.symlink(f"{source}/{f}", tmp_path / f)
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql.format(t=f"'{source}/{name}.parquet'")}) TO '{tmp_path / name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def twin(spark, sf, name):
    compare.check(spark, compare.connect(sf), sf, registry.queries()[name], registry.oracle_sql()[name])


def test_long_pages_are_extracted_whole(spark, tmp_path):
    sf = changed(tmp_path, pages="SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN concat(replace(html, '<title>', concat('<title>', repeat('long ', 150))), repeat('<p>more</p>', 10000)) ELSE html END AS html FROM {t}")
    assert max(r.n_html for r in registry.queries()["C1_html_extract"](spark, sf).collect()) > 100_000
    twin(spark, sf, "C1_html_extract")


def test_equal_ranks_go_by_id(spark, tmp_path):
    """Two hundred pages of the same words rank equally, whatever the order in which these are added."""
    words = [f"w{i} " * random.Random(i).randrange(1, 40) for i in range(40)]
    rows = ", ".join(f"({i}, '{' '.join(random.Random(i).sample(words, 40))}')" for i in range(200))
    title = " ".join(f"w{i}" for i in range(40))
    sf = changed(tmp_path, pages=f"SELECT i AS page_id, concat('http://a.b/', i) AS url, concat('<title>', CASE WHEN i % 100 = 0 THEN '{title}' ELSE 'x' END, '</title>', t) AS html FROM (VALUES {rows}) v(i, t)")
    assert registry.queries()["T7_web_content_search"](spark, sf).count() == 40
    twin(spark, sf, "T7_web_content_search")


def test_jobs_of_one_time_go_by_id(spark, tmp_path):
    sf = changed(tmp_path, events="SELECT event_id, date_trunc('day', ts) AS ts, user_id, event_type, value, props FROM {t} ORDER BY hash(event_id)")
    twin(spark, sf, "W7_current_job")


def test_streams_have_every_window(spark, sf_dir):
    """The newest hours and the windows that reach beyond them, too."""
    con = compare.connect(sf_dir)
    newest = con.execute("SELECT date_trunc('hour', max(ts)), date_trunc('hour', max(ts) FILTER (WHERE event_type = 'error')) + INTERVAL '24' HOUR FROM events").fetchall()[0]
    found = registry.queries()
    assert max(r.time_bucket for r in found["X1_stream_health_trend"](spark, sf_dir).collect()) == newest[0]
    assert max(r.as_of for r in found["X2_stream_error_summary"](spark, sf_dir).collect()) == newest[1]


def test_hits_are_every_fortieth_document(spark, sf_dir):
    """Searches' hits grow with the documents for each query."""
    pairs = compare.connect(sf_dir).execute("SELECT count(*), count(DISTINCT b.item_id) FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40").fetchall()[0]
    found = registry.queries()
    for name in ("R1_rerank", "R7_query_relevance", "R13_normalize_hits"):
        assert found[name](spark, sf_dir).count() == pairs[0], name
    assert found["A13_search_summary"](spark, sf_dir).first().total == pairs[0]
    assert sum(r.n for r in found["R2_confidence"](spark, sf_dir).collect()) == pairs[0]
    assert pairs[0] >= 5 * pairs[1]


def test_links_go_to_every_fiftieth_page(spark, tmp_path):
    """A page's links grow with the pages."""
    sf = changed(tmp_path, pages="SELECT page_id + 50 * r AS page_id, concat('http://h.example/', page_id + 50 * r) AS url, html FROM {t}, range(4) v(r)")
    found = registry.queries()
    assert found["C13_link_type"](spark, sf).count() == compare.connect(sf).execute("SELECT count(*) FROM pages a JOIN pages b ON a.page_id % 50 = b.page_id % 50").fetchall()[0][0] == 800
    for name in ("C13_link_type", "C3_filter_normalize_urls", "C3_filter_external_urls"):
        twin(spark, sf, name)


def test_external_links_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Pages that repeat, in one group and in others, before and after zero, and pages without an address: each link comes once, without an exchange after bases meet addresses."""
    sf = changed(tmp_path, pages="SELECT page_id - 40 + 51 * r AS page_id, CASE WHEN page_id % 9 < 8 THEN concat('http://h.example/', page_id % 21, CASE WHEN r = 1 THEN '#x' ELSE '' END) END AS url, html FROM {t}, range(4) v(r) UNION ALL SELECT NULL, 'http://h.example/1', 'x'")
    name = "C3_filter_external_urls"
    for block in (W.GROUP_BLOCK, 2):
        monkeypatch.setattr(W, "GROUP_BLOCK", block)
        twin(spark, sf, name)
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_grouped_links_are_those_of_all_links(spark):
    """Bases and addresses in some of a few groups each, against the operator on all links."""
    draw = random.Random(3)
    some = lambda n, value: [(draw.choice([None, -2, *range(6)]), value(draw.randrange(n))) for _ in range(150)]
    bases = spark.createDataFrame(some(20, lambda i: f"http://b{i}.example/" if i else None), "k long, base_url string")
    urls = spark.createDataFrame(some(60, lambda i: [None, "mailto:a@b", "HTTP://U.example/7#x", "ftp://u.example/"][i] if i < 4 else f"http://u.example/{i // 2}{'#y' * (i % 2)}"), "k long, url string")
    for include, exclude in ((None, None), (["1", "2"], None), (["1", "2"], ["#y", "4$"])):
        got = W.filter_normalize_groups(bases, urls, "k", include, exclude).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, W.filter_normalize_urls(bases.join(urls, "k").drop("k"), include, exclude, external=True).collect()))
        assert len(got) > 100
    none = W.filter_normalize_groups(bases.limit(0), urls, "k")
    assert none.columns == ["base_url", "url"] and not none.collect()
