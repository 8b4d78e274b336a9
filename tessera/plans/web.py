"""Registered queries: the web corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import web as W
from tessera.plans.fixtures import Tables
from tessera.plans.registry import query
from tessera.session import AS_OF

TS = f"TIMESTAMP '{AS_OF}'"
TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"

query("C1_html_extract", f"SELECT page_id, {TITLE} AS title, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS language, length(html) AS n_html FROM pages WHERE {TITLE} <> '' AND NOT contains({TITLE}, '&') AND regexp_matches(html, '<html[^>]* lang=\"[^\"]+\"')")(
    lambda t: W.html_extract(t("pages"), whole=True).join(t("pages").where("trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '' AND regexp_extract(html, '<title>([^<]*)</title>', 1) NOT LIKE '%&%' AND html RLIKE '<html[^>]* lang=\"[^\"]+\"'").select("page_id"), "page_id", "left_semi").select("page_id", "title", "language", F.length("html").cast("long").alias("n_html"))
)
query("C1_html_text")(lambda t: W.html_extract(t("pages")).select("page_id", "content_hash", "content_length", "word_count", F.size("keywords").alias("n_keywords"), F.size("images").alias("n_images"), "published"))
query("C2_extract_links", "SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1))) AS n FROM pages")(
    lambda t: t("pages").select("page_id").join(W.extract_links(t("pages")).groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
)


def link_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The pages that made links come from (k, base_url) and the addresses that they go to (k, url), with fragments and other schemes among them."""
    p, k = t("pages"), F.col("page_id") % 50
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit("#part")).otherwise(F.lit("")))
    return p.select(k.alias("k"), F.col("url").alias("base_url")), p.select(k.alias("k"), F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("mailto:"), "url")).otherwise(url).alias("url"))


def links(t: Tables) -> DataFrame:
    """Made links: every page to the addresses of every fiftieth one. Hosts are found once a page, not once a link."""
    bases, to = link_sides(t)
    return bases.withColumn("base_host", C.url_host("base_url")).join(to.withColumn("host", C.url_host("url")), "k").drop("k")


LINKS = "SELECT a.url AS base_url, CASE WHEN b.page_id % 11 = 0 THEN concat('mailto:', b.url) ELSE concat(b.url, CASE WHEN b.page_id % 3 = 0 THEN '#part' ELSE '' END) END AS url FROM pages a JOIN pages b ON a.page_id % 50 = b.page_id % 50"
HOST = lambda c: f"lower(regexp_extract({c}, '^https?://([^/?#]+)', 1))"
query("C3_filter_normalize_urls", f"SELECT DISTINCT base_url, regexp_replace(url, '#.*$', '') AS url FROM ({LINKS}) WHERE regexp_matches(url, '^https?://') AND {HOST('url')} = {HOST('base_url')} AND NOT regexp_matches(url, '7')")(lambda t: W.filter_normalize_urls(links(t), exclude=["7"]))
query("C3_filter_external_urls", f"SELECT DISTINCT base_url, regexp_replace(url, '#.*$', '') AS url FROM ({LINKS}) WHERE regexp_matches(url, '^https?://') AND (regexp_matches(url, '1') OR regexp_matches(url, '2'))")(lambda t: W.filter_normalize_groups(*link_sides(t), "k", include=["1", "2"]))


def robots(t: Tables) -> DataFrame:
    """A robots file for each host: some close a path that begins with a letter, some close all."""
    h = t("pages").select(C.url_host("url").alias("host")).distinct()
    text = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 2\nDisallow: /"), F.when(F.length("host") % 3 == 0, F.lit("a")).when(F.length("host") % 3 == 1, F.lit("b")).otherwise(F.lit("p")), F.lit("\nSitemap: https://"), "host", F.lit("/map.xml\n"))
    return h.select("host", text.alias("content"))


PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
query("C4_robots_filter", f"SELECT page_id, url FROM pages WHERE NOT starts_with({PATH}, concat('/', CASE length({HOST('url')}) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'p' END))")(lambda t: W.robots_filter(t("pages").select("page_id", "url"), robots(t)))
query("C4_robots_rules", f"SELECT host, 'crawl_delay' AS kind, '2000' AS value FROM (SELECT DISTINCT {HOST('url')} AS host FROM pages) UNION ALL SELECT host, 'sitemap', concat('https://', host, '/map.xml') FROM (SELECT DISTINCT {HOST('url')} AS host FROM pages)")(lambda t: W.robots_rules(robots(t)).where("kind <> 'disallow'"))


def graph(t: Tables) -> DataFrame:
    """Made edges between pages: each to the page of three times and seven times its number, around."""
    n = t("pages").select(F.col("page_id").cast("string").alias("src"), "page_id").crossJoin(t("pages").agg((F.max("page_id") + 1).alias("n")))
    return n.select("src", F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), ((F.col("page_id") * m + i) % F.col("n")).cast("string").alias("dst")) for i, m in enumerate((3, 7))])))


EDGES = "SELECT cast(page_id AS varchar) AS src, 0 AS pos, cast((page_id * 3) % n AS varchar) AS dst FROM p UNION ALL SELECT cast(page_id AS varchar), 1, cast((page_id * 7 + 1) % n AS varchar) FROM p"
query("C5_crawl_frontier", f"WITH RECURSIVE p AS (SELECT page_id, (SELECT max(page_id) + 1 FROM pages) AS n FROM pages), e AS ({EDGES}), walk(url, depth) AS (SELECT cast(page_id AS varchar), 0 FROM pages WHERE page_id % 50 = 1 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url WHERE w.depth < 5) SELECT url, min(depth) AS depth FROM walk GROUP BY 1")(
    lambda t: W.crawl_frontier(graph(t), t("pages").where("page_id % 50 = 1").select(F.col("page_id").cast("string").alias("url")), 5, 1_000_000).select("url", "depth")
)
query("C6_sources_due", f"SELECT id, priority FROM kb_web_sources s WHERE status = 'active' AND (next_crawl IS NULL OR next_crawl <= {TS}) AND NOT EXISTS (SELECT 1 FROM kb_crawl_jobs j WHERE j.source_id = s.id AND j.status IN ('pending', 'running')) ORDER BY priority DESC, coalesce(last_crawled, TIMESTAMP '1970-01-01 00:00:00'), id LIMIT 20")(lambda t: W.sources_due(t("kb_web_sources"), t("kb_crawl_jobs"), AS_OF, 20).select("id", "priority"))


def versions(t: Tables) -> DataFrame:
    return t("kb_versions").withColumn("content_hash", C.content_hash("content_text"))


def incoming(t: Tables) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("page_id"), C.content_hash("text").alias("content_hash"), F.length("text").alias("content_length"))


HASH = "sha256(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
LATEST = f"SELECT page_id, max(version_number) AS v, arg_max(h, version_number) AS h, arg_max(content_length, version_number) AS n FROM (SELECT *, {HASH.format('content_text')} AS h FROM kb_versions) GROUP BY 1"
CHANGES = f"SELECT i.page_id, i.content_length, v IS NULL OR i.content_hash <> h AS changed, CASE WHEN v IS NULL THEN 100e0 WHEN h = i.content_hash THEN 0e0 ELSE abs(i.content_length - n) * 100e0 / greatest(n, 1) END AS pct, CASE WHEN v IS NULL THEN true WHEN h = i.content_hash THEN false ELSE abs(i.content_length - n) * 100e0 / greatest(n, 1) > 10 OR abs(i.content_length - n) > 1000 END AS significant_change, CASE WHEN v IS NULL THEN 1 WHEN h = i.content_hash THEN v ELSE v + 1 END AS version_number FROM (SELECT doc_id AS page_id, {HASH.format('text')} AS content_hash, length(text) AS content_length FROM documents) i LEFT JOIN ({LATEST}) l ON l.page_id = i.page_id"
query("C7_detect_changes", f"SELECT page_id, changed, round(pct, 6) AS change_percentage, significant_change, version_number FROM ({CHANGES})")(lambda t: W.detect_changes(incoming(t), versions(t)).select("page_id", "changed", F.round("change_percentage", 6).alias("change_percentage"), "significant_change", "version_number"))
query("C8_append_version", f"SELECT page_id, version_number, significant_change, content_length FROM ({CHANGES}) WHERE changed")(lambda t: W.append_version(W.detect_changes(incoming(t), versions(t))).select("page_id", "version_number", "significant_change", F.col("content_length").cast("long").alias("content_length")))


@query(
    "C9_page_to_document",
    "SELECT coalesce(k.d, -p.page_id - 1) AS document_id, k.d IS NOT NULL AS updates, concat('web-crawled,', 'k', cast(p.page_id % 4 AS varchar)) AS tags, length(p.html) > 50 AS to_embed FROM pages p LEFT JOIN (SELECT id // 5 AS k, min(id) AS d FROM kb_documents WHERE id % 3 = 0 GROUP BY 1) k ON k.k = p.page_id WHERE p.page_id % 2 = 0",
)
def to_documents(t: Tables) -> DataFrame:
    docs = t("kb_documents").withColumn("metadata", F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.floor(F.col("id") / 5).alias("page_id")))))
    changes = t("pages").select(F.col("page_id").alias("id"), "url", F.lit("t").alias("title"), F.col("html").alias("content"), F.array(F.concat(F.lit("k"), (F.col("page_id") % 4).cast("string"))).alias("keywords"), (F.col("page_id") % 2 == 0).alias("significant_change"))
    return W.page_to_document(changes, docs).select("document_id", "updates", F.array_join("tags", ",").alias("tags"), "to_embed")


query("C11_start_guard", "SELECT q.id, CASE WHEN s.status IS NULL THEN 'not_found' WHEN s.status <> 'active' THEN 'not_active' WHEN EXISTS (SELECT 1 FROM kb_crawl_jobs j WHERE j.source_id = q.id AND j.status IN ('pending', 'running')) THEN 'already_running' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT doc_id AS id FROM documents) q LEFT JOIN kb_web_sources s ON s.id = q.id")(
    lambda t: W.start_guard(t("documents").select(F.col("doc_id").alias("id")), t("kb_web_sources"), t("kb_crawl_jobs"))
)
query("C12_reschedule", f"SELECT s.id, CASE WHEN r.ok IS NOT NULL THEN {TS} ELSE s.last_crawled END AS last_crawled, CASE WHEN r.ok THEN {TS} + INTERVAL '24' HOUR ELSE s.next_crawl END AS next_crawl, CASE WHEN r.ok THEN 0 WHEN r.ok IS NOT NULL THEN 1 END AS error_count FROM kb_web_sources s LEFT JOIN (SELECT source_id, bool_and(status <> 'failed') AS ok FROM kb_crawl_jobs WHERE source_id % 2 = 0 GROUP BY 1) r ON r.source_id = s.id")(
    lambda t: W.reschedule(t("kb_web_sources"), t("kb_crawl_jobs").where("source_id % 2 = 0").groupBy("source_id").agg(F.bool_and(F.col("status") != "failed").alias("ok"), F.sum("pages_crawled").alias("pages_crawled")), AS_OF).select("id", "last_crawled", "next_crawl", "error_count")
)
query("C13_link_type", f"SELECT base_url, url, CASE WHEN {HOST('url')} = {HOST('base_url')} THEN 'internal' WHEN ends_with({HOST('url')}, '.' || {HOST('base_url')}) THEN 'subdomain' ELSE 'external' END AS link_type FROM ({LINKS})")(lambda t: W.link_type(links(t)).select("base_url", "url", "link_type"))
query("C14_page_gate", "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND length(html) <= 1048576")(
    lambda t: W.page_gate(t("pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.length("html").alias("size_bytes")), 1).select("page_id")
)
query("C15_url_validate", f"SELECT page_id, page_id % 7 <> 0 AS valid, CASE WHEN page_id % 7 <> 0 THEN {HOST('url')} END AS domain FROM pages")(lambda t: W.url_validate(t("pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.col("url")).alias("url"))).select("page_id", "valid", "domain"))
