"""The web corpus: pages to text and links, URL rules, the crawl frontier, versions and schedules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.joins import existing_doc_lookup, no_active_job
from tessera.operators.windows import latest_version
from tessera.sources.scratch import shared_root

SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Bases of a group that meet its addresses together; links that a task makes, where a session's partitions don't say more.
GROUP_BLOCK, GROUP_LINKS = 1024, 2**22


class Page(HTMLParser):
    """What one page says of itself, its texts and its links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.lang, self.times = "", []
        self.links: list[str] = []
        self.images: list[tuple[str, str]] = []
        self.title, self.first_header = "", ""
        self.body: list[str] = []
        self.main: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("name") or a.get("property") or a.get("http-equiv")
            if name:
                self.meta.setdefault(name.lower(), a.get("content", ""))
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img" and a.get("src"):
            self.images.append((a["src"], a.get("alt", "")))
        if a.get("datetime"):
            self.times.append(a["datetime"])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        inside = set(self.open)
        if "title" in inside:
            self.title += data
        elif not inside & SKIPPED:
            if "h1" in inside and not self.first_header:
                self.first_header = data.strip()
            if "head" not in inside:
                self.body.append(data)
                if inside & MAIN:
                    self.main.append(data)


def _date(*texts: str) -> datetime | None:
    for t in texts:
        try:
            return datetime.fromisoformat(t.strip().replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            continue
    return None


def _absolute(base: str, url: str) -> str | None:
    try:
        out = urljoin(base, url)
        return out if urlsplit(out).scheme else None
    except ValueError:
        return None


def read_page(url: str, html: str, whole: bool = False) -> dict:
    page = Page()
    page.feed(html or "")
    page.close()
    text = re.sub(r"\s+", " ", " ".join(page.main or page.body)).strip()
    m = page.meta.get
    links = [u for u in (_absolute(url, h) for h in page.links) if u]
    images = [{"src": u, "alt": alt} for src, alt in page.images if (u := _absolute(url, src))]
    return {
        "title": (page.title.strip() or page.first_header or "Untitled")[: None if whole else 500],
        "description": (m("description") or m("og:description") or "")[:1000],
        "author": m("author") or m("article:author"),
        "keywords": [k.strip() for k in m("keywords", "").split(",") if k.strip()][:20],
        "language": page.lang or m("content-language") or "en",
        "published": _date(m("article:published_time", ""), m("date", ""), *page.times),
        "content": text,
        "html": (html or "")[: None if whole else 100_000],
        "links": list(dict.fromkeys(links)),
        "images": images[:20],
    }


PAGE_SCHEMA = "page_id long, url string, title string, description string, author string, keywords array<string>, language string, published timestamp_ntz, content string, html string, links array<string>, images array<struct<src: string, alt: string>>"


def html_extract(pages: DataFrame, whole: bool = False) -> DataFrame:
    """Metadata, main text, links and images of every page (page_id, url, html), with hash, length and number of words of the text.

    The main text is what article or main elements hold, else the body without scripts, styles and navigation. Titles end at 500 characters and the stored HTML at 100,000, but not if whole.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("description", pa.string()), ("author", pa.string()), ("keywords", pa.list_(pa.string())), ("language", pa.string()), ("published", pa.timestamp("us")), ("content", pa.string()), ("html", pa.string()), ("links", pa.list_(pa.string())), ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())])))]
    schema = pa.schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "url": r["url"]} | read_page(r["url"] or "", r["html"], whole) for r in part], schema=schema)

    out = pages.select("page_id", "url", "html").mapInArrow(run, PAGE_SCHEMA)
    return out.withColumn("content_hash", F.sha2("content", 256)).withColumn("content_length", F.length("content")).withColumn("word_count", C.word_count("content"))


def extract_links(pages: DataFrame, max_links: int = 100) -> DataFrame:
    """Edges (page_id, pos, url) of every page, the first max_links distinct ones."""
    return html_extract(pages).select("page_id", F.posexplode(F.slice("links", 1, max_links)).alias("pos", "url"))


def _host(links: DataFrame, url: str, host: str) -> Column:
    return F.col(host) if host in links.columns else C.url_host(url)


def _kept(links: DataFrame, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """Rows of http(s) addresses (url) that fit the patterns, without fragment."""
    url = F.col("url")
    kept = links.where(url.rlike(r"^(?i)https?://[^/?#]+"))
    kept = kept.where(url.rlike("|".join(f"(?:{p})" for p in include))) if include else kept
    kept = kept.where(~url.rlike("|".join(f"(?:{p})" for p in exclude))) if exclude else kept
    return kept.withColumn("url", F.regexp_replace("url", "#.*$", ""))


def filter_normalize_urls(links: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, external: bool = False) -> DataFrame:
    """links (base_url, url): http(s) ones, of the base's host unless external, by patterns on the whole URL; without fragment, each once."""
    kept = links if external else links.where(_host(links, "url", "host") == _host(links, "base_url", "base_host"))
    return _kept(kept, include, exclude).select("base_url", "url").distinct()


def _once(rows: DataFrame, on: str, value: str, before: str) -> DataFrame:
    """Each value once for each of its groups, with its smaller groups, null for none."""
    sets = rows.where(F.col(on).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(on)).alias("groups"))
    each = sets.select(value, "groups", F.posexplode("groups").alias("i", on))
    return each.select(on, value, F.when(F.col("i") > 0, F.slice("groups", 1, F.col("i"))).alias(before))


def filter_normalize_groups(bases: DataFrame, urls: DataFrame, on: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """filter_normalize_urls, external, of the links from every base of a group (on, base_url) to every address of that group (on, url). Values have few groups.

    Addresses are filtered and cut before they meet bases. A link that several groups hold comes from the first of them, so no link is shuffled.
    A group's bases are dealt to blocks of about GROUP_BLOCK, each of which meets all addresses of the group.
    """
    a, b = _once(bases, on, "base_url", "base_before"), _once(_kept(urls, include, exclude), on, "url", "before")
    sizes = a.groupBy(on).agg(F.count("*").alias("n")).join(b.groupBy(on).agg(F.count("*").alias("m")), on)
    groups, most, pairs = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()
    blocks = -(-most // GROUP_BLOCK)
    tasks = max(1, min(groups * blocks, max(pairs // GROUP_LINKS, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    a = a.withColumn("block", F.pmod(F.xxhash64("base_url"), F.lit(blocks)).cast("int")).repartition(tasks, on, "block")
    b = b.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, on, "block")
    first = F.col("base_before").isNull() | F.col("before").isNull() | ~F.arrays_overlap("base_before", "before")
    return a.join(b.hint("merge"), [on, "block"]).where(first).select("base_url", "url")


def robots_rules(robots: DataFrame, agent: str = "corpus-crawler", legacy: bool = False) -> DataFrame:
    """robots (host, content) as rules (host, kind, value): disallow prefixes, crawl_delay in milliseconds and sitemaps that hold for any agent or our own.

    legacy: paths are lower-cased and a sitemap only counts outside a group that holds, up to its first colon.
    """
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> '' AND line NOT LIKE '#%'")
    key, value = F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    lines = lines.withColumn("key", key).withColumn("value", F.lower(value) if legacy else value)
    by = Window.partitionBy("host").orderBy("pos")
    last = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(by)
    ours = F.coalesce(last.isin("*", agent), F.lit(False))
    lines = lines.withColumn("ours", ours)
    rule = F.when((F.col("key") == "disallow") & F.col("ours") & (F.col("value") != ""), "disallow").when((F.col("key") == "crawl-delay") & F.col("ours") & F.col("value").rlike(r"^\d+"), "crawl_delay").when((F.col("key") == "sitemap") & (~F.col("ours") if legacy else F.lit(True)), "sitemap")
    shown = F.when(F.col("kind") == "crawl_delay", (F.regexp_extract("value", r"^(\d+)", 1).cast("long") * 1000).cast("string")).when((F.col("kind") == "sitemap") & F.lit(legacy), F.regexp_extract("value", "^([^:]*)", 1)).otherwise(F.col("value"))
    out = lines.withColumn("kind", rule).where("kind IS NOT NULL").select("host", "kind", shown.alias("value"))
    return out.where("NOT (kind = 'disallow' AND value = '/')") if legacy else out


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str = "corpus-crawler", legacy: bool = False) -> DataFrame:
    """URLs whose path no disallowed prefix of their host starts."""
    rules = robots_rules(robots, agent, legacy).where("kind = 'disallow'").select("host", F.col("value").alias("prefix"))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    rows = urls.withColumn("host", C.url_host("url")).withColumn("path", F.when(path == "", "/").otherwise(path))
    return rows.join(rules, (rows["host"] == rules["host"]) & rows["path"].startswith(rules["prefix"]), "left_anti").drop("host", "path")


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 100) -> DataFrame:
    """Pages in breadth-first order from seeds (url): url, depth, parent, place. edges: src, pos, dst.

    Each level joins the frontier with the edges, keeps new pages with their first parent (by the parent's place, then
    the link's position) and is cut from its lineage by a checkpoint; levels end at max_depth or when max_pages are known.
    """
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    start = Window.orderBy("url")
    # max_pages seeds at most are left before they are numbered
    level = seeds.select("url").distinct().orderBy("url").limit(max_pages).withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string")).withColumn("place", F.row_number().over(start).cast("long")).checkpoint()
    seen, known = level, level.count()
    for depth in range(1, max_depth + 1):
        if known >= max_pages:
            break
        found = level.select(F.col("url").alias("src"), F.col("place").alias("at")).join(edges, "src").select(F.col("dst").alias("url"), F.col("src").alias("parent"), "at", "pos")
        first = found.groupBy("url").agg(F.min(F.struct("at", "pos", "parent")).alias("f")).join(seen.select("url"), "url", "left_anti")
        order = Window.orderBy("f.at", "f.pos", "url")
        # a level keeps max_pages rows at most before it is numbered
        few = first.orderBy("f.at", "f.pos", "url").limit(max_pages - known)
        level = few.select("url", F.lit(depth).alias("depth"), F.col("f.parent").alias("parent"), (F.row_number().over(order) + known).cast("long").alias("place")).checkpoint()
        n = level.count()
        if not n:
            break
        seen, known = seen.unionByName(level), known + n
    return seen


def sources_due(sources: DataFrame, jobs: DataFrame, as_of: str, k: int = 10) -> DataFrame:
    due = sources.where((F.col("status") == "active") & (F.col("next_crawl").isNull() | (F.col("next_crawl") <= F.expr(f"TIMESTAMP_NTZ '{as_of}'"))))
    return no_active_job(due, jobs).orderBy(F.desc("priority"), F.coalesce("last_crawled", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "id").limit(k)


def detect_changes(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """incoming (page_id, content_hash, content_length) against the latest versions: changed, change_percentage, significant_change, version_number."""
    last = latest_version(versions.select("page_id", "version_number", "content_hash", "content_length")).select("page_id", F.col("version_number").alias("v"), F.col("content_hash").alias("h"), F.col("content_length").alias("n"))
    rows = incoming.join(last, "page_id", "left")
    new, same, delta = F.col("v").isNull(), F.coalesce(F.col("h") == F.col("content_hash"), F.lit(False)), F.abs(F.col("content_length") - F.col("n"))
    pct = F.when(new, 100.0).when(same, 0.0).when(delta.isNull(), 100.0).otherwise(delta * 100.0 / F.greatest("n", F.lit(1)))
    return rows.select(
        *incoming.columns,
        (new | ~same).alias("changed"),
        pct.alias("change_percentage"),
        F.when(new, True).when(same, False).otherwise((pct > 10) | F.coalesce(delta > 1000, F.lit(False))).alias("significant_change"),
        F.when(new, 1).when(same, F.col("v")).otherwise(F.col("v") + 1).cast("long").alias("version_number"),
    )


def append_version(changes: DataFrame) -> DataFrame:
    """The version rows that changes add."""
    return changes.where("changed").select("page_id", "version_number", "content_hash", "change_percentage", "significant_change", "content_length")


def page_to_document(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that significant changes make or update: changes has id, url, title, content, keywords and significant_change; docs id and metadata."""
    rows = existing_doc_lookup(changes.where("significant_change"), docs)
    return rows.select(
        F.coalesce("existing_id", -F.col("id") - 1).alias("document_id"),
        F.col("existing_id").isNotNull().alias("updates"),
        "title",
        F.lit("knowledge").alias("type"),
        F.concat(F.array(F.lit("web-crawled")), F.slice("keywords", 1, 5)).alias("tags"),
        F.col("content").alias("content_text"),
        F.to_json(F.struct(F.col("id").alias("page_id"), F.col("url").alias("source_url"))).alias("metadata"),
        (F.length("content") > 50).alias("to_embed"),
    )


def start_guard(requests: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Of each requested source (id): not_found, not_active, already_running or ok."""
    active = jobs.where(F.col("status").isin("pending", "running")).select(F.col("source_id").alias("id"), F.lit(True).alias("busy")).distinct()
    rows = requests.select("id").distinct().join(sources.select("id", "status"), "id", "left").join(active, "id", "left")
    verdict = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "active", "not_active").when(F.col("busy"), "already_running").otherwise("ok")
    return rows.select("id", verdict.alias("verdict"))


def reschedule(sources: DataFrame, job_results: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """sources after crawls (source_id, ok, pages_crawled): next in `hours`, errors cleared or counted."""
    now = F.expr(f"TIMESTAMP_NTZ '{as_of}'")
    rows = sources.join(job_results.select(F.col("source_id").alias("id"), "ok", "pages_crawled"), "id", "left")
    ran = F.col("ok").isNotNull()
    return (
        rows.withColumn("last_crawled", F.when(ran, now).otherwise(F.col("last_crawled")))
        .withColumn("next_crawl", F.when(ran & F.col("ok"), now + F.expr(f"INTERVAL '{hours}' HOUR")).otherwise(F.col("next_crawl")))
        .withColumn("error_count", F.when(F.col("ok"), F.lit(0)).when(ran, F.lit(1)).otherwise(F.lit(None).cast("int")))
        .drop("ok")
    )


def link_type(edges: DataFrame) -> DataFrame:
    """edges (base_url, url): internal, subdomain (of the base's host) or external. Hosts that are columns already (base_host, host) are taken from there."""
    a, b = _host(edges, "base_url", "base_host"), _host(edges, "url", "host")
    return edges.withColumn("link_type", F.when(a == b, "internal").when(b.endswith(F.concat(F.lit("."), a)), "subdomain").otherwise("external"))


def page_gate(pages: DataFrame, max_mb: int = 50) -> DataFrame:
    """Pages of an HTML content type and at most max_mb."""
    html = F.lower("content_type").rlike("^(text/html|application/xhtml\\+xml)")
    return pages.where(html & (F.col("size_bytes") <= max_mb * 1024 * 1024))


def url_validate(df: DataFrame, col: str = "url") -> DataFrame:
    valid: Column = F.col(col).rlike(r"^(?i)https?://[^/?#\s]+\S*$")
    return df.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("domain", F.when(F.col("valid"), C.url_host(col)))
