"""Full-text search over a postings table (id, term, pos)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import page_source_filter
from tessera.operators.predicates import filter_tags_overlap, filter_type
from tessera.sources.scratch import stored

# Words that are not indexed; positions count them all the same.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
TERM = r"[\p{L}\p{N}]+"


def terms_of(text: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", text.lower())) if w not in STOP]


def tokenize_index(df: DataFrame, id: str, col: str) -> DataFrame:
    """Postings of a text column: words of letters and digits, lower case, with their positions from 0. English stems are in textindex."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TERM), F.lit(0))
    return df.select(F.col(id).alias("id"), F.posexplode(words).alias("pos", "term")).where(~F.col("term").isin(*STOP))


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id no other row has, and all others: what is asked of an id needs a shuffle for the others only."""
    shared = stored(rows.groupBy(F.col("id").alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1").select("_shared"), "shared-ids")
    same = F.col("id").eqNullSafe(F.col("_shared"))
    return rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")


def index_sizes(df: DataFrame, id: str, col: str) -> DataFrame:
    """id, n (postings), last_pos and terms (different ones) of what tokenize_index gives, counted where a row is read; postings are shuffled only for rows that share an id."""
    once, again = apart(df.withColumnRenamed(id, "id"))
    words = once.select("id", F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TERM), F.lit(0)).alias("words"))
    kept = words.select("id", F.filter("words", lambda w: ~w.isin(*STOP)).alias("kept"), F.array_max(F.transform("words", lambda w, i: F.when(~w.isin(*STOP), i))).cast("long").alias("last_pos"))
    sizes = kept.where(F.size("kept") > 0).select("id", F.size("kept").cast("long").alias("n"), "last_pos", F.size(F.array_distinct("kept")).cast("long").alias("terms"))
    found = tokenize_index(again, "id", col).groupBy("id").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last_pos"), F.countDistinct("term").alias("terms"))
    return sizes.unionByName(found)


def _frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, tf) of the terms that any query has: each row's postings of a term become one before queries are joined."""
    return index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """The distinct terms of each query, numbered from 0."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: ~w.isin(*STOP))
    return queries.select("query_id", F.posexplode(F.array_distinct(words)).alias("term_no", "term"))


def match_all_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id) of the rows that have every term of the query, however many these are.

    Only the rows that have a query's rarest term are looked at for its others.
    """
    held = stored(_frequencies(index, terms), "frequencies")
    rows = held.groupBy("term").agg(F.count("*").alias("rows"))
    rare = terms.join(rows, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "term")).alias("rare"), F.count("*").alias("n"))
    maybe = held.join(rare.select("query_id", "n", F.col("rare.term").alias("term")), "term").select("query_id", "id", "n")
    have = maybe.join(terms, "query_id").join(held, ["id", "term"]).groupBy("query_id", "id", "n").agg(F.count("*").alias("have"))
    return have.where("have = n").select("query_id", "id")


def text_rank(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, text_rank): each term adds 1 + ln(its frequency) in tenths, over the number of terms."""
    tf = _frequencies(index, terms).join(terms, "term")
    need = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    summed = tf.groupBy("query_id", "id").agg(F.sum(0.1 * (1 + F.log("tf"))).alias("s"))
    return summed.join(need, "query_id").select("query_id", "id", (F.col("s") / F.col("n")).alias("text_rank"))


def text_rank_cd(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, text_rank) by cover density: each minimal span that holds all terms adds 0.1 / (1 + words in it that are none).

    Only rows with all terms have a span. Their postings are folded in order: the last place of every term bounds the span that ends
    at a place; it is minimal if it starts later than the one before. Any number of terms is looked at.
    """
    need = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    whole = stored(match_all_terms(index, terms).join(need, "query_id").join(terms, "query_id"), "matches")
    rows = index.join(whole, ["id", "term"])
    places = rows.groupBy("query_id", "id", "n").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "term_no"))).alias("places"))
    begin = F.struct(F.array_repeat(F.lit(-1).cast("long"), F.col("n").cast("int")).alias("last"), F.lit(-1).cast("long").alias("before"), F.lit(0.0).alias("rank"))

    def place(s: Column, p: Column) -> Column:
        last = F.transform(s["last"], lambda x, i: F.when(i == p["term_no"], p["pos"]).otherwise(x))
        start = F.array_min(last)
        minimal = (start >= 0) & (start > s["before"])
        more = F.when(minimal, 0.1 / (1 + p["pos"] - start + 1 - F.col("n"))).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(start, s["before"]).alias("before"), (s["rank"] + more).alias("rank"))

    return places.select("query_id", "id", F.aggregate("places", begin, place)["rank"].alias("text_rank"))


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, words in sequence): quotes make a sequence, `or` an alternative, a leading - an exclusion."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not quoted and not minus and word.lower() == "or":
            out.append([])
            continue
        words = re.findall(r"[^\W_]+", (quoted or word.lstrip("-")).lower())
        negative = bool(minus) or word.startswith("-")
        words = words if quoted else [w for w in words if w not in STOP]
        if words and not all(w in STOP for w in words):
            out[-1].append((not negative, words))
    return [a for a in out if a]


def match_websearch(docs: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """ids of the rows that the query matches; sequences are words at neighbouring positions."""
    parsed = parse_websearch(query)
    needed = sorted({w for a in parsed for _, words in a for w in words if w not in STOP})
    if not needed:
        return docs.select("id").limit(0)
    places = index.where(F.col("term").isin(needed)).groupBy("id").agg(*[F.collect_list(F.when(F.col("term") == w, F.col("pos"))).alias(f"t{i}") for i, w in enumerate(needed)])
    rows = docs.select("id").join(places, "id", "left")

    def back(i: int, k: int) -> Column:
        return F.transform(F.coalesce(f"t{i}", F.array().cast("array<int>")), lambda p: p - k)

    def holds(words: list[str]) -> Column:
        known = [(k, needed.index(w)) for k, w in enumerate(words) if w not in STOP]
        shifted = [back(i, k) for k, i in known]
        both = shifted[0]
        for s in shifted[1:]:
            both = F.array_intersect(both, s)
        return F.size(both) > 0

    matches = F.lit(False)
    for alternative in parsed:
        clause = F.lit(True)
        for wanted, words in alternative:
            clause = clause & (holds(words) if wanted else ~holds(words))
        matches = matches | clause
    return rows.where(matches).select("id")


def keyword_search(docs: DataFrame, index: DataFrame, query: str, type=None, tags=None, k: int = 10) -> DataFrame:
    """Documents that the web query matches, by how often its words occur; their similarity is 0.8."""
    kept = filter_tags_overlap(filter_type(docs, type), tags)
    hits = match_websearch(kept, index, query)
    rank = index.where(F.col("term").isin(terms_of(query))).groupBy("id").agg(F.count("*").alias("n_found"))
    return kept.join(hits, "id", "left_semi").join(rank, "id", "left").withColumn("similarity", F.lit(0.8)).orderBy(F.desc(F.coalesce("n_found", F.lit(0))), "id").limit(k)


def web_content_search(pages: DataFrame, sources: DataFrame, index: DataFrame, terms: DataFrame, domain: str | None = None, k: int = 20) -> DataFrame:
    """Completed pages with text that have all terms, with a snippet of 300 characters, by rank, of equals the smaller ids. Ranks are equal to nine places: the last bits of a sum depend on its order."""
    ready = page_source_filter(pages.where((F.col("processing_status") == "completed") & (F.coalesce("content_text", F.lit("")) != "")), sources, domain)
    ranked = text_rank(index, terms).join(match_all_terms(index, terms), ["query_id", "id"], "left_semi")
    hits = ranked.join(ready.select("id", "url", "domain", F.substring("content_text", 1, 300).alias("snippet")), "id")
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("text_rank", 9)), "id")
    return hits.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k)
