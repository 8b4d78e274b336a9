"""Sections, chunks, word clouds and descriptions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import columns as C

HEADER = re.compile(r"^#{1,6}\s+(.+)$", re.M)
SECTION_CHARS = 4_000
#: A word counts as so many tokens.
TOKENS_A_WORD = 1.3


def packed(paragraphs: list[str], limit: int = SECTION_CHARS) -> list[str]:
    """Paragraphs put together while they and the next one stay under the limit."""
    out, held = [], ""
    for p in paragraphs:
        if len(held) + len(p) < limit:
            held = f"{held}\n\n{p}" if held else p
            continue
        if held:
            out.append(held)
        held = p
    return out + [held] * bool(held)


def sections(text: str, legacy_titles: bool = False) -> list[tuple[str, str]]:
    """(title, body) by markdown headers, or packed paragraphs without titles. legacy_titles: a body has the title of the header after it."""
    parts = HEADER.split(text)
    if len(parts) == 1:
        return [("", p) for p in packed(re.split(r"\n\n+", text))]
    bodies, titles = parts[::2], parts[1::2]
    titles = [*titles, ""] if legacy_titles else ["", *titles]
    return [(t, b) for t, b in zip(titles, bodies, strict=True) if b.strip()]


def _words_for(tokens: float) -> int:
    """Words whose repeated token cost first reaches so many tokens."""
    n, cost = 0, 0.0
    while cost < tokens:
        cost += TOKENS_A_WORD
        n += 1
    return n


def chunks(body: str, target: int = 500, most: int = 1_000, overlap: int = 100, least: int = 100) -> Iterator[tuple[str, int]]:
    """(chunk, token count): at least `target` tokens, on to the first word that ends a sentence within `most`; the next chunk starts `overlap` tokens back."""
    words = re.split(r"\s+", body)
    wanted, limit, back = _words_for(target), _words_for(most), int(overlap / TOKENS_A_WORD)
    at = 0
    while at < len(words):
        end = min(at + wanted, len(words))
        stop = min(at + limit, len(words))
        while end < stop:
            end += 1
            if words[end - 1][-1:] in (".", "!", "?"):
                break
        text = " ".join(words[at:end])
        if len(text) >= least:
            yield text, int((end - at) * TOKENS_A_WORD + 1e-9)
        if end >= len(words):
            return
        at = max(end - back, at + 1)


#: Rows whose texts are Python strings at once.
PIECE_ROWS = 64


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that Python holds the texts and results of these only."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def split_sections(df: DataFrame, legacy_titles: bool = False) -> DataFrame:
    """id, section, title and body of every section of df (id, content_text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = [(i, n, t, b) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for n, (t, b) in enumerate(sections(text, legacy_titles))]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "section", "title", "body"), r, strict=True)) for r in rows], schema=pa.schema([("id", pa.int64()), ("section", pa.int64()), ("title", pa.string()), ("body", pa.string())]))

    return df.select(F.col("id").cast("long"), "content_text").mapInArrow(run, "id long, section long, title string, body string")


def pack_paragraphs(df: DataFrame, limit: int = SECTION_CHARS) -> DataFrame:
    """id, section and body of packed paragraphs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = [{"id": i, "section": n, "body": b} for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for n, b in enumerate(packed(re.split(r"\n\n+", text), limit))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("section", pa.int64()), ("body", pa.string())]))

    return df.select(F.col("id").cast("long"), "content_text").mapInArrow(run, "id long, section long, body string")


CHUNK_SCHEMA = "document_id long, chunk_index long, section_title string, chunk_text string, token_count long"


def chunk_documents(docs: DataFrame, target: int = 500, most: int = 1_000, overlap: int = 100, least: int = 100, legacy_titles: bool = False) -> DataFrame:
    """Chunks of every document (id, content_text): document_id, chunk_index (dense, over all sections), section_title, chunk_text, token_count, chunk_type.

    One pass over the partitions; a document's chunks need its words in order, so they are cut where it is read.
    """
    schema = pa.schema([("document_id", pa.int64()), ("chunk_index", pa.int64()), ("section_title", pa.string()), ("chunk_text", pa.string()), ("token_count", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = 0
                    for title, body in sections(text, legacy_titles) if text else ():
                        for chunk, tokens in chunks(body, target, most, overlap, least):
                            rows.append({"document_id": i, "chunk_index": n, "section_title": title, "chunk_text": chunk, "token_count": tokens})
                            n += 1
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("id").cast("long"), "content_text").mapInArrow(run, CHUNK_SCHEMA).withColumn("chunk_type", C.chunk_type("chunk_text"))


def chunk_section(df: DataFrame, **sizes) -> DataFrame:
    """Chunks of sections (id, body), each section's for itself."""
    return chunk_documents(df.select("id", F.regexp_replace("body", r"\n\s*\n", "\n").alias("content_text")), **sizes)


# Words that a cloud leaves out.
CLOUD_STOP = """
the and or but in on at to for of with by
from up about into through during before after above
below between among around is are was were be been
being have has had do does did will would could
should may might must shall can a an this that
these those i you he she it we they me him
her us them my your his its our their if so
what when where who why how all any both each
few more most other some such no nor not only
own same than too very just now also one two
first second new old good bad big small long short
""".split()
# Compound terms that a cloud looks for.
COMPOUNDS = (
    "unified namespace", "data model", "data structure", "data flow", "data source",
    "api gateway", "cloud computing", "edge computing", "machine learning", "artificial intelligence",
    "user interface", "user experience", "real time", "real-time", "proof of concept",
    "service oriented", "event driven", "message queue", "load balancer", "database schema",
    "project management", "software development", "system architecture", "network topology",
    "security model", "authentication system", "authorization framework",
)


def word_cloud(docs: DataFrame, k: int = 25, compounds: tuple[str, ...] = COMPOUNDS) -> DataFrame:
    """The k most frequent terms (word, count, category) of titles, contents and transcripts.

    Words have more than three letters; compound terms count twice, and once for each spelling that is listed. A word stands before an
    equal compound. The category is the type of the least document id that has the term; ties of count go by word.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit("")), F.coalesce("transcription", F.lit(""))))
    rows = docs.select("id", "type", text.alias("text"))
    cleaned = F.split(F.regexp_replace("text", r"[^a-zA-Z\s]", " "), r"\s+")
    first = F.min("id").alias("first")
    words = rows.select("id", "type", F.explode(cleaned).alias("word")).where((F.length("word") > 3) & ~F.col("word").isin(*CLOUD_STOP)).groupBy("word").agg(F.count("*").alias("count"), first, F.lit(0).alias("phrase"))

    def counted(term: str) -> Column:
        """How often a term occurs; the pattern only runs over texts that hold its longest word, which is found much faster."""
        rare = max(re.split(r"[-\s]", term), key=len)
        return F.when(F.col("text").contains(rare), F.regexp_count("text", F.lit(re.sub(r"[-\s]", r"[-\\s]+", term)))).otherwise(0)

    found = F.array(*[F.struct(F.lit(t.replace("-", " ")).alias("word"), counted(t).alias("n")) for t in compounds])
    phrases = rows.select("id", "type", F.inline(found)).where("n > 0").groupBy("word").agg((F.sum("n") * 2).alias("count"), first, F.lit(1).alias("phrase"))
    every = words.unionByName(phrases)
    of = lambda kind, c: F.when(F.col("phrase") == kind, F.col(c))
    sums = every.groupBy("word").agg(*[F.min(of(kind, c)).alias(f"{c}{kind}") for kind in (0, 1) for c in ("count", "first")])
    once = sums.select("word", F.coalesce("count0", "count1").alias("count"), F.when(F.col("count0").isNotNull(), F.col("first0")).otherwise(F.col("first1")).alias("first"))
    top = once.orderBy(F.desc("count"), "word").limit(k).select("word", "count", F.col("first").alias("id"))
    # only the k terms that stay look up their category
    types = docs.join(top.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("type").alias("type"))
    return top.join(types, "id", "left").select("word", "count", F.coalesce("type", F.lit("unknown")).alias("category")).orderBy(F.desc("count"), "word")


_STRINGS = T.ArrayType(T.StringType())
ANALYSIS = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("technicalContent", T.StructType([T.StructField(n, k) for n, k in (("containsCode", T.BooleanType()), ("codeLanguage", T.StringType()), ("extractedCode", T.StringType()), ("codeDescription", T.StringType()), ("containsDiagrams", T.BooleanType()), ("diagramType", T.StringType()), ("diagramDescription", T.StringType()), ("containsUI", T.BooleanType()), ("uiElements", _STRINGS), ("technicalTerms", _STRINGS), ("concepts", _STRINGS))])),
        T.StructField("textContent", T.StructType([T.StructField("extractedText", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("language", T.StringType()), T.StructField("wordCount", T.LongType())])),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def parse_analysis_json(df: DataFrame, col: str) -> DataFrame:
    """df with an `analysis` record read from the braces in a free text; where there is none, flags by key words and confidence 0.3."""
    blob = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    read = F.when(blob != "", F.from_json(blob, ANALYSIS))
    ok = read.isNotNull() & F.expr(f"try_parse_json(regexp_extract({col}, '(?s)\\\\{{.*\\\\}}', 0)) IS NOT NULL")
    tech, text = read["technicalContent"], read["textContent"]
    empty = F.array().cast("array<string>")
    rule = lambda words: F.col(col).rlike(f"(?i)(?:{words})")
    no = F.lit(False)

    def pick(a: Column, b: Column) -> Column:
        return F.when(ok, a).otherwise(b)

    nothing = F.lit(None).cast("string")
    # fixed values: the key words of the fallback rules
    record = F.struct(
        pick(F.coalesce(read["description"], F.lit("")), F.substring(col, 1, 500)).alias("description"),
        pick(F.coalesce(tech["containsCode"], no), rule("function|class|def|SELECT|FROM|WHERE|import|const|let|var")).alias("contains_code"),
        pick(tech["codeLanguage"], nothing).alias("code_language"),
        pick(tech["codeDescription"], nothing).alias("code_description"),
        pick(F.coalesce(tech["containsDiagrams"], no), rule("diagram|flowchart|schema|architecture|flow")).alias("contains_diagrams"),
        pick(tech["diagramType"], nothing).alias("diagram_type"),
        pick(tech["diagramDescription"], nothing).alias("diagram_description"),
        pick(F.coalesce(tech["containsUI"], no), rule("button|input|form|menu|dialog|interface")).alias("contains_ui"),
        pick(F.coalesce(tech["uiElements"], empty), empty).alias("ui_elements"),
        pick(F.coalesce(tech["technicalTerms"], empty), empty).alias("technical_terms"),
        pick(F.coalesce(tech["concepts"], empty), empty).alias("concepts"),
        pick(F.coalesce(text["extractedText"], F.lit("")), F.col(col)).alias("extracted_text"),
        pick(F.coalesce(text["confidence"], F.lit(0.0)), F.lit(0.3)).alias("text_confidence"),
        pick(F.coalesce(text["language"], F.lit("en")), F.lit("en")).alias("language"),
        pick(F.coalesce(text["wordCount"], F.lit(0)), C.word_count(F.col(col)).cast("long")).alias("word_count"),
        pick(F.coalesce(read["confidence"], F.lit(0.5)), F.lit(0.3)).alias("confidence"),
    )
    return df.withColumn("analysis", record)


def describe_visual(analysis: str = "analysis") -> Column:
    """One text of what an analysis record says, without its empty parts."""
    a = lambda name: F.col(f"{analysis}.{name}")
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        " ",
        some(a("description")),
        some(a("extracted_text")),
        F.when(a("contains_code"), F.concat(F.lit("Contains "), F.coalesce(some(a("code_language")), F.lit("programming")), F.lit(" code"))),
        F.when(a("contains_code"), some(a("code_description"))),
        F.when(a("contains_diagrams"), F.concat(F.lit("Contains "), F.coalesce(some(a("diagram_type")), F.lit("technical")), F.lit(" diagram"))),
        F.when(a("contains_diagrams"), some(a("diagram_description"))),
        F.when(a("contains_ui"), F.lit("Contains user interface elements")),
        F.when(a("contains_ui"), listed("UI elements: ", a("ui_elements"))),
        listed("Technical terms: ", a("technical_terms")),
        listed("Concepts: ", a("concepts")),
    )


def combine_media_text(docs: DataFrame, frames: DataFrame, separator: str = "\n\n--- Text in frames ---\n\n") -> DataFrame:
    """Transcript and, after a separator, the texts seen in the frames of each document (id, transcription), empty parts left out."""
    seen = frames.where(F.coalesce("ocr_text", F.lit("")) != "").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_timestamp", "frame_id", "ocr_text"))), lambda x: x["ocr_text"]), "\n").alias("seen"))
    return docs.join(seen, "id", "left").withColumn("combined_text", F.concat_ws(separator, F.nullif("transcription", F.lit("")), F.col("seen"))).drop("seen")


def best_ocr(results: DataFrame) -> DataFrame:
    """Of each frame its result of highest confidence; the first of equals."""
    by = Window.partitionBy("frame_id").orderBy(F.desc("confidence"), "pos")
    return results.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
