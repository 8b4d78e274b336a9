"""Chunking and page reading as table functions, for SQL: SELECT ... FROM t, LATERAL text_chunks(t.text)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.operators import text as X
from tessera.operators import web as W


class TextChunks:
    """Rows (chunk_index, section_title, chunk_text, token_count) of a text; null and empty texts have none."""

    def eval(self, text: str) -> Iterator[tuple]:
        n = 0
        for title, body in X.sections(text) if text else ():
            for chunk, tokens in X.chunks(body):
                yield n, title, chunk, tokens
                n += 1


class PageLinks:
    """Rows (pos, link) of a page's URL and HTML, each link once; a null page has none."""

    def eval(self, url: str, html: str) -> Iterator[tuple]:
        for pos, link in enumerate(W.read_page(url or "", html)["links"]):
            yield pos, link


def register(spark: SparkSession) -> None:
    """Names the functions text_chunks and page_links in the session."""
    spark.udtf.register("text_chunks", udtf(TextChunks, returnType="chunk_index int, section_title string, chunk_text string, token_count int"))
    spark.udtf.register("page_links", udtf(PageLinks, returnType="pos int, link string"))
