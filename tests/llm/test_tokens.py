"""Prefix counts against the tokenizers library, which encodes every prefix anew."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.queries import op11_count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.Counter(tokens.Vocabulary.read(PATH))


def by_library(texts: list[str]) -> list[int]:
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def own(text: str) -> list[int]:
    changes = COUNTER.text(text)
    return tokens.unpack(tokens.pack(changes), len(text)).tolist()


BITS = ["'s", "'re", "'ll've", " ", "  ", "\n", "\t", "a", "the", " hello", "é", "ß", "日本", "1", "23", "!", "'", "''", "<|endoftext|>", "<|endof", "\x1c", "\x85", " ", "😀", "​", "²", "́", "Ᲊ", "࢏", "\U000323b0"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(BITS), max_size=14).map("".join), st.text(max_size=40)))
@example("a  <|endoftext|>  b")
@example("!!<|endoftext|><|endoftext|>'s  \n")
@example("  \x85're''")
def test_every_prefix(text):
    assert own(text) == by_library([text[:i] for i in range(len(text) + 1)])


def test_long_texts():
    for text in ("ab" * 30_000 + "q" * 30_000, " \n" * 2_000 + "x", "é" * 5_000, "word " * 20_000, "'" * 3_000):
        assert own(text)[-1] == by_library([text])[0]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_count_tokens(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    counts = dict(zip(want, by_library(list(want.values())), strict=True))
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), counts[r.doc_id], counts[r.doc_id] > 512)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, "x"), (None, "a  b", None), (1, "", "y"), (None, "a  b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefixes string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PATH, 2).collect()), key=str)
    n = by_library(["a  b"])[0]
    assert got == sorted([(1, 0, 0, False), (None, 4, n, n > 2), (1, 0, 0, False), (None, 4, n, n > 2)], key=str)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_budgets_are_answered_from_what_is_stored(spark):
    """The longest prefix within a budget, and the count before a place, against the library on every prefix."""
    texts = ["I'll say   so:\n\n  naïve <|endoftext|>'s end", "one two  three", "", "日本語 text"]
    stored = tokens.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    asked = stored.crossJoin(spark.range(-1, 60).withColumnRenamed("id", "n"))
    got = asked.select("doc_id", "n", tokens.longest_within(F.col("prefixes"), F.col("n_chars"), F.col("n")).alias("most"), tokens.tokens_within(F.col("prefixes"), F.col("n_chars"), F.col("n")).alias("count")).collect()
    assert len(got) == 4 * 61
    for r in got:
        counts = by_library([texts[r.doc_id][:i] for i in range(len(texts[r.doc_id]) + 1)])
        assert r.most == max(i for i, c in enumerate(counts) if c <= max(r.n, 0))
        assert r["count"] == counts[min(max(r.n, 0), len(counts) - 1)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
