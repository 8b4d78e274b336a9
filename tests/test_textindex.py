"""English stems, the stored index and its best rows, and searches that follow their data."""

from __future__ import annotations

import math
import shutil
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.operators import fulltext, textindex
from tessera.plans import registry

# Words with their stems, from the algorithm's published vocabulary and its rules' examples.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consolidate consolid consolidated consolid consolidating consolid consolingly consol
consonant conson consort consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knag knag knave knave knavish knavish
kneaded knead knee knee kneeled kneel kneels kneel knees knee knif knif knife knife knightly knight knits knit knitted knit knitting knit knives knive knocker knocker
running run runs run companies compani company compani generate generat generic generic generous generous communication communic hopping hop hoping hope relational relat
conditional condit rational ration dying die skies sky gas gas this this gaps gap kiwis kiwi agreed agre feed feed cry cri by by say say enjoy enjoy analogy analog
controlling control rate rate probate probat falling fall replacement replac adoption adopt tried tri ties tie cries cri proceeding proceed exceedingly exceed innings inning news news
""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, stem):
    assert english.stem(word) == stem


def plain_terms(text):
    found = defaultdict(list)
    for pos, word in enumerate(regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())):
        if word not in english.STOP:
            found[english.stem(word)].append(pos)
    return found


def test_english_terms_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.doc_id, t, len(p), p[0], p[-1]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for t, p in plain_terms(r.text).items()}
    assert {tuple(r) for r in registry.queries()["T1_english_terms"](spark, sf).collect()} == want


def test_terms_are_shuffled_only_for_ids_that_rows_share(spark):
    """Places of rows that share an id meet, those without an id too; all other rows are indexed where they are read."""
    rows = [(1, "services run"), (2, "a service, services"), (1, "running"), (None, "x"), (None, "y x"), (3, None), (3, "the")]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = textindex.english_terms(docs, "id", "text")
    want = {(1, "servic", 1, (0,)), (1, "run", 2, (0, 1)), (2, "servic", 2, (1, 2)), (None, "x", 2, (0, 1)), (None, "y", 1, (0,))}
    assert {(r.id, r.term, r.tf, tuple(r.places)) for r in found.collect()} == want
    own = textindex.english_terms(docs.where("id = 2"), "id", "text")
    own.collect()
    plan = own._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(id" not in plan, plan


def test_postings_are_counted_in_their_row(spark):
    """As over all postings, rows that share an id or have none included; of others no posting is shuffled."""
    rows = [(1, "one two the"), (2, "Two two of"), (1, "two three"), (None, "x"), (None, "y x"), (3, None), (4, "the of"), (5, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = fulltext.index_sizes(docs, "id", "text")
    assert {tuple(r) for r in found.collect()} == {(1, 4, 1, 3), (2, 2, 1, 1), (None, 3, 1, 2)}
    own = fulltext.index_sizes(docs.where("id = 2"), "id", "text")
    own.collect()
    assert "hashpartitioning(id" not in own._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_forms_of_a_word_meet(spark):
    docs = spark.createDataFrame([(1, "Deployments of the services; companies running"), (2, "deploying a service, a company runs"), (3, "the dear deer"), (4, None), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(7, "services deployed"), (8, "run, company!"), (9, "the of"), (10, None)], "query_id long, query string")
    index = textindex.build(docs, "id", "text")
    got = textindex.top_ranked(index, textindex.english_query(asked), every=True).select("query_id", "id").collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert [(r.term_no, r.term) for r in textindex.english_query(asked.where("query_id = 8")).orderBy("term_no").collect()] == [(0, "run"), (1, "compani")]
    plain = fulltext.match_all_terms(fulltext.tokenize_index(docs, "id", "text"), fulltext.query_terms(asked.where("query_id = 8")))
    assert plain.count() == 0
    index.drop()


@pytest.mark.parametrize("every", [False, True])
def test_best_rows_are_those_of_scoring_all(spark, every):
    """Against plain Python over whole sf0.01, with most blocks left unread."""
    sf, k = "/root/testdata/sf0.01", 3
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms = {r.doc_id: {t: len(p) for t, p in plain_terms(r.text).items()} for r in docs.collect()}
    holders = defaultdict(list)
    for i, found in terms.items():
        for t in found:
            holders[t].append(i)
    some = sorted(holders, key=lambda t: (-len(holders[t]), t))
    texts = {q: " ".join([some[q * 7], some[q * 40 + 3], some[1_000 + q * 11]]) for q in range(40)}
    asked = spark.createDataFrame([(q, *x) for q, words in texts.items() for x in enumerate(words.split())], "query_id long, term_no int, term string")
    want = set()
    for q, words in texts.items():
        words = words.split()
        scored = []
        for i in {i for w in words for i in holders[w]}:
            tf = [terms[i][w] for w in words if w in terms[i]]
            if not every or len(tf) == len(words):
                scored.append((-round(sum(0.1 * (1 + math.log(n)) for n in tf) / len(words), 9), i))
        want |= {(q, i, -s) for s, i in sorted(scored)[:k]}
    index = textindex.build(docs, "doc_id", "text", rows=8)
    got = textindex.top_ranked(index, asked, k, every)
    assert {(r.query_id, r.id, round(r.text_rank, 9)) for r in got.collect()} == want
    bound = textindex.bounds(index, asked, every)
    everything = textindex.scores(index, asked, bound, every)
    read = textindex.surviving(bound, textindex.best(everything, k), k).agg(F.sum("blocks")).first()[0]
    assert read < (0.75 if not every else 1) * index.heads.join(asked, "term").count()
    index.drop()


def test_blocks_of_a_range_are_in_one_file(spark):
    """The bounds and scores of a range come from one task; rows that share an id are one row of their block."""
    docs = spark.createDataFrame([(i % 90 if i < 95 else None, f"alpha w{i % 7} alpha the w{i % 3}") for i in range(97)], "id long, text string")
    index = textindex.build(docs, "id", "text", rows=4)
    assert index.blocks.select("range", F.input_file_name().alias("f")).distinct().groupBy("range").count().agg(F.max("count")).first()[0] == 1
    blocks = index.blocks.collect()
    found = {(r.term, i): (tf, p) for r in blocks for i, tf, p in zip(r.ids, r.tfs, r.places)}
    want = {(r.term, r.id): (r.tf, r.places) for r in textindex.english_terms(docs, "id", "text").collect()}
    assert found == want and all(r.n == len(r.ids) and r.most_tf == max(r.tfs) for r in blocks)
    assert all(r.ids == sorted(r.ids, key=lambda i: -1 if i is None else i) for r in blocks)
    asked = spark.createDataFrame([(1, "alpha"), (1, "w2"), (2, "w6"), (3, "none")], "query_id long, term string")
    got = [tuple(r)[:2] for r in textindex.top_ranked(index, asked, 3).orderBy("query_id", F.desc(F.round("text_rank", 9)), "id").collect()]
    ranks = defaultdict(lambda: defaultdict(float))
    for (term, i), (tf, _) in want.items():
        for q, t in ((1, "alpha"), (1, "w2"), (2, "w6")):
            ranks[q][i] += 0.1 * (1 + math.log(tf)) * (t == term)
    best = [(q, i) for q in (1, 2) for s, _, i in sorted((-round(s, 9), -1 if i is None else i, i) for i, s in ranks[q].items() if s)[:3]]
    assert got == best
    index.drop()


def test_a_term_s_blocks_are_found_by_statistics_of_the_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = textindex.build(docs, "doc_id", "text")
    plan = index.heads.where("term = 'licens'")._jdf.queryExecution().toString()
    assert "EqualTo(term,licens)" in plan and "places" not in plan.split("ReadSchema")[-1]
    index.drop()


def test_searches_follow_their_data(spark, tmp_path):
    """documents change under one path: every search gives the rows of the data that is there."""
    sf = f"{tmp_path}/sf"
    shutil.copytree("/root/testdata/sf0.001", sf, copy_function=shutil.copyfile)
    names = ["T2_match_all_terms", "T2_match_short", "T3_match_websearch", "T4_keyword_search", "T5_text_rank_cd", "T6_text_rank", "T6_top_blocks", "V5_hybrid_search", "R10_strategy_dispatch"]
    queries = registry.queries()
    before = {n: queries[n](spark, sf).count() for n in names}
    assert all(before.values()), before
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none")
    (tmp_path / "sf" / "documents.parquet").unlink()
    shutil.copytree(f"{tmp_path}/none", f"{sf}/documents.parquet")
    after = {n: queries[n](spark, sf).collect() for n in names}
    assert not any(after[n] for n in names if n.startswith("T")), {n: len(after[n]) for n in names}
    assert not any(r.chunk_id is None for r in after["V5_hybrid_search"])
    assert len(after["R10_strategy_dispatch"]) < before["R10_strategy_dispatch"]
