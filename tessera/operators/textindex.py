"""A stored text index: English terms in blocks of postings, and the best k rows of a query from the blocks that can hold them.

Rows are dealt to ranges by a hash of their id, and a block holds a term's postings in one range with the largest
frequency among them. What a range can score at most for a query is then known from its blocks' heads alone, so ranges that
can't reach the k-th best score found so far are skipped without reading their postings: block-max pruning, with blocks that
are aligned over terms so that a bound is a sum over one join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.operators.fulltext import TERM, apart
from tessera.operators.windows import topk_per_query
from tessera.sources.scratch import delete, folder, stored

#: Rows that a range holds on average.
RANGE_ROWS = 256


def english_terms(df: DataFrame, id: str, col: str) -> DataFrame:
    """id, term, tf and places (positions from 0, in order) of the English terms of a text column.

    Words are runs of letters and digits in lower case; stop words are left out but count as positions. A task remembers
    the stems of words it has met. Terms are put together in their row; only rows that share an id are shuffled. A null or empty text has no terms.
    """
    rows = df.withColumnRenamed(id, "id")
    once, again = apart(rows)
    found = row_terms(again, col).groupBy("id", "term").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    return row_terms(once, col).unionByName(found).select("id", "term", F.size("places").alias("tf"), "places")


def _words(col: str):
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TERM), F.lit(0)).alias("words")


def _stems():
    """A memory of words' stems for one task; stop words have none."""
    stop = frozenset(english.STOP)
    return lru_cache(1 << 17)(lambda word: None if word in stop else english.stem(word))


def _places(words: pa.ListArray, stem) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all words of a list of texts that have a stem: number of the text, position in it, number of the term; and the terms."""
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = words.flatten().dictionary_encode()
    terms = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    term = terms.indices.take(coded.indices)
    kept = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
    return row[kept], pos[kept].astype(np.int32), term.take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def _sorted(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key and pos by key, then pos."""
    n = int(pos.max(initial=0)) + 1
    if int(key.max(initial=0)) < 2**62 // n:  # both in one number sort much faster
        key, pos = np.divmod(np.sort(key * n + pos), n)
        return key, pos.astype(np.int32)
    order = np.lexsort((pos, key))
    return key[order], pos[order]


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    """values as lists that begin where first says."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), values)


def row_terms(rows: DataFrame, col: str) -> DataFrame:
    """id, term and places of each row's English terms, found where the row is read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = _stems()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, pos, term, terms = _places(part.column(1), stem)
                key, pos = _sorted(row * (len(terms) + 1) + term, pos)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                row, term = np.divmod(key[first], len(terms) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), terms.take(pa.array(term)), _lists(first, pa.array(pos))], ["id", "term", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", _words(col)).mapInArrow(run, f"id {kind}, term string, places array<int>")


def english_query(queries: DataFrame, text: str = "query") -> DataFrame:
    """query_id, term_no (from 0) and term of each query's distinct English terms, in the order in which they first stand: what english_terms makes of the same words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    rows = queries.select("query_id", F.posexplode(words).alias("pos", "word")).where(~F.col("word").isin(*english.STOP))
    first = rows.withColumn("term", english.english_stem(F.col("word"))).groupBy("query_id", "term").agg(F.min("pos").alias("pos"))
    by = Window.partitionBy("query_id").orderBy("pos")
    return first.select("query_id", (F.row_number().over(by) - 1).alias("term_no"), "term")


@dataclass
class TextIndex:
    """blocks: term, range, n, most_tf, ids, tfs and places (a list of positions for each id); ids of a block are in order."""

    blocks: DataFrame
    path: str

    @property
    def heads(self) -> DataFrame:
        """What is known of a block without its postings."""
        return self.blocks.select("term", "range", "n", "most_tf")

    def drop(self) -> None:
        delete(self.blocks.sparkSession, self.path)


def build(df: DataFrame, id: str, col: str, path: str | None = None, rows: int = RANGE_ROWS) -> TextIndex:
    """The index of a text column. A file holds ranges whole, sorted by term, so that a term's blocks are read without the others'. The number of ranges follows the number of rows."""
    spark = df.sparkSession
    path = path or folder(spark, "text-index")
    ranges = max(1, -(-df.count() // rows))
    dealt = df.select(F.col(id).alias("id"), F.col(col).alias("text")).withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
    parts = max(1, min(ranges // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # stemming is slow for its bytes, which decide the tasks otherwise
    blocks = range_blocks(dealt.repartition(parts, "range").sortWithinPartitions("range"))
    blocks.sortWithinPartitions("term", "range").write.mode("overwrite").parquet(path)
    return opened(spark, path, blocks)


def whole_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one range after the other, of batches in the order of range."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        range = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(range)) + 1), len(range)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                if held and held[0].column("range")[0].as_py() != range[start]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def range_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of rows (range, id, text) whose partitions hold ranges whole and in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = _stems()
        for part in whole_ranges(batches):
            row, pos, term, terms = _places(part["words"].combine_chunks(), stem)
            ids = pc.unique(part["id"].combine_chunks())
            ids = ids.take(pc.array_sort_indices(ids, null_placement="at_start"))
            one = pc.index_in(part["id"].combine_chunks(), ids).to_numpy()[row]
            key, pos = _sorted(term * len(ids) + one, pos)
            at = np.flatnonzero(np.diff(key, prepend=-1))  # a posting: a term in the rows of an id
            tf = np.diff(np.append(at, len(key))).astype(np.int32)
            places = _lists(at, pa.array(pos))
            of, one = np.divmod(key[at], len(ids))
            first = np.flatnonzero(np.diff(of, prepend=-1))  # a block: a term's postings
            if not len(first):
                continue
            heads = pa.array(np.diff(np.append(first, len(of))), pa.int64())
            range = part["range"].combine_chunks().take(pa.array(np.zeros(len(first), np.int64)))
            most = pa.array(np.maximum.reduceat(tf, first))
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(of[first])), range, heads, most, _lists(first, ids.take(pa.array(one))), _lists(first, pa.array(tf)), _lists(first, places)], names)

    kind = rows.schema["id"].dataType.simpleString()
    names = ["term", "range", "n", "most_tf", "ids", "tfs", "places"]
    return rows.select("range", "id", _words("text")).mapInArrow(run, f"term string, range int, n long, most_tf int, ids array<{kind}>, tfs array<int>, places array<array<int>>")


def opened(spark: SparkSession, path: str, like: DataFrame | None = None) -> TextIndex:
    """An index that build() wrote."""
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return TextIndex(reader.parquet(path), path)


def _impact(tf: str):
    return 0.1 * (1 + F.log(tf))


def bounds(index: TextIndex, terms: DataFrame, every: bool = False) -> DataFrame:
    """query_id, range, bound and blocks: what a row of a range can score at most for a query, from the heads of blocks. every: only ranges that have all terms of the query."""
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    found = index.heads.join(terms, "term").groupBy("query_id", "range").agg(F.sum(_impact("most_tf")).alias("most"), F.count("*").alias("blocks"))
    out = found.join(need, "query_id").withColumn("bound", F.col("most") / F.col("need"))
    out = out.where("blocks = need") if every else out
    return out.select("query_id", "range", "bound", "blocks", "need")


def scores(index: TextIndex, terms: DataFrame, ranges: DataFrame, every: bool = False, k: int | None = None) -> DataFrame:
    """query_id, id and text_rank of the rows of the given ranges (query_id, range, need), from their postings: each term adds 1 + ln(its frequency) in tenths, over the number of terms.

    A range's blocks meet in one task, where its queries are summed up together, term by term. k: only the best k of each range and query.
    """
    asking = terms.groupBy("term").agg(F.collect_list("query_id").alias("queries"))
    held = index.blocks.select("term", "range", "ids", "tfs").join(asking, "term")
    given = ranges.groupBy("range").agg(F.collect_list("query_id").alias("queries"), F.collect_list("need").alias("needs"))
    rows = given.unionByName(held, allowMissingColumns=True).select("range", "term", "ids", "tfs", "queries", "needs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_ranges(batches):
            heads, blocks = part.slice(0, 1), part.slice(1)
            if heads["needs"][0].as_py() is None or not blocks.num_rows:  # no query looks at this range
                continue
            queries, needs = heads["queries"].combine_chunks().flatten(), heads["needs"].combine_chunks().flatten().to_numpy()
            ids, asked = blocks["ids"].combine_chunks(), blocks["queries"].combine_chunks()
            rows = pc.unique(ids.flatten())
            rows = rows.take(pc.array_sort_indices(rows, null_placement="at_start"))
            row = pc.index_in(ids.flatten(), rows).to_numpy()
            impact = 0.1 * (1 + np.log(blocks["tfs"].combine_chunks().flatten().to_numpy()))
            n = ids.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(n)), asked.value_lengths().to_numpy())
            query = pc.fill_null(pc.index_in(asked.flatten(), queries), -1).to_numpy()
            of, query = of[query >= 0], query[query >= 0].astype(np.int64)
            many = n[of]  # a block's postings, once for each query that has its term
            at = np.repeat((np.cumsum(n) - n)[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key = np.repeat(query, many) * len(rows) + row[at]
            size = len(queries) * len(rows)
            have, sums = np.bincount(key, minlength=size), np.bincount(key, impact[at], size)
            hit = np.flatnonzero(have)
            q, r = np.divmod(hit, len(rows))
            if every:
                full = have[hit] == needs[q]
                hit, q, r = hit[full], q[full], r[full]
            rank = sums[hit] / needs[q]
            if k:
                order = np.lexsort((r, -np.round(rank, 9), q))
                nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
                order = order[nth < k]
                q, r, rank = q[order], r[order], rank[order]
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), rows.take(pa.array(r)), pa.array(rank)], ["query_id", "id", "text_rank"])

    kind, query = index.blocks.schema["ids"].dataType.elementType.simpleString(), terms.schema["query_id"].dataType.simpleString()
    dealt = rows.repartition("range").sortWithinPartitions("range", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, f"query_id {query}, id {kind}, text_rank double")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; ranks are equal to nine places, then the smaller id comes first."""
    return topk_per_query(hits.withColumn("score", F.round("text_rank", 9)), k).drop("score", "rank")


def surviving(bound: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The ranges of bound that first, the hits of the ranges looked at, can't rule out: those whose bound is not below the k-th best score of their query."""
    by = Window.partitionBy("query_id").orderBy(F.desc("text_rank"))
    least = first.withColumn("nth", F.row_number().over(by)).where(F.col("nth") == k).select("query_id", F.col("text_rank").alias("least"))
    # a bound and a score add the same numbers, maybe in another order, which shows in the last bits
    return bound.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9)).drop("least")


def top_ranked(index: TextIndex, terms: DataFrame, k: int = 10, every: bool = False, ahead: int = 4) -> DataFrame:
    """query_id, id and text_rank of the k best rows of each query of terms (query_id, term), of equals the smaller ids; every: rows with all terms only.

    The `ahead` ranges with the highest bounds are scored first; of the others those follow whose bound the k-th best score so far doesn't exceed.
    The result is that of scoring all postings.
    """
    terms = stored(terms.select("query_id", "term"), "query-terms")
    found = bounds(index, terms, every)
    by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    ordered = stored(found.withColumn("nth", F.row_number().over(by)), "bounds")
    lead, others = ordered.where(F.col("nth") <= ahead), ordered.where(F.col("nth") > ahead)
    first = stored(best(scores(index, terms, lead, every, k), k), "first-hits")
    rest = scores(index, terms, surviving(others, first, k), every, k)
    return best(first.unionByName(rest), k)
