"""Benchmark decontamination by the q-gram lemma: shared q-grams counted in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, mix, text_chunks

#: Characters of a q-gram; of a window of an item, one from each character on: the least passage that is looked for; the share of a window that edits may change.
Q, WINDOW, EDITS = 10, 100, 0.08
#: Items with fewer characters than this after normalising say too little to be looked for.
LEAST = 24
#: Characters of benchmark text that one scan of the documents looks for; a larger benchmark takes several scans.
BLOCK_CHARS = 4_000_000
#: Characters of a document that one pass works on; longer ones are cut with an overlap.
PIECE = 1_000_000


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def edit_distances(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column: fewest edits that turn the pattern a into some part of b, and where that part ends, within `band` diagonals of the main one.

    b may run before and after: the part starts at any of b's first 2 * band + 1 characters. Cells off the band count as more than any budget.
    """
    m, width = len(a), 2 * band + 1
    far = m + 1
    row = np.zeros((width + 1, a.shape[1]), np.int16)  # row[d]: pattern prefix against b up to i + d
    row[width] = far
    along = np.arange(width, dtype=np.int16)[:, None]
    for i in range(m):
        cost = np.minimum(row[:width] + (b[i : i + width] != a[i]), np.minimum(row[1:] + np.int16(1), np.int16(far)))
        # an insertion runs along the row: cost[d] = min over e <= d of cost[e] + d - e
        row[:width] = np.minimum.accumulate(cost - along, axis=0) + along
    best = row[:width].argmin(axis=0)
    return row[best, np.arange(a.shape[1])].astype(np.int64), m + best


def edit_distance(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int]:
    """edit_distances() of one pattern and one text."""
    padded = np.full(len(a) + 2 * band + 1, -1, np.int32)
    padded[: min(len(b), len(padded))] = b[: len(padded)]
    distance, end = edit_distances(a.astype(np.int32)[:, None], padded[:, None], band)
    return int(distance[0]), int(end[0])


@dataclass
class Windows:
    """Every window of the normalised items that is looked for."""

    text: list[np.ndarray]
    item: np.ndarray
    offset: np.ndarray
    budget: np.ndarray


@dataclass
class Index:
    """Normalised items end to end and the sorted q-grams that they hold; the windows of an item all have its width, budget and need."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    width: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    seen: np.ndarray


SEEN_BITS = 22
#: Windows that are aligned at a time.
ALIGNED = 4096


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            out = out * np.uint64(0x100000001B3) + codes[j : len(codes) - q + 1 + j] + np.uint64(1)
    return mix(out)


def _budget(n: int, q: int, edits: float) -> int:
    """Edits for a window of n characters: a text within the budget e shares n - q + 1 - q * e of its q-grams at least; short items take the largest budget for which that leaves some."""
    return max(0, min(int(n * edits), (n - q) // q))


def _coded(items: list[tuple[int, str]], least: int) -> list[tuple[int, np.ndarray]]:
    coded = [(number, np.frombuffer(string.encode("utf-32-le"), np.uint32)) for number, string in items]
    return [(number, codes) for number, codes in coded if len(codes) >= least]


def windows(items: list[tuple[int, str]], q: int = Q, width: int = WINDOW, edits: float = EDITS, least: int = LEAST) -> Windows:
    """The windows of the items one by one, from each character on. find() looks for just these, but through an index of whole items."""
    found = [(number, at, codes[at : at + width]) for number, codes in _coded(items, least) for at in range(max(1, len(codes) - width + 1))]
    budget = [_budget(len(t), q, edits) for _, _, t in found]
    return Windows([t for _, _, t in found], np.array([n for n, _, _ in found], np.int64), np.array([at for _, at, _ in found], np.int64), np.array(budget, np.int64))


def index(items: list[tuple[int, str]], q: int = Q, width: int = WINDOW, edits: float = EDITS, least: int = LEAST) -> Index:
    coded = _coded(items, least)
    texts = [codes for _, codes in coded]
    size = np.array([len(t) for t in texts], np.int64)
    wide = np.minimum(size, width)
    budget = np.array([_budget(n, q, edits) for n in wide.tolist()], np.int64)
    found = [_grams(t.astype(np.uint64), q) for t in texts]
    gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found]) if found else np.zeros(0, np.int32)
    at = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]) if found else np.zeros(0, np.int32)
    order = np.argsort(gram, kind="stable")
    distinct, first = np.unique(gram[order], return_index=True)
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[(distinct >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
    need = np.maximum(wide - q + 1 - q * budget, 1)
    codes = np.concatenate(texts).astype(np.int32) if texts else np.zeros(0, np.int32)
    number = np.array([n for n, _ in coded], np.int64)
    return Index(codes, np.cumsum(size) - size, size, number, wide, budget, need, distinct, np.append(first, len(gram)), owner[order], at[order], seen)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, value) for the values first[k], first[k] + 1, ..., count[k] of them."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[k]


def find(codes: np.ndarray, row: np.ndarray, w: Index, q: int = Q) -> np.ndarray:
    """(row, item, window's offset, first character, end, edits), a line each, of the windows that occur in the texts codes, end to end, of the rows.

    Hits of an item fall on diagonals (place in the text less place in the item). An occurrence of a window with e edits has
    its hits on e + 1 neighbouring diagonals, so with bands of 2 * (e + 1) that overlap by half, one band holds them all.
    A window of which a band holds as many distinct places as the lemma asks for is aligned; others can't be within the budget.
    """
    none = np.zeros((0, 6), np.int64)
    gram = _grams(codes, q)
    maybe = np.flatnonzero(w.seen[(gram >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
    maybe = maybe[row[maybe] == row[maybe + q - 1]]
    if not len(maybe) or not len(w.gram):
        return none
    slot = np.searchsorted(w.gram, gram[maybe])
    slot[slot == len(w.gram)] = 0
    hit = w.gram[slot] == gram[maybe]
    maybe, slot = maybe[hit], slot[hit]
    k, post = _spread(w.first[slot], w.first[slot + 1] - w.first[slot])
    place, owner, at = maybe[k], w.owner[post], w.at[post].astype(np.int64)
    keep = (np.bincount(owner, minlength=len(w.need)) >= w.need)[owner]  # a window needs that many hits in all
    place, owner, at = place[keep], owner[keep].astype(np.int64), at[keep]
    if not len(place):
        return none
    diagonal, own, half = place - at, row[place], w.budget[owner] + 1
    shift = int(w.budget.max()) + 2
    band = (diagonal + shift) // half
    # each hit is in the band of its diagonal and in the one half a band before
    owner, own, at, diagonal = (np.concatenate((x, x)) for x in (owner, own, at, diagonal))
    band = np.concatenate((band, band - 1))
    order = np.lexsort((at, band, own, owner))
    owner, own, band, at, diagonal = (x[order] for x in (owner, own, band, at, diagonal))
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (own[1:] != own[:-1]) | (band[1:] != band[:-1])
    fresh = new.copy()
    fresh[1:] |= at[1:] != at[:-1]
    group = np.cumsum(new)[fresh]
    owner, own, band, at, diagonal = (x[fresh] for x in (owner, own, band, at, diagonal))
    # windows that hold the places from the i-th to the last that the lemma asks for start at low .. high
    i = np.arange(len(at))
    last = i + w.need[owner] - 1
    i, last = i[last < len(at)], last[last < len(at)]
    fits = (group[i] == group[last]) & (at[last] - at[i] <= w.width[owner[i]] - q)
    i, last = i[fits], last[fits]
    low = np.maximum(at[last] - (w.width[owner[i]] - q), 0)
    high = np.minimum(at[i], (w.size - w.width)[owner[i]])
    low[1:] = np.where(group[i[1:]] == group[i[:-1]], np.maximum(low[1:], high[:-1] + 1), low[1:])
    k, offset = _spread(low, np.maximum(high - low + 1, 0))
    i = i[k]
    return np.concatenate([none, *(_verify(codes, row, w, owner[j], own[j], band[j], diagonal[j], offset[c], shift) for c, j in _equal_widths(w.width[owner[i]], i))])


def _equal_widths(width: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in np.unique(width).tolist():
        same = np.flatnonzero(width == n)
        for at in range(0, len(same), ALIGNED):
            yield same[at : at + ALIGNED], i[same[at : at + ALIGNED]]


def _verify(codes: np.ndarray, row: np.ndarray, w: Index, owner: np.ndarray, own: np.ndarray, band: np.ndarray, diagonal: np.ndarray, offset: np.ndarray, shift: int) -> np.ndarray:
    """The lines of find() for candidates of one width: those with no edit on the diagonal of a hit by comparing, others by alignment."""
    m, e = int(w.width[owner[0]]), int(w.budget[owner[0]])
    begin_row, end_row = np.searchsorted(row, own), np.searchsorted(row, own, "right")

    def text(begin: np.ndarray, n: int, c: np.ndarray | slice) -> np.ndarray:
        at = begin + np.arange(n)[:, None]
        inside = (at >= begin_row[c]) & (at < end_row[c])
        return np.where(inside, codes[np.where(inside, at, 0)].astype(np.int32), np.int32(-1))

    pattern = w.codes[w.start[owner] + offset + np.arange(m)[:, None]]
    exact = (text(diagonal + offset, m, slice(None)) == pattern).all(axis=0)
    first, end, distance = diagonal + offset, diagonal + offset + m, np.zeros(len(own), np.int64)
    c = np.flatnonzero(~exact)
    if len(c):
        # diagonals low .. low + 2e + 1, and e more at each side for what the occurrence's other edits shift
        wide = 2 * e + 1
        begin = band[c] * (e + 1) - shift - e + offset[c]
        distance[c], ends = edit_distances(pattern[:, c], text(begin, m + 2 * wide + 1, c), wide)
        first[c], end[c] = np.maximum(np.maximum(begin, begin_row[c]), begin + ends - m), begin + ends
    return np.stack((own, owner, offset, first, end, distance), axis=1)[distance <= e]


def _blocks(benchmark: DataFrame, size: int | None = None, named: bool = True) -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark, a stated query set, in blocks of about `size` characters (an item stays whole), and whether there are several.

    A block is made when it is asked for, small enough to go to all tasks; the driver holds one at a time. named: items with an id, which is kept; else every text counts, as 0.
    """
    kept = benchmark.where(F.col("item_id").isNotNull()).withColumn("item_id", F.col("item_id").cast("long")) if named else benchmark.select(F.lit(0).cast("long").alias("item_id"), "text")
    rows = kept.select("item_id", normal(F.col("text")).alias("text")).where(F.length("text") >= LEAST).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // (size or BLOCK_CHARS))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        w = index(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)))
        if len(w.item):
            yield w, blocks > 1


def _lines(column: pa.Array, w: Index) -> list[np.ndarray]:
    """Place of the text, item id, window's offset, first character, end and edits of each window that a column of normalised texts holds; long texts are cut into pieces."""
    reach, found = WINDOW * 2, []
    coded = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in column.to_pylist()]
    sizes = [len(c) for c in coded]
    if max(sizes) > PIECE:
        cut = [(i, at) for i, n in enumerate(sizes) for at in range(0, max(1, n - reach), PIECE)]
        groups = [[(i, at, coded[i][at : at + PIECE + reach])] for i, at in cut]
    else:
        groups = [[(i, 0, c) for i, c in enumerate(coded)]]
    for group in groups:
        codes = np.concatenate([c for _, _, c in group]).astype(np.uint64)
        row = np.repeat(np.arange(len(group)), [len(c) for _, _, c in group])
        base = np.cumsum([0, *(len(c) for _, _, c in group)])
        lines = find(codes, row, w)
        own, shift = lines[:, 0], (np.array([at for _, at, _ in group]) - base[:-1])[lines[:, 0]]
        found.append((np.array([i for i, _, _ in group])[own], w.item[lines[:, 1]], lines[:, 2], lines[:, 3] + shift, lines[:, 4] + shift, lines[:, 5]))
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item of which it holds a passage: doc_id, item_id, n_windows (windows found), chars (from the first to the end of the last), edits (fewest of a window).

    Both sides are lower-cased and white space is one blank. An item is looked for by windows of WINDOW characters
    from each of its characters on (a shorter item whole), each within EDITS of its length, so no excerpt of WINDOW characters is missed. Null and empty texts hold nothing; items without an id, which have no name to report, and
    items under LEAST characters are not looked for; items that repeat are found under each id. Repeated documents of
    one id are one document. Texts are scanned whole, long ones in pieces that overlap by more than a window.
    """
    parts = []
    for w, several in _blocks(benchmark):

        def run(batches: Iterable[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches):
                at, *rest = (pa.array(column, pa.int64()) for column in _lines(batch.column("text"), w))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *rest], ["doc_id", "item_id", "window_at", "first", "end", "edits"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("text"))
        found = texts.mapInArrow(run, "doc_id long, item_id long, window_at long, first long, end long, edits long")
        parts.append(materialize(found, "leaks") if several else found)  # written, so that no block's index is kept
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, chars long, edits long")
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("doc_id", "item_id").agg(F.countDistinct("window_at").alias("n_windows"), (F.max("end") - F.min("first")).alias("chars"), F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with whatever columns, whose text holds no passage of a benchmark item (find_leaks), with or without an id. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    names, schema = docs.columns, docs.schema
    before = None
    for w, several in _blocks(benchmark, named=False):

        def run(batches: Iterable[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, "normal_text"):
                clean = np.ones(batch.num_rows, bool)
                clean[_lines(batch.column("normal_text"), w)[0]] = False
                yield pa.RecordBatch.from_arrays(batch.column("row").flatten(), names).filter(pa.array(clean))

        packed = docs.select(normal(F.col("text")).alias("normal_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
        docs = packed.mapInArrow(run, schema)
        if several:
            docs = materialize(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a passage of a benchmark item go, by find_leaks' rules. Null and empty texts stay; rows with null or repeated ids are judged one by one, repeated rows alike; without items or rows nothing goes."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
