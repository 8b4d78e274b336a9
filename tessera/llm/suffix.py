"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier too, found by deep-shallow sorting of anchored suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, text_buffers, text_chunks, whole_groups

#: Bytes of a string that counts as repeated, and of the gram that anchors it: the least hash among a string's grams.
SPAN, GRAM = 100, 24
#: Bytes that multikey quicksort sorts by, in words of eight; blind tries order what still agrees.
SHALLOW_WORDS = 5
#: Anchors of one gram beyond this many are matched by grouping their strings, which combines before it shuffles.
HOT_GROUP = 50_000
#: Of those the grams with more than one of HOT_SHARE anchors are known beforehand, 2 * HOT_SHARE grams at most; their rows go to SALTS tasks.
#: A task tells the grams that it holds more than TOLD times, if they are more than one of 2 * HOT_SHARE of its anchors.
HOT_SHARE, SALTS, TOLD = 100_000, 64, 8
#: Starts that one pass works on; a longer text is cut, each part reading SPAN - 1 bytes into the next.
PIECE = 2_000_000
_POSITION_BITS = np.uint64(23)
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    with np.errstate(over="ignore"):
        b = raw.astype(np.uint64)
        b = (b[:-1] << np.uint64(8)) | b[1:]
        b = (b[:-2] << np.uint64(16)) | b[2:]
        b = (b[:-4] << np.uint64(32)) | b[4:]
        x = b[:-16] * np.uint64(0x9E3779B97F4A7C15)
        x += b[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
        x += b[16:] * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings of SPAN bytes that lie within a row: gram hash, row, first string's start, its distance to the anchor, number of strings.

    A string's anchor is its gram of least hash, the leftmost of equals, so equal strings have equal anchors at equal
    distances. Strings that follow one another and share an anchor make one anchor of this list.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < SPAN:
        return none.astype(np.uint64), none, none, none, none
    hashed = gram_hashes(raw)
    least = (hashed >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(hashed), dtype=np.uint64)
    width, window = 1, SPAN - GRAM + 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    size = np.diff(starts)
    long = size >= SPAN
    change = np.zeros(len(raw) + 1, np.int32)
    change[starts[:-1][long]] += 1
    change[starts[1:][long] - SPAN + 1] -= 1
    at = np.flatnonzero(np.cumsum(change[: len(least)]))
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    anchor = (least[at] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    row = np.searchsorted(starts, at[head], "right") - 1
    return hashed[anchor[head]], row, at[head] - starts[row], anchor[head] - at[head], np.diff(np.append(head, len(at)))


def multikey_quicksort(words: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group (already ascending), then by the words: (order, segment), equal in segment where all words agree.

    Multikey quicksort with all open segments partitioned at once: around a pivot word of its own, each splits in
    three; the middle part goes on to the next word.
    """
    n = len(group)
    order = np.arange(n)
    segment = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    depth = np.zeros(n, np.int64)
    table = np.stack(words) if words else np.zeros((0, n), np.uint64)
    while n:
        head = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        size = np.diff(np.append(head, n))
        own = np.repeat(np.arange(len(head)), size)
        open_ = (size[own] > 1) & (depth < len(words))
        at = np.flatnonzero(open_)
        if not len(at):
            return order, segment
        value = table[depth[at], order[at]]
        middle = head + size // 2
        pivot = table[np.minimum(depth[middle], len(words) - 1), order[middle]][own[at]]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        key = segment[at] * 3 + side
        moved = np.argsort(key, kind="stable")
        order[at], key, side = order[at][moved], key[moved], side[moved]
        depth[at] = depth[at][moved] + (side == 1)
        wide = segment * 3
        wide[at] = key
        segment = np.cumsum(np.concatenate(([0], wide[1:] != wide[:-1])))
    return order, segment


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps of each branch only how far down it is and its next bytes; strings themselves are read once, at the leaf a blind descent ends in."""

    def __init__(self, first: bytes):
        self.root: tuple | bytes = first

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def insert(self, s: bytes) -> None:
        node = self.root
        while not isinstance(node, bytes):
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        shared = common_prefix(s, node)
        above, at, node = None, None, self.root
        while not isinstance(node, bytes) and node[0] < shared:
            above, at = node, self._byte(s, node[0])
            node = node[1][at]
        if not isinstance(node, bytes) and node[0] == shared:
            node[1][self._byte(s, shared)] = s
            return
        leaf = node
        while not isinstance(leaf, bytes):
            leaf = next(iter(leaf[1].values()))
        branch = (shared, {self._byte(leaf, shared): node, self._byte(s, shared): s})
        if above is None:
            self.root = branch
        else:
            above[1][at] = branch

    def ordered(self) -> Iterator[tuple[bytes, int]]:
        """Strings in order, each with the bytes it shares with the one before (0 for the first)."""
        waiting: list[tuple[tuple | bytes, int]] = [(self.root, 0)]
        while waiting:
            node, shared = waiting.pop()
            if isinstance(node, bytes):
                yield node, shared
                continue
            children = [node[1][c] for c in sorted(node[1])]
            waiting += [(c, node[0]) for c in reversed(children[1:])]
            waiting.append((children[0], shared))


def deep_shallow_sort(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the strings of each group (ascending): lcp[i] is the prefix that the i-th in order shares with the one before, -1 at a group's first.

    Multikey quicksort orders by the first SHALLOW_WORDS words; groups that still agree there go through blind tries.
    """
    n, depth = len(strings), SHALLOW_WORDS * 8
    whole = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), ">u8").reshape(n, SHALLOW_WORDS)
    length = np.fromiter(map(len, strings), np.int64, n)
    words = [whole[:, j].astype(np.uint64) for j in range(SHALLOW_WORDS)] + [np.minimum(length, depth).astype(np.uint64)]
    order, segment = multikey_quicksort(words, group)
    head = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    ends = np.append(head[1:], n)
    lcp = np.full(n, -1, np.int64)
    for a, b in zip(head.tolist(), ends.tolist(), strict=True):
        if b - a == 1:
            continue
        places: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            places.setdefault(strings[i], []).append(i)
        if len(places) == 1:
            lcp[a + 1 : b] = len(next(iter(places)))
            continue
        trie = None
        for s in places:
            if trie is None:
                trie = BlindTrie(s)
            else:
                trie.insert(s)
        at = a
        for s, shared in trie.ordered():
            same = places[s]
            order[at : at + len(same)] = same
            lcp[at] = shared
            lcp[at + 1 : at + len(same)] = len(s)
            at += len(same)
    first = head[1:][group[order[head[1:]]] == group[order[head[1:] - 1]]]
    if len(first):  # between segments the first words decide
        a, b = order[first - 1], order[first]
        differ = whole[a].view(np.uint8).reshape(len(a), depth) != whole[b].view(np.uint8).reshape(len(a), depth)
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        lcp[first] = np.minimum(shared, np.minimum(length[a], length[b]))
    lcp[head[np.concatenate(([True], group[order[head[1:]]] != group[order[head[1:] - 1]]))]] = -1
    return order, lcp


def repeated_starts(group: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, left: np.ndarray, count: np.ndarray, context: list[bytes]) -> np.ndarray:
    """Of each anchor, which of its strings (columns, by start) also start earlier, in the order of doc, row and start.

    Two strings are equal if they lie at one distance d from their anchors, share d bytes to its left and SPAN - d from it on.
    Sorted to the right and (reversed) to the left, anchors that share that much are neighbours without a smaller lcp between, so
    at each d a string's class is a pair of runs, and all of a class but the first repeat.
    """
    n = len(group)
    out = np.zeros((n, SPAN), bool)
    right = [c[x:] for c, x in zip(context, left.tolist(), strict=True)]
    back = [c[:x][::-1] for c, x in zip(context, left.tolist(), strict=True)]
    order_r, lcp_r = deep_shallow_sort(right, group)
    order_l, lcp_l = deep_shallow_sort(back, group)

    def nearest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        most = np.empty(n, np.int64)
        most[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return most

    low = np.maximum(left - count + 1, SPAN - nearest(order_r, lcp_r))
    high = np.minimum(left, nearest(order_l, lcp_l))
    at = start + left
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, row, doc))] = np.arange(n)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(max(0, low.min(initial=0))), int(high.max(initial=-1)) + 1):
        active = np.flatnonzero((low <= d) & (d <= high))
        if len(active) < 2:
            continue
        run_r[order_r], run_l[order_l] = np.cumsum(lcp_r < SPAN - d), np.cumsum(lcp_l < d)
        key = run_r[active] * (n + 1) + run_l[active]
        by = np.lexsort((rank[active], key))
        own, key = active[by], key[by]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first = np.repeat(own[head], np.diff(np.append(head, len(own))))
        later = own[(row[own] != row[first]) | (doc[own] != doc[first]) | (at[own] != at[first])]
        out[later, left[later] - d] = True
    return out


def _anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """anchors() of all texts, with whole texts' starts; hashes have 48 bits, which is plenty: what they join is compared byte by byte."""
    for batch in text_chunks(batches):
        raw, starts = text_buffers(batch.column("text"))
        pieces = [(raw, starts, 0)]
        if batch.num_rows == 1 and len(raw) > PIECE:
            pieces = [(raw[s : s + PIECE + SPAN - 1], np.array([0, min(PIECE + SPAN - 1, len(raw) - s)]), s) for s in range(0, len(raw), PIECE)]
        for part, cuts, shift in pieces:
            hashed, row, start, left, count = anchors(part, cuts)
            yield batch, (hashed >> np.uint64(16)).view(np.int64), row, start + shift, left, count


def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams that make up more than one of 2 * HOT_SHARE of a task's anchors (and more than TOLD), with their number there; and how many anchors there are (h null)."""
    for_all = [h for _, h, *_ in _anchored(batches)]
    h, n = np.unique(np.concatenate(for_all), return_counts=True) if for_all else (np.zeros(0, np.int64),) * 2
    often = n > max(TOLD, n.sum() / (2 * HOT_SHARE))
    yield pa.RecordBatch.from_arrays([pa.array([*h[often].tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())], ["h", "n"])


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Every gram with more than one of HOT_SHARE of all anchors and more than HOT_GROUP, and at most 2 * HOT_SHARE grams.

    What tasks leave out of a gram's count is less than one of 2 * HOT_SHARE of all anchors (of tasks with few anchors, TOLD each), so
    such a gram's count from the tasks that tell it is more than that too; and no more than 2 * HOT_SHARE grams can have so many.
    A gram that is not found here is only slower: its rows are counted in one task instead of SALTS.
    """
    told = materialize(docs.select("text").mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    total = told.where("h IS NULL").agg(F.sum("n")).first()[0] or 0
    found = told.where(F.col("h").isNotNull() & (F.col("n") * 2 * HOT_SHARE >= total) & (F.col("n") > HOT_GROUP // 2)).limit(2 * HOT_SHARE).collect()
    discard(told)
    return np.sort(np.array([r.h for r in found], np.int64))


def _anchor_rows(hot: np.ndarray):
    """Rows of anchors: key (the gram, salted if it is hot), r, and packed: start, distance, number of strings and whether it is hot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, row, start, left, count in _anchored(batches):
            at = np.searchsorted(hot, h)
            often = np.append(hot, -1)[at] == h
            key = np.where(often, h ^ (start % SALTS + 1) << 48, h)
            packed = start << 15 | left << 8 | (count - 1) << 1 | often
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("r").take(pa.array(row)), pa.array(packed)], ["h", "r", "packed"])

    return run


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, distance to the anchor and number of strings."""
    return packed >> 15, (packed >> 8) & 127, ((packed >> 1) & 127) + 1


def _contexts(single: bool):
    """Rows of the marked anchors with the bytes of their strings; single: a row for each string, with a digest of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            raw, starts = text_buffers(batch.column("text"))
            whole, ids, keys = raw.tobytes(), batch.column("k").to_numpy(), batch.column("r").to_numpy()
            marks = batch.column("marks")
            cuts = marks.offsets.to_numpy()
            flat = marks.flatten()
            h, packed = flat.field("h").to_numpy(), flat.field("packed").to_numpy()
            at = cuts - cuts[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            start, left, count = unpack(packed)
            begin = starts[row] + start
            end = begin + count - 1 + SPAN
            kept = np.flatnonzero(end <= starts[row + 1])  # rows whose r is equal by chance may be shorter
            for part in np.array_split(kept, max(1, len(kept) // 20_000)):
                if single:
                    p = np.repeat(begin[part], count[part]) + np.concatenate([np.arange(c) for c in count[part]]) if len(part) else part
                    rows = np.repeat(row[part], count[part])
                    digest = [xxhash.xxh3_128_digest(whole[x : x + SPAN]) for x in p.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(ids[rows]), pa.array(keys[rows]), pa.array(p - starts[rows])], ["string", "k", "r", "start"])
                else:
                    context = [whole[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(ids[row[part]]), pa.array(keys[row[part]]), pa.array(packed[part]), pa.array(context, pa.binary())], ["h", "k", "r", "packed", "context"])

    return run


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "h"):
        packed, doc, own = (table.column(c).to_numpy() for c in ("packed", "k", "r"))
        start, left, count = unpack(packed)
        found = repeated_starts(table.column("h").to_numpy(), doc, own, start, left, count, table.column("context").to_pylist())
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(own[row]), pa.array(start[row] + a), pa.array(start[row] + b - 1 + SPAN)], ["k", "r", "a", "b"])


def _split_join(rows: DataFrame, groups, key: str) -> DataFrame:
    """rows joined with groups(rows by key). The groups are dealt by one column more than the key, so that the join exchanges both sides, and adaptive execution can split a key with very many rows."""
    return rows.join(groups(rows.groupBy(key, F.substring(key, 1, 1).alias("_dealt"))).drop("_dealt"), key)


def _spans(docs: DataFrame) -> DataFrame:
    """docs (r, k, text, rest) with copy, whether an earlier row has the same text, and spans, the byte ranges to remove (null: none).

    Rows go by k, and rows of one k by r, a hash of id and text; rows with the same id and text are one document. Copies of a whole
    text only need its first: they take no part in the search. Texts are shuffled once, by r; all later reads of them have the
    same columns and reuse that exchange. Two rows whose r is equal by chance are told apart by k.
    """
    slim = docs.select("r", "k", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    # an earlier row: of a smaller k, or of the same k and a smaller r, which rows of one text don't have
    later = _split_join(slim, lambda g: g.agg(F.min("k").alias("first")), "digest").where(F.col("k") > F.col("first"))
    copies = materialize(later.groupBy("r").agg(F.collect_set("k").alias("copy_of")), "copies")
    marked_copies = docs.join(copies.hint("shuffle_hash"), "r", "left").withColumn("copy", F.coalesce(F.array_contains("copy_of", F.col("k")), F.lit(False)))
    own = marked_copies.where("NOT copy").select("r", "k", "text", "rest")
    rows = own.mapInArrow(_anchor_rows(frequent_grams(docs)), "h long, r long, packed long")
    # one shuffle by gram: counts by a window, whose groups are salted, or small, or hold less than one of HOT_SHARE of the rows
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).withColumn("frequent", F.col("packed").bitwiseAND(F.lit(1)) == 1)
    repeated = counted.where("frequent OR n > 1").withColumn("hot", F.col("frequent") | (F.col("n") > HOT_GROUP))
    marks = repeated.groupBy("r", "hot").agg(F.collect_list(F.struct("h", "packed")).alias("marks"))
    marked = lambda hot: own.join(marks.where(F.col("hot") == hot).select("r", "marks").hint("shuffle_hash"), "r")
    contexts = marked(False).mapInArrow(_contexts(single=False), "h long, k long, r long, packed long, context binary")
    found = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_repeats, "k long, r long, a long, b long")
    hot = marked(True).mapInArrow(_contexts(single=True), "string binary, k long, r long, start long")
    again = _split_join(hot, lambda g: g.agg(F.min(F.struct("k", "r", "start")).alias("first")), "string").where(F.struct("k", "r", "start") != F.col("first"))
    again = again.select("k", "r", F.col("start").alias("a"), (F.col("start") + SPAN).alias("b"))
    spans = found.unionByName(again).groupBy("r").agg(F.collect_list(F.struct("k", "a", "b")).alias("spans"))
    return marked_copies.select("r", "k", "text", "rest", "copy").join(spans.hint("shuffle_hash"), "r", "left")


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the ranges [a, b) cover."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[head], b[np.append(head[1:], len(b)) - 1]


def removed_runs(text: bytes, copy: bool, k: int, spans: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    if copy and len(text) >= SPAN:
        return np.array([0]), np.array([len(text)])
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = spans.field("k").to_numpy() == k
    a, b = spans.field("a").to_numpy()[own], spans.field("b").to_numpy()[own]
    return merged(a, b) if len(a) else (a, b)


def _rest(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    ends = [0, *b.tolist()]
    return b"".join(text[x:y] for x, y in zip(ends, [*a.tolist(), len(text)], strict=True))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[tuple[np.ndarray, np.ndarray]]]]:
    for batch in text_chunks(batches):
        raw, starts = text_buffers(batch.column("text"))
        whole, at = raw.tobytes(), starts.tolist()
        texts = [whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        copies, ids, spans = batch.column("copy").to_pylist(), batch.column("k").to_pylist(), batch.column("spans")
        yield batch, texts, [removed_runs(t, c, k, spans[i].values if spans[i].is_valid else None) for i, (t, c, k) in enumerate(zip(texts, copies, ids, strict=True))]


def _keyed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """r, the hash that a row is known by; k, its place in the order; text; and the columns rest, packed, so that no name of theirs meets another."""
    return docs.select(F.xxhash64("doc_id", "text").alias("r"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text).

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or earlier in the same text. Texts are
    UTF-8 bytes, whole; null is empty; texts under 100 bytes lose nothing. A null doc_id comes before all others.
    Different texts of one doc_id (or of none) are documents of their own, in the order of a hash of their text; rows that repeat both
    are one document, whose result each of them has. No rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, runs in _cut(batches):
            n_removed = [int((b - a).sum()) for a, b in runs]
            digests = [hashlib.sha256(_rest(t, a, b)).hexdigest() for t, (a, b) in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest").field("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(a) for a, _ in runs], pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _spans(_keyed(rows, ["doc_id"])).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text (and n_chars, if there, counted anew).

    Which bytes repeat is dedup's rule, with what it says of null and repeated ids and of repeated rows. A character that a run only
    covers in part stays; a text that loses all it had goes, with its row; texts without repeats, null and empty ones
    too, stay as they are. Other columns, whatever their names, are carried along.
    """
    names, types = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    rest = [c for c in names if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, runs in _cut(batches):
            new: list[str | None] = batch.column("text").to_pylist()
            kept = np.ones(len(texts), bool)
            changed = np.zeros(len(texts), bool)
            for i, (t, (a, b)) in enumerate(zip(texts, runs, strict=True)):
                if not len(a):
                    continue
                trail = (np.frombuffer(t, np.uint8) & 0xC0) == 0x80
                edge = np.append(np.flatnonzero(~trail), len(t))
                a = edge[np.searchsorted(edge, a)]
                b = edge[np.searchsorted(edge, b, "right") - 1]
                some = b > a
                new[i] = _rest(t, a[some], b[some]).decode()
                kept[i], changed[i] = bool(new[i]), some.any()
            size = pa.array([len(x) if x is not None else None for x in new], pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(new, batch.column("text").type), pa.array(changed), size, batch.column("rest")], ["text", "changed", "size", "rest"])
            yield out.filter(pa.array(kept))

    keyed = _keyed(docs, rest)
    cut = _spans(keyed).mapInArrow(run, f"text string, changed boolean, size long, rest {keyed.schema['rest'].dataType.simpleString()}")
    field = lambda c: F.col("rest").getField(c)
    counted = {"n_chars": F.when(F.col("changed"), F.col("size").cast(types.get("n_chars", "long"))).otherwise(field("n_chars"))} if "n_chars" in rest else {}
    return cut.select(*[F.col("text") if c == "text" else counted.get(c, field(c)).alias(c) for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of 100 bytes or more that stand earlier too are cut out of the texts, by remove_repeats' rules."""
    return remove_repeats(docs)
