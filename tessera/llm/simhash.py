"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, mix, text_buffers, text_chunks, whole_groups
from tessera.llm.graph import components

#: Bits of the three blocks of a fingerprint: of two differing bits none falls into one of the blocks at least.
BLOCKS = (22, 21, 21)
#: A block's fingerprints beyond this many are dealt anew by pairs of trie nodes ten bits further down.
GROUP_CAP = 65_536
STEP_BITS = 10
#: Node pairs that one pass of the traversal holds at most; the rest waits.
FRONTIER = 200_000
#: Near copies: words of a shingle, least similarity of their sets, differing bits that a candidate may have (a pair at the least similarity has 9.8 of 64 expected).
WORDS, SIMILARITY, NEAR_BITS = 5, 0.8, 16
#: Shingles that the texts of a group have together when their sets go to one task; a larger group is dealt to pairs of parts.
SET_CAP = 4_000_000
#: Bands that near copies enter the trie by, and minima in one: a pair at 0.8 shares none of 16 x 4 once in 4,600.
BANDS, MINIMA = 16, 4


def shingle_hashes(found: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of the word shingles, space-joined; fewer words are one shingle, none give none."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)


def majority(values: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the values."""
    if not len(values):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 65_536):
        part = values[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text: a bit is 1 if it is set in over half the XXH64 hashes (seed 42) of its word shingles."""
    return majority(shingle_hashes(text.lower().split(), shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the string columns of `carry` and fp (the fingerprint's bits as a signed long) of every row; null and empty texts have 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            raw, starts = text_buffers(batch.column("text"))
            whole = raw.tobytes()
            at = starts.tolist()
            values = np.fromiter((fingerprint(whole[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(values.view(np.int64))], ["doc_id", *carry, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} string" for c in carry), "fp long"]))


def trie_blocks(values: np.ndarray, roots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bits: int, budget: int, label: np.ndarray | None = None, forest: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within budget differing bits, block by block, by traversing pairs of binary trie nodes together.

    values: uint64, sorted within each root, so that a trie node is a range of them. roots: the ranges
    (a from, a to, b from, b to) of the node pairs to start from; equal ranges are a node paired with
    itself. Going down a bit, a pair becomes the pairs of its children; a 0 with a 1 costs one differing bit,
    and a pair over the budget is dropped with all below it. Two single leaves are compared at once.
    label (equal labels: joined already): node pairs that hold one label alone are dropped. With forest (values distinct within a
    root) only pairs that join what was apart are returned and labels become those of the joined; else all pairs of two labels are.
    """
    zeros = [np.concatenate(([0], np.cumsum((values >> np.uint64(d)) & np.uint64(1) == 0))) for d in range(bits)]
    apart = (lambda x, y: (x, y)) if label is None else (lambda x, y: joining(label, x, y)) if forest else (lambda x, y: (x[label[x] != label[y]], y[label[x] != label[y]]))
    waiting = [(bits - 1, *roots, np.zeros(len(roots[0]), np.int8))]
    while waiting:
        d, al, ah, bl, bh, cost = waiting.pop()
        same = al == bl
        if label is not None:
            steps = np.concatenate(([0, 0], np.cumsum(label[1:] != label[:-1])))  # steps[i + 1]: changes of label up to i
            some = (ah > al) & (bh > bl)
            la, lb = label[np.minimum(al, len(label) - 1)], label[np.minimum(bl, len(label) - 1)]
            open_ = some & ~((la == lb) & (steps[ah] == steps[np.minimum(al + 1, len(label))]) & (steps[bh] == steps[np.minimum(bl + 1, len(label))]))
            al, ah, bl, bh, cost, same = (v[open_] for v in (al, ah, bl, bh, cost, same))
        kept = (ah > al) & (bh > bl) & ~(same & (ah - al == 1))
        single = kept & (ah - al == 1) & (bh - bl == 1)
        if single.any():
            x, y = al[single], bl[single]
            low = np.uint64((1 << max(d + 1, 0)) - 1)
            near = np.bitwise_count((values[x] ^ values[y]) & low) + cost[single] <= budget
            yield apart(x[near], y[near])
        rest = kept & ~single
        if not rest.any():
            continue
        al, ah, bl, bh, cost, same = (v[rest] for v in (al, ah, bl, bh, cost, same))
        if d < 0:  # leaves of equal values
            for i in range(len(al)):
                rows = max(1, FRONTIER // int(bh[i] - bl[i]))
                for at in range(int(al[i]), int(ah[i]), rows):
                    x, y = (v.ravel() for v in np.meshgrid(np.arange(at, min(at + rows, ah[i])), np.arange(bl[i], bh[i])))
                    less = x < y if same[i] else np.ones_like(x, bool)
                    yield apart(x[less], y[less])
            continue
        z = zeros[d]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        room = cost < budget
        cross = room & ~same
        parts = [(al, am, bl, bm, cost), (am, ah, bm, bh, cost), tuple(v[room] for v in (al, am, bm, bh, cost + 1)), tuple(v[cross] for v in (am, ah, bl, bm, cost + 1))]
        grown = [np.concatenate(v) for v in zip(*parts, strict=True)]
        for at in range(0, len(grown[0]), FRONTIER):
            waiting.append((d - 1, *(v[at : at + FRONTIER] for v in grown)))


def trie_pairs(values: np.ndarray, roots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bits: int, budget: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of trie_blocks at once; with label, those of its forest."""
    none = np.zeros(0, np.int64)
    found = [(none, none), *trie_blocks(values, roots, bits, budget, label)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def joining(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x, y) a forest that joins labels that were apart; label is changed to the joined ones' least."""
    out_x, out_y = [x[:0]], [y[:0]]
    while len(x):
        lx, ly = label[x], label[y]
        apart = np.flatnonzero(lx != ly)
        if not len(apart):
            break
        x, y, high, low = x[apart], y[apart], np.maximum(lx[apart], ly[apart]), np.minimum(lx[apart], ly[apart])
        moved, pick = np.unique(high, return_index=True)  # each label goes to one lower label: no cycle
        out_x.append(x[pick])
        out_y.append(y[pick])
        to = np.arange(len(label))
        to[moved] = low[pick]
        while not np.array_equal(to, deeper := to[to]):
            to = deeper
        label[:] = to[label]
    return np.concatenate(out_x), np.concatenate(out_y)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
    return label


def _links(budget: int):
    bits = 64 - min(BLOCKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "key"):
            key, side = part.column("key").to_numpy(), part.column("side").to_numpy()
            rest, fp = part.column("rest").to_numpy().astype(np.uint64), part.column("fp").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]))))
            ends = np.append(cut[1:], len(key))
            middle = cut + np.add.reduceat((side <= 1).astype(np.int64), cut)
            own = side[cut] == 0
            roots = (cut, np.where(own, ends, middle), np.where(own, cut, middle), ends)
            a, b = trie_pairs(rest, roots, bits, budget)
            label = spanning(len(fp), a, b)
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["u", "v"])

    return run


def _blocks(fp: Column) -> Column:
    """The three (key, rest) of a fingerprint: a block's number and bits, and the other bits, block after block."""
    out, low = [], 0
    for j, width in enumerate(BLOCKS):
        block = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftrightunsigned(fp, low + width) if low + width < 64 else F.lit(0).cast("long")
        below = fp.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        out.append(F.struct((block + F.lit(j << 22)).cast("long").alias("key"), F.shiftleft(above, low).bitwiseOR(below).alias("rest")))
        low += width
    return F.array(*out)


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (u, v) that span all links between distinct fingerprints (fp) of at most budget (2 or less) differing bits.

    Within the budget two fingerprints agree in one of three blocks, so the trie is entered at the nodes of
    each block's bits. A node with more than GROUP_CAP fingerprints is dealt anew: below it, ten bits
    further down, each pair of existing nodes that differ in two bits or fewer becomes a group of its own,
    again while a group is too large. Each task emits a spanning forest, not all pairs of a close group.
    """
    if budget > 2:
        raise ValueError("three blocks carry two differing bits at most")
    rows = distinct.select("fp", F.inline(_blocks(F.col("fp")))).withColumn("side", F.lit(0))
    top = 64 - min(BLOCKS)
    masks = [m for m in range(1 << STEP_BITS) if bin(m).count("1") <= budget]
    for step in range(4):
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_CAP), "hot")
        if sizes.isEmpty():
            break
        own = F.shiftrightunsigned("rest", top - STEP_BITS * (step + 1)).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
        hot = rows.join(sizes.select("key"), "key").withColumn("own", own)
        nodes = materialize(hot.groupBy("key", "side", "own").agg(F.count("*").alias("n")), "nodes")
        left = nodes.where("side < 2").select("key", F.col("side").alias("side_a"), F.col("own").alias("a"), F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in masks])).alias("b"))
        right = nodes.where("side <> 1").select("key", F.col("own").alias("b"))
        pairs = left.join(right, ["key", "b"]).where("side_a = 1 OR a <= b").withColumn("itself", F.expr("side_a = 0 AND a = b"))
        pairs = materialize(pairs.withColumn("to", F.xxhash64("key", "a", "b").bitwiseOR(F.lit(1 << 62))), "pairs")
        first = hot.where("side < 2").join(pairs.withColumnRenamed("a", "own"), ["key", "own"])
        second = hot.where("side <> 1").join(pairs.where("NOT itself").withColumnRenamed("b", "own"), ["key", "own"])
        dealt = first.select("fp", F.col("to").alias("key"), "rest", F.when(F.col("itself"), 0).otherwise(1).alias("side")).unionByName(second.select("fp", F.col("to").alias("key"), "rest", F.lit(2).alias("side")))
        rows = materialize(rows.join(sizes.select("key"), "key", "left_anti").select("fp", "key", "rest", "side").unionByName(dealt), "dealt")
    return rows.repartition("key").sortWithinPartitions("key", "side", "rest").mapInArrow(_links(budget), "u long, v long")


def _rooted(classes: DataFrame, budget: int) -> DataFrame:
    """classes (fp, distinct, and others) with root, the same for all fingerprints that links join."""
    roots = components(links(classes.select("fp"), budget))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row of docs.

    Fingerprints of `shingle`-word shingles link at `budget` or fewer differing bits. Rows of one fingerprint are one
    node of the join, whatever their number. A null doc_id takes no part in the least id and names a component only
    when all of its rows have none. Null, empty and blank texts share fingerprint 0. Repeated rows are all returned.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = _rooted(classes, budget)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def minima(values: np.ndarray) -> np.ndarray:
    """BANDS hashes of MINIMA least values each: the values are dealt to bins by a hash, the least of each bin counts; an empty bin takes the next one's."""
    mixed = np.sort(mix(values ^ np.uint64(0x5DEECE66D)))
    bins = BANDS * MINIMA
    at = np.searchsorted(mixed, np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1))
    full = np.flatnonzero(np.diff(np.append(at, len(mixed))) > 0)
    take = np.searchsorted(full, np.arange(bins))
    least = mixed[at[full[take % len(full)]]] + ((take >= len(full)) * bins + full[take % len(full)] - np.arange(bins)).astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.uint64(0x100000001B3) ** np.arange(MINIMA, dtype=np.uint64)
        return mix((mix(least).reshape(BANDS, MINIMA) * powers).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row: a digest of its words, the SimHash of its shingles, how many different ones it has, and its band hashes."""
    for batch in text_chunks(batches):
        raw, starts = text_buffers(batch.column("text"))
        whole, at = raw.tobytes(), starts.tolist()
        digests, fps, sizes, bands = [], [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            found = whole[a:b].lower().split()
            values = shingle_hashes(found, WORDS)
            digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
            fps.append(majority(values))
            sizes.append(len(np.unique(values)))
            bands.append(minima(values) if len(values) else np.zeros(BANDS, np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], ["doc_id", "row_key", "digest", "fp", "size", "bands"])


def _band_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the texts of a band (key) that the trie join finds, closest first, as forests."""
    for part in whole_groups(batches, "key"):
        key, fp, c = part.column("key").to_numpy(), part.column("fp").to_numpy().view(np.uint64), part.column("c").to_numpy()
        order = np.lexsort((fp, key))
        key, fp, c = key[order], fp[order], c[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = np.flatnonzero(~fresh)
        u, v, band = [c[again]], [c[head[again]]], [key[again]]  # equal fingerprints are one leaf
        key, fp, c = key[fresh], fp[fresh], c[fresh]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(cut[1:], len(key))
        more = ends - cut > 1
        label = np.arange(len(key))
        for budget in (2, 5, 8, 11, NEAR_BITS):
            a, b = trie_pairs(fp, (cut[more], ends[more], cut[more], ends[more]), 64, budget, label)
            u.append(c[a])
            v.append(c[b])
            band.append(key[a])
        u, v, band = np.concatenate(u), np.concatenate(v), np.concatenate(band)
        apart = u != v
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)[apart]), pa.array(np.minimum(u, v)[apart]), pa.array(band[apart])], ["u", "v", "key"])


def shared_counts(ids: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets a[i] and b[i] have in common; ids: the elements of all sets (numbers from 0), end to end; starts: where each set begins, one more at the end."""
    out = np.zeros(len(a), np.int64)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    order = np.argsort(a, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(a[order], prepend=-1)), len(a))
    for lo, hi in itertools.pairwise(cut):
        own = ids[starts[a[order[lo]]] : starts[a[order[lo]] + 1]]
        mark[own] = True
        while lo < hi:
            length = np.cumsum(starts[b[order[lo:hi]] + 1] - starts[b[order[lo:hi]]])
            rows = order[lo : lo + max(1, int(np.searchsorted(length, 10 * FRONTIER, "right")))]
            length = np.append(0, length[: len(rows)])
            at = np.repeat(starts[b[rows]] - length[:-1], np.diff(length)) + np.arange(length[-1])
            out[rows] = np.add.reduceat(mark[ids[at]].astype(np.int64), length[:-1])
            lo += len(rows)
        mark[own] = False
    return out


def _rest_links(least: float):
    """Edges between similar texts of a band within NEAR_BITS bits whose groups (root) are still apart: all such pairs are compared, until they are joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "key", 2_000):
            key, fp = part.column("key").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((fp, key))
            part, key, fp = part.take(pa.array(order)), key[order], fp[order]
            c, sets = part.column("c").to_numpy(), part.column("shingles").to_pylist()
            size = np.array([len(v) // 8 for v in sets], np.int64)
            ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
            starts = np.append(0, np.cumsum(size))
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(cut[1:], len(key))
            label = np.unique(np.stack((np.repeat(cut, ends - cut), part.column("root").to_numpy())), axis=1, return_inverse=True)[1].ravel()
            more = ends - cut > 1
            for a, b in trie_blocks(fp, (cut[more], ends[more], cut[more], ends[more]), 64, NEAR_BITS, label, forest=False):
                fits = np.minimum(size[a], size[b]) >= np.maximum(least * np.maximum(size[a], size[b]), 1)
                a, b = a[fits], b[fits]
                both = shared_counts(ids, starts, a, b)
                near = both >= least * (size[a] + size[b] - both)
                a, b = joining(label, a[near], b[near])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(c[a], c[b])), pa.array(np.minimum(c[a], c[b]))], ["u", "v"])

    return run


def _dealt(rows: DataFrame, cap: int, weight: str = "1") -> DataFrame:
    """rows (key, ...) with the keys of more than cap rows (or sum of weight) replaced: their rows are dealt to parts, and each pair of parts is a group of its own, so no group is unbounded and no pair is lost."""
    sizes = materialize(rows.groupBy("key").agg(F.sum(F.expr(weight)).alias("n")).where(F.col("n") > cap).withColumn("parts", F.ceil(2 * F.col("n") / cap).cast("long")), "hot-bands")
    if sizes.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("c"), F.col("parts"))
    hot = rows.join(sizes.select("key", "parts"), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hot = hot.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(*rows.columns)
    return rows.join(sizes.select("key"), "key", "left_anti").select(*rows.columns).unionByName(hot)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingle hashes of a text, sorted."""
    for batch in text_chunks(batches):
        raw, starts = text_buffers(batch.column("text"))
        whole, at = raw.tobytes(), starts.tolist()
        sets = [np.unique(shingle_hashes(whole[a:b].lower().split(), WORDS)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(sets, pa.binary())], ["c", "shingles"])


def _similar(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x):
                    both = np.sort(np.concatenate((x, y)))
                    shared = int((both[1:] == both[:-1]).sum())
                    kept[i] = shared >= least * (len(x) + len(y) - shared)
            yield batch.select(["u", "v"]).filter(pa.array(kept))

    return run


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row_key (a digest of id and text) and group of each row of docs (doc_id, row_key, text) that is kept: one of each group of near copies.

    Rows with the same words (lower case) are one text. Texts whose WORDS-word shingle sets have a similarity of at least `similarity`
    are linked: texts that share a band of least shingle hashes enter the trie of their SimHash fingerprints together, its self-join
    finds those within NEAR_BITS bits, and the shingles of a pair found are compared exactly. The first pass takes a forest of a band,
    closest first. Where a pair of it turns out not to be similar, texts of the band may be apart that are similar themselves: a second
    pass brings the shingles of such a band together and compares all pairs whose groups are still apart. So no pair of a band is missed through a third text. A group is
    what links reach; of it the row with the least id stays, null last, then the least row_key. Rows without words are one text.
    """
    sketch = docs.select("doc_id", "row_key", "text").mapInArrow(_sketched, "doc_id long, row_key string, digest binary, fp long, size long, bands array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    texts = sketch.groupBy("digest").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")])
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("c"), "first", "fp", "size", "bands"), "near-texts")
    bands = _dealt(texts.select("c", "fp", F.explode("bands").alias("key")), GROUP_CAP)
    edges = materialize(bands.repartition("key").sortWithinPartitions("key").mapInArrow(_band_links, "u long, v long, key long"), "near-edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("c")).distinct().join(texts, "c").select("c", "first.row_key")
    sets = materialize(docs.select("row_key", "text").join(nodes, "row_key").dropDuplicates(["c"]).select("c", "text").mapInArrow(_sets, "c long, shingles binary"), "near-shingles")

    def similar(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("b")), "v")
        return with_sets.select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long")

    joined = materialize(similar(edges.select("u", "v").distinct()), "near-joined")
    roots = components(joined)
    again = materialize(edges.join(joined, ["u", "v"], "left_anti").select("key").distinct(), "near-again")
    if not again.isEmpty():
        named = texts.select("c", "size").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        rows = bands.join(again, "key", "left_semi").join(named, "c").select("key", "fp", "c", "size", "root")
        apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        rows = _dealt(rows.join(apart.select("key"), "key", "left_semi"), SET_CAP, "size")
        rest = rows.join(sets, "c").select("key", "fp", "c", "root", "shingles").repartition("key").sortWithinPartitions("key")
        more = materialize(rest.mapInArrow(_rest_links(similarity), "u long, v long"), "near-more")
        if not more.isEmpty():
            roots = components(joined.unionByName(more))
        discard(more)
    for done in (edges, sets, joined, again):
        discard(done)
    grouped = texts.join(roots.withColumnRenamed("node", "c"), "c", "left").groupBy(F.coalesce("root", "c").alias("group")).agg(F.min("first").alias("first"))
    return grouped.select("first.row_key", "group")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (near_copies) the row with the least id stays, of rows with that id (null last) the one with the least digest.

    A row is known by a digest of its id and text, so rows without an id, or with one id and different texts, stand for themselves.
    Rows without words are one group. Other columns, whatever their names, are carried packed. No rows give no rows.
    """
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("row_key"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = near_copies(keyed.select("doc_id", "row_key", "text"))
    return keyed.select("row_key", "row").join(kept.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
