"""Approximate nearest neighbours: probed lists scanned adaptively by blocks of rotated dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Rows that the lists' centres are fitted on at most, of them a list, and centres at most.
FIT_ROWS, FIT_PER_LIST, MOST_LISTS = 65_536, 16, 8_192
#: The probes are as many lists as hold this share of the true neighbours of TRIED fitted rows among the fitted rows; how many at least.
TARGET, TRIED, LEAST_PROBED = 0.95, 512, 16
#: Candidates and queries that one task group holds: short lists share a group, larger ones are dealt to several.
CANDIDATES, QUERIES = 4_096, 1_024
#: Dimensions of a block, and the deviations of a partial distance that abandon a candidate.
BLOCK, DEVIATIONS = 16, 2.1


def usable(vectors: DataFrame, wanted: Column) -> DataFrame:
    """vec_id, embedding and whether they are asked for, of the rows that take part: no null, zero or non-finite vector, none of another length than most have."""
    whole = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), wanted.alias("asked")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(whole)
    return kept


@dataclass
class Index:
    """Centres of the lists and the rotation, in the space where the nearest by distance has the largest inner product.

    With M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0): |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
    """

    dim: int
    most: float
    centres: np.ndarray
    rotation: np.ndarray
    probes: int = LEAST_PROBED

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.most**2 - (x**2).sum(axis=1), 0))[:, None]), axis=1)

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        lifted = np.concatenate((x, np.zeros((len(x), 1))), axis=1) if query else self.lifted(x)
        return lifted @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1)[None, :] - 2 * rotated @ self.centres.T


def _probes_for(index: Index, x: np.ndarray, own: np.ndarray, k: int) -> int:
    """How many lists hold TARGET of the k nearest fitted rows (x, in the lists `own`) of TRIED of them. All rows lie closer together than the sample, so that many hold no less of theirs."""
    tried = x[:TRIED]
    score = tried @ x.T
    score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(index.centres)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    far = index.distances(index.rotated(tried, query=True))
    reached = np.take_along_axis(far, own[near], axis=1)
    needed = np.sort(np.concatenate([np.searchsorted(np.sort(f), r) for f, r in zip(far, reached, strict=True)])) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)])


def fit(classes: DataFrame, lists: int | None = None, rounds: int = 6, k: int = 20) -> Index | None:
    """An index fitted on at most FIT_ROWS rows, the first in the order of a hash of their ids; None without rows. The largest norm is of all rows."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, most = classes.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    lists = min(lists or int(max(1, round(4 * n**0.5))), MOST_LISTS, n)
    rows = classes.orderBy(F.xxhash64(F.lit("fit"), "cid"), "cid").select("embedding").limit(min(FIT_ROWS, max(4_096, FIT_PER_LIST * lists))).toArrow()
    x = np.array(rows.column("embedding").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    dim, rng = x.shape[1], np.random.default_rng(20)
    rotation, upper = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))
    index = Index(dim, float(most) * (1 + 1e-12), np.zeros((0, dim + 1)), rotation * np.sign(np.diag(upper)))
    lists = min(lists, len(x))
    y = index.rotated(x)
    index.centres = y[rng.permutation(len(y))[:lists]].copy()
    nearest = lambda: np.concatenate([index.distances(y[at : at + 4096]).argmin(axis=1) for at in range(0, len(y), 4096)])
    for _ in range(rounds):
        own = nearest()
        order = np.argsort(own, kind="stable")
        held, head = np.unique(own[order], return_index=True)
        index.centres[held] = np.add.reduceat(y[order], head, axis=0) / np.diff(np.append(head, len(y)))[:, None]
    index.probes = min(lists, max(LEAST_PROBED, _probes_for(index, x, nearest(), k)))
    return index


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _near(index: Index, part: pa.RecordBatch, query: bool, many: int) -> np.ndarray:
    d = index.distances(index.rotated(_matrix(part.column("embedding"), index.dim), query))
    return np.argpartition(d, many - 1, axis=1)[:, :many] if many < d.shape[1] else np.argsort(d, axis=1)


def _listed(index: Index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column("embedding"), pa.array(_near(index, part, False, 1)[:, 0].astype(np.int32))], ["id", "key", "embedding", "list"])

    return run


def _probed(index: Index, probes: int, together: int):
    """Of each query the groups of lists that it probes, with those lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                near = np.sort(_near(index, part, True, probes), axis=1)
                flat, row = near.ravel(), np.repeat(np.arange(len(near)), near.shape[1])
                group = flat // together
                head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (row[1:] != row[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
                outer = np.searchsorted(row[head], np.arange(len(near) + 1)).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(outer), pa.StructArray.from_arrays([pa.array(group[head].astype(np.int32)), lists], ["grp", "lists"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column("embedding"), groups], ["id", "embedding", "groups"])

    return run


def adaptive_scan(q: np.ndarray, y: np.ndarray, held: np.ndarray, probed: np.ndarray, most: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) index pairs that may be among the `most` nearest of the query: those that no test has abandoned.

    The rows of y, rotated at random like those of q, stand list by list: held is each one's list, ascending, and probed says
    for query and list whether the one probes the other. After d of D dimensions the whole squared distance is about D / d
    times the part. A candidate whose part exceeds that share of the most-th nearest distance so far, by DEVIATIONS / sqrt(d)
    more, is abandoned; the rest goes on to the next block. The first block is a matrix product of a list's queries and
    candidates. Each query starts with the list `first` (its nearest), for a distance that the others are held against.
    """
    size, n = y.shape[1], len(q)
    best = np.full((n, most), np.inf)
    cuts = [(at, min(at + BLOCK, size)) for at in range(0, size, BLOCK)]
    own_q, own_y = (q[:, : cuts[0][1]], y[:, : cuts[0][1]])
    norm_q, norm_y = np.einsum("ij,ij->i", own_q, own_q), np.einsum("ij,ij->i", own_y, own_y)
    edges = np.searchsorted(held, np.arange(probed.shape[1] + 1))
    lists = np.flatnonzero(np.diff(edges))
    begun = np.zeros_like(probed)
    if first is not None:
        begun[np.arange(n), first] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for now in (probed & begun, probed & ~begun):
        for k in lists.tolist():
            asking = np.flatnonzero(now[:, k])
            if not len(asking):
                continue
            a, b = edges[k], edges[k + 1]
            limit = best[asking].max(axis=1)
            part = norm_q[asking, None] + norm_y[None, a:b] - 2 * own_q[asking] @ own_y[a:b].T
            row, at = np.nonzero(part <= _bound(limit, cuts[0][1], size)[:, None])
            part = part[row, at]
            for lo, hi in cuts[1:]:
                gap = y[a + at, lo:hi] - q[asking[row], lo:hi]
                part = part + np.einsum("ij,ij->i", gap, gap)
                kept = part <= _bound(limit, hi, size)[row]
                row, at, part = row[kept], at[kept], part[kept]
            if not len(row):
                continue
            out.append((asking[row], a + at, part))
            order = np.lexsort((part, row))
            row, part = row[order], part[order]
            head = np.searchsorted(row, np.arange(len(asking)))
            rank = np.arange(len(row)) - head[row]
            near = rank < most
            grown = np.full((len(asking), most), np.inf)
            grown[row[near], rank[near]] = part[near]
            hit = np.flatnonzero(grown[:, 0] < np.inf)
            best[asking[hit]] = np.partition(np.concatenate((best[asking[hit]], grown[hit]), axis=1), most - 1, axis=1)[:, :most]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, at, part = (np.concatenate(v) for v in zip(*out, strict=True))
    kept = part <= _bound(best.max(axis=1), size, size)[row]
    return row[kept], at[kept]


def _bound(limit: np.ndarray, d: int, size: int) -> np.ndarray:
    """The largest part over d of size dimensions that may still end within the limit."""
    share = 1.0 if d == size else d / size * (1 + DEVIATIONS / np.sqrt(d)) ** 2
    return limit * share * (1 + 1e-9)


def _scan(index: Index, most: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        cut, qid, cid, key, score = np.zeros(1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if candidates.num_rows and queries.num_rows:
            order = np.lexsort((candidates.column("id").to_numpy(), candidates.column("list").to_numpy()))
            cid, key, x = candidates.column("id").to_numpy()[order], candidates.column("key").to_numpy()[order], _matrix(candidates.column("embedding"), index.dim)[order]
            numbers, held = np.unique(candidates.column("list").to_numpy()[order], return_inverse=True)
            qid, q = queries.column("id").to_numpy(), _matrix(queries.column("embedding"), index.dim)
            turned = index.rotated(q, query=True)
            lists = queries.column("lists").combine_chunks()
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(qid)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(numbers, flat), len(numbers) - 1)
            there = numbers[at] == flat  # a list may have no candidates in this part of its group
            probed = np.zeros((len(qid), len(numbers)), bool)
            probed[row[there], at[there]] = True
            centres = index.centres[numbers]
            far = (centres**2).sum(axis=1)[None, :] - 2 * turned @ centres.T
            first = np.where(probed, far, np.inf).argmin(axis=1)
            row, at = adaptive_scan(turned, index.rotated(x), held, probed, most, first)
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[at[i : i + 65_536]], q[row[i : i + 65_536]]) for i in range(0, len(row), 65_536))])
            order = np.lexsort((cid[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, cid, key, score = row[near], cid[at[near]], key[at[near]], score[near]
            asked, head = np.unique(row, return_index=True)
            qid, cut = qid[asked], np.append(head, len(row)).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(cid, pa.int64()), pa.array(key, pa.int64())], ["s", "cid", "key"])
        return pa.table({"qid": pa.array(qid, pa.int64()), "found": pa.ListArray.from_arrays(pa.array(cut), found)})

    return run


def _probe(index: Index, listed: DataFrame, n: int, queries: DataFrame, probes: int, most: int) -> DataFrame:
    """qid and its `most` best (cid, score) in the lists that it probes. Lists are put together, and what they hold is dealt, to groups of bounded size."""
    together = max(1, CANDIDATES * len(index.centres) // max(n, 1))
    probed = queries.select("qid", "embedding").mapInArrow(_probed(index, probes, together), "id long, embedding array<double>, groups array<struct<grp: int, lists: array<int>>>").select("id", "embedding", F.inline("groups"))
    placed = listed.withColumn("grp", F.floor(F.col("list") / together).cast("int"))
    sizes = placed.groupBy("grp").agg(F.count("*").alias("held"))
    asked = probed.groupBy("grp").agg(F.count("*").alias("asked"))
    deal = materialize(sizes.join(asked, "grp").select("grp", F.ceil(F.col("held") / CANDIDATES).cast("int").alias("cs"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("qs")), "deal")
    own = lambda part: F.pmod(F.xxhash64("id"), F.col(part))
    every = lambda part: F.explode(F.sequence(F.lit(0).cast("long"), F.col(part).cast("long") - 1))
    held = placed.join(deal, "grp").select("grp", "id", "key", "embedding", "list", own("cs").alias("c"), every("qs").alias("q")).groupBy("grp", "c", "q")
    wanted = probed.join(deal, "grp").select("grp", "id", "embedding", "lists", own("qs").alias("q"), every("cs").alias("c")).groupBy("grp", "c", "q")
    found = held.cogroup(wanted).applyInArrow(_scan(index, most), "qid long, found array<struct<s: double, cid: long, key: long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most)
    return found.groupBy("qid").agg(best.alias("best"))


def search(vectors: DataFrame, wanted: Column, k: int = 20, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row of vectors (vec_id, embedding) that `wanted` holds for.

    Nearest is the largest inner product of the original vectors in double precision, ties to the smaller vec_id; a query itself
    is no candidate, all other rows are. Vectors null, zero, of another length than most, or with null or non-finite components take no
    part, nor do rows without an id. Equal vectors are one candidate and one query, of which the k + 1 smallest ids are kept, which is
    all that any answer can name, so a vector that very many rows share costs as much as one. A query probes as many lists as the
    fitted sample needs for TARGET of its own neighbours; queries that find fewer than k in them are sought in all lists. Rows that repeat a vec_id are distinct candidates and
    one query, by the least of their vectors. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = usable(vectors, wanted)
    common = valid.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return empty
    valid = valid.where(F.size("embedding") == common["size"])
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = materialize(valid.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("embedding", "ids", F.col("ids")[0].alias("cid"), F.monotonically_increasing_id().alias("key")), "classes")
    asking = valid.where("asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = materialize(asking.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "queries")
    index = fit(classes, lists, k=k)
    listed = materialize(classes.select("cid", "key", "embedding").mapInArrow(_listed(index), "id long, key long, embedding array<double>, list int"), "lists")
    n = listed.count()
    found = materialize(_probe(index, listed, n, queries, index.probes, k + 1), "found")
    if index.probes < len(index.centres):
        short = materialize(queries.join(found.where(F.size("best") >= min(k + 1, n)).select("qid"), "qid", "left_anti"), "short")
        if not short.isEmpty():
            more = _probe(index, listed, n, short, len(index.centres), k + 1)
            found = found.join(short.select("qid"), "qid", "left_anti").unionByName(more)
    rows = found.select("qid", F.inline("best")).join(classes.select("key", "ids"), "key").select("qid", F.explode("ids").alias("vec_id"), (-F.col("s")).alias("score"))
    asked = asking.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), "qid")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return asked.join(rows, "qid").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
