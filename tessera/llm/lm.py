"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax, beside an add-0.1 unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_buffers, text_chunks
from tessera.llm.learn import remainder

#: The end of a text, as a token that no word can be.
END = b"\n"
#: Words with a place of their own in the classes: one for so many tokens, within these bounds (a task holds them). The counts of all others are joined.
HEAD_TOKENS, LEAST_HEAD, MOST_HEAD = 512, 1 << 14, 1 << 18
#: Branches of a class; endings of two bytes that the other words are told apart by.
FAN, ENDINGS = 16, 255
#: Hash buckets of features with a class: one for so many tokens, a power of two within these bounds (a task holds their weights).
BUCKET_TOKENS, LEAST_BUCKETS, MOST_BUCKETS = 512, 1 << 15, 1 << 21
#: Levels of classes that all features speak to; below, the word before alone does.
RICH = 2
#: Tokens a gradient step sees.
BATCH = 16_384
ROUNDS, RATE, SMOOTH = 2, 0.5, 0.1
#: Distinct words that a counting task holds before it sends them on; buckets that travel together; tasks whose blocks are averaged at a time.
COUNTER, BLOCK, MERGED = 400_000, 1_024, 64
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def tokens(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all rows, end to end, and how many each row has: lower-case words and one END."""
    raw, starts = text_buffers(batch.column("text"))
    whole, at = raw.tobytes().lower(), starts.tolist()
    found: list[bytes] = []
    sizes = np.empty(batch.num_rows, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        before = len(found)
        found += whole[a:b].split()
        found.append(END)
        sizes[i] = len(found) - before
    return found, sizes


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, n over all rows of docs: tasks count what they read and send it on whenever they hold COUNTER words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in text_chunks(batches):
            held.update(tokens(batch)[0])
            if len(held) >= COUNTER:
                yield sent()
        if held:
            yield sent()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Items with a place in the nested classes: the head words, and for each ending all other words that have it (known and unknown), the last for any other ending."""

    words: list[bytes]
    count: np.ndarray
    endings: dict[bytes, int]
    total: int
    distinct: int
    rest: np.ndarray  # of each ending: what its other words weigh together
    levels: list[tuple[np.ndarray, np.ndarray]]  # of each level: the class that an item is in (-1: it has its place above) and its branch there
    prior: np.ndarray  # of each class: log shares of its branches by count


def _nested(mass: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Levels and priors of classes over items in order: each class is a range of items, cut into FAN ranges of about the same mass, until a range is one item."""
    n = len(mass)
    before = np.concatenate(([0.0], np.cumsum(mass)))
    open_, levels, prior = [(0, n)] if n > 1 else [], [], []
    while open_:
        cls, branch, below = np.full(n, -1, np.int32), np.zeros(n, np.int8), []
        for lo, hi in open_:
            if hi - lo <= FAN:
                cut = np.arange(lo, hi + 1)
            else:
                goal = before[lo] + (before[hi] - before[lo]) * np.arange(1, FAN) / FAN
                inner = np.searchsorted(before[lo : hi + 1], goal) + lo
                # each cut leaves an item at least for every branch before and after it
                inner = np.clip(np.maximum.accumulate(inner - np.arange(FAN - 1)) + np.arange(FAN - 1), lo + np.arange(1, FAN), hi - FAN + np.arange(1, FAN))
                cut = np.concatenate(([lo], inner, [hi]))
            number, size = len(prior), np.diff(cut)
            cls[lo:hi], branch[lo:hi] = number, np.repeat(np.arange(len(size)), size)
            share = np.full(FAN, -1e4)
            share[: len(size)] = np.log(np.diff(before[cut]) / (before[hi] - before[lo]))
            prior.append(share)
            below += [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a > 1]
        levels.append((cls, branch))
        open_ = below
    return levels, np.array(prior, np.float32).reshape(-1, FAN)


def vocabulary(counts: DataFrame, head: int | None = None) -> Vocabulary:
    """The vocabulary of a count table. head: how many words get a place of their own at most; by default it grows with the corpus up to MOST_HEAD.

    Words of one ending stand together, so classes are ranges of endings, and ranges of words of one ending below.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = head or int(min(MOST_HEAD, max(LEAST_HEAD, total // HEAD_TOKENS)))
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    held, least = 0, None
    for s, n in sizes:
        if held + n > head:
            break
        held, least = held + n, s
    top = (counts.where(step >= least) if least is not None else counts.limit(0)).toArrow()
    rows = sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True), key=lambda r: (r[0][-2:], r[0]))
    ends = counts.groupBy(F.substring("word", -2, 2).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.desc("n"), "e")
    named = ends.limit(ENDINGS).collect()
    endings = {bytes(r.e): i for i, r in enumerate(named)}
    others = len(endings)
    mass, kinds = np.array([r.n for r in named] + [0], float), np.array([r.v for r in named] + [0], float)
    mass[others], kinds[others] = total - mass.sum(), distinct - kinds.sum()
    words, count = [w for w, _ in rows], np.array([n for _, n in rows], np.int64)
    of = np.array([endings.get(w[-2:], others) for w in words], np.int64)
    rest = mass - np.bincount(of, count, others + 1) + SMOOTH * (kinds - np.bincount(of, minlength=others + 1) + 1)
    # items in the order of their endings, an ending's other words after its own; where they stand is undone below
    name = [(w[-2:], w) for w in words] + [(e, b"\xff\xff") for e in endings] + [(b"\xff\xff", b"\xff\xff")]
    order = np.array(sorted(range(len(name)), key=name.__getitem__))
    weight = np.concatenate((count + SMOOTH, rest))
    levels, prior = _nested(weight[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Vocabulary(words, count, endings, int(total), int(distinct), rest, [(cls[back], branch[back]) for cls, branch in levels], prior)


class Encoder:
    """Texts as the numbers that the model works on."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.index = {w: i for i, w in enumerate(v.words)}

    def encode(self, found: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Head index (-1: another word) and item of each token, and its hashed features: the word before, the two before, and the one before that (a skip)."""
        head, endings = len(self.v.words), self.v.endings
        ids = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        other = np.flatnonzero(ids < 0)
        item = ids.copy()
        item[other] = np.fromiter((endings.get(found[i][-2:], len(endings)) for i in other.tolist()), np.int64, len(other)) + head
        start = head + len(endings) + 1
        first = np.cumsum(sizes) - sizes
        one = np.empty_like(item)
        one[1:], one[first] = item[:-1], start
        two = np.empty_like(item)
        two[2:] = item[:-2]
        two[first] = start
        second = first[sizes > 1] + 1
        two[second] = start
        with np.errstate(over="ignore"):
            a, b = one.astype(np.uint64) + np.uint64(1), two.astype(np.uint64) + np.uint64(1)
            keys = [a * _ODD[0], (a * _ODD[1] + b) * _ODD[2], b * _ODD[3]]
            return ids, item, [k ^ (k >> np.uint64(31)) for k in keys]


def n_buckets(tokens: int) -> int:
    """Buckets for a corpus of so many tokens."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, int(tokens // BUCKET_TOKENS)).bit_length()))


def decisions(v: Vocabulary, item: np.ndarray, keys: list[np.ndarray], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Level by level: which tokens still choose, their class, the branch they take, and the bucket of each feature that speaks to the class."""
    shift = np.uint64(65 - buckets.bit_length())
    at = np.arange(len(item))
    for depth, (cls, branch) in enumerate(v.levels):
        own = cls.take(item[at])
        inside = own >= 0
        if not inside.all():
            at, own = at[inside], own[inside]
        if not len(at):
            return
        with np.errstate(over="ignore"):
            salt = (own.astype(np.uint64) + np.uint64(1)) * _ODD[3]
            found = [(((k[at] ^ salt) * _ODD[0]) >> shift).astype(np.int64) for k in (keys if depth < RICH else keys[:1])]
        yield at, own, branch.take(item[at]).astype(np.int64), found


_ONES = np.ones(FAN, np.float32)


def _softmax(table: np.ndarray, buckets: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """Probabilities of the branches: the prior's log shares plus the features' weights."""
    z = table.take(buckets[0], axis=0)
    for b in buckets[1:]:
        z += table.take(b, axis=0)
    z += prior
    with np.errstate(over="ignore"):
        p = np.exp(z)
        total = p @ _ONES
    if not np.isfinite(total).all():  # a weight that ran away: shift by each row's largest
        p = np.exp(z - z.max(axis=1, keepdims=True))
        total = p @ _ONES
    p *= (1 / np.maximum(total, 1e-30))[:, None]
    return p


def _summed(rows: np.ndarray, of: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of rows (by number, in `of`) over runs. Most runs are of one row, which is its own sum; the others are differences of running sums."""
    out = rows.take(of.take(head), axis=0)
    many = np.flatnonzero(size > 1)
    if len(many):
        n = size[many]
        ends = np.cumsum(n)
        inside = np.repeat(head[many] - (ends - n), n) + np.arange(ends[-1])
        running = np.cumsum(rows.take(of.take(inside), axis=0), axis=0, dtype=np.float64).take(ends - 1, axis=0)
        running[1:] -= running[:-1].copy()
        out[many] = running
    return out


class Scorer:
    """log10 probabilities of tokens under the model."""

    def __init__(self, v: Vocabulary, table: np.ndarray):
        self.v, self.table, self.encoder = v, table.astype(np.float32), Encoder(v)

    def token_scores(self, item: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Of the token's item: the product of its branches' probabilities, class after class."""
        out = np.zeros(len(item))
        for start in range(0, len(item), BATCH):
            s = slice(start, start + BATCH)
            part = out[s]
            for at, cls, branch, buckets in decisions(self.v, item[s], [k[s] for k in keys], len(self.table)):
                p = _softmax(self.table, buckets, self.v.prior.take(cls, axis=0))[np.arange(len(at)), branch]
                part[at] += np.log10(np.maximum(p, 1e-30), dtype=np.float64)
        return out


class Trainer:
    """Gradient steps from given weights; steps are scaled by each bucket's own gradients so far."""

    def __init__(self, v: Vocabulary, table: np.ndarray):
        self.v, self.encoder = v, Encoder(v)
        self.table = table.astype(np.float32)
        self.seen = np.zeros(len(table), np.float32)
        self.touched = np.zeros(len(table), np.float32)

    def gradient(self, item: np.ndarray, keys: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: buckets, the gradient of -log p (natural) by their weights, and how many tokens touched each."""
        for at, cls, branch, buckets in decisions(self.v, item, keys, len(self.table)):
            slope = _softmax(self.table, buckets, self.v.prior.take(cls, axis=0))
            slope[np.arange(len(at)), branch] -= 1
            for b in buckets:
                packed = np.sort(b << 20 | np.arange(len(b)))  # bucket and row in one number sort faster than an argsort
                found = packed >> 20
                head = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                size = np.diff(np.append(head, len(b)))
                yield found.take(head), _summed(slope, packed & (1 << 20) - 1, head, size), size

    def step(self, item: np.ndarray, keys: list[np.ndarray]) -> None:
        for own, gradient, size in self.gradient(item, keys):
            squares = self.seen.take(own) + np.einsum("ij,ij->i", gradient, gradient) / FAN
            self.seen[own] = squares
            self.touched[own] += size
            gradient *= (-RATE / np.sqrt(squares + 1.0))[:, None]
            gradient += self.table.take(own, axis=0)
            self.table[own] = gradient

    def read(self, batch: pa.RecordBatch) -> None:
        _, item, keys = self.encoder.encode(*tokens(batch))
        for at in range(0, len(item), BATCH):
            s = slice(at, at + BATCH)
            self.step(item[s], [k[s] for k in keys])

    def blocks(self, task: int) -> Iterator[pa.RecordBatch]:
        """What this task learned: blocks of buckets, their weights in half precision, with how many tokens touched each."""
        for at in range(0, len(self.table), BLOCK):
            touched = self.touched[at : at + BLOCK]
            if touched.any():
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([at], pa.int32()), pa.array([self.table[at : at + BLOCK].astype(np.float16).tobytes()]), pa.array([touched.tobytes()])], ["task", "at", "weights", "touched"])


_LEARNED = "task long, at int, weights binary, touched binary"


def _mean(table: pa.Table) -> pa.Table:
    """One block of some tasks, each bucket the mean of the tasks' weights by how many tokens touched it there; the task is the group's number."""
    total, mass = 0.0, 0.0
    for w, n in zip(table.column("weights"), table.column("touched"), strict=True):
        seen = np.frombuffer(n.as_buffer(), np.float32)
        total = total + np.frombuffer(w.as_buffer(), np.float16).reshape(len(seen), FAN).astype(np.float64) * seen[:, None]
        mass = mass + seen.astype(np.float64)
    mean = (total / np.maximum(mass, 1)[:, None]).astype(np.float16)
    return pa.table(
        {"task": pa.array([table.column("task")[0].as_py() // MERGED], pa.int64()), "at": table.column("at")[:1].cast(pa.int32()), "weights": pa.array([mean.tobytes()], pa.binary()), "touched": pa.array([mass.astype(np.float32).tobytes()], pa.binary())}
    )


def averaged(learned: DataFrame, tasks: int) -> DataFrame:
    """Blocks of all tasks as one of each, by a tree: MERGED tasks at a time, so no group holds more blocks than that."""
    while True:
        learned = learned.groupBy("at", F.floor(F.col("task") / MERGED).alias("group")).applyInArrow(lambda t: _mean(t.select(["task", "at", "weights", "touched"])), _LEARNED)
        tasks = -(-tasks // MERGED)
        if tasks <= 1:
            return learned


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (buckets x branches, half precision) after as many rounds of distributed gradient updates, each over its own share of the documents, together all of them once.

    In a round every task, one for each input split, starts from the same weights, makes its steps over the texts of its split
    and sends what it changed; blocks of buckets are averaged by touch in a tree. The averaged model is what the driver hands to the next round.
    """
    table = np.zeros((n_buckets(v.total), FAN), np.float16)
    tasks = 1 + (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)
    for r in range(rounds):

        def run(batches: Iterable[pa.RecordBatch], start=table) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(v, start)
            for batch in text_chunks(batches):
                trainer.read(batch)
            yield from trainer.blocks(TaskContext.get().partitionId())

        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        rows = averaged(own.mapInArrow(run, _LEARNED), tasks).toArrow()
        table = table.copy()
        for at, weights, touched in zip(*(rows.column(c) for c in ("at", "weights", "touched")), strict=True):
            seen = np.frombuffer(touched.as_buffer(), np.float32) > 0
            table[at.as_py() : at.as_py() + BLOCK][seen] = np.frombuffer(weights.as_buffer(), np.float16).reshape(-1, FAN)[seen]
    return table


def score_texts(docs: DataFrame, head: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Tokens are the lower-case words of the whole text and one end; a null or empty text is one end. Rows whose crc32(doc_id) mod 10
    is 0 are held out, as are those without an id; counts and weights come from all others. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))). score is the model's log10 probability: branch after branch through nested classes,
    each given hashed n-gram and skip features, down to a word of the head, or to all others of an ending; of these a word has its share
    by count, so words known and unknown have probabilities that sum to 1. Head, classes and buckets grow with the training tokens up to
    what a task can hold; counts of words outside the head are joined by word, not looked up.
    Repeated rows are scored each for itself. Without training rows every weight is 0.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(True)))
    learned = slim.where(~F.col("held_out"))
    counts = materialize(count_tokens(learned), "counts")
    v = vocabulary(counts, head)
    w = train(learned, v, rounds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(v, w)
        log_count, log_rest = np.append(np.log10(v.count + SMOOTH), 0.0), np.log10(v.rest)
        for batch in text_chunks(batches):
            found, sizes = tokens(batch)
            ids, item, keys = scorer.encoder.encode(found, sizes)
            first = np.cumsum(sizes) - sizes
            rest = item - len(v.words)
            share = np.where(rest >= 0, -log_rest[np.maximum(rest, 0)], 0.0)  # a word outside the head still lacks its count
            score = np.add.reduceat(scorer.token_scores(item, keys) + share, first)
            base, known = np.add.reduceat(log_count[ids], first), np.add.reduceat((ids >= 0).astype(np.int64), first)
            row = np.repeat(np.arange(len(sizes)), sizes)
            other = np.flatnonzero(ids < 0)
            pairs = Counter(zip(row[other].tolist(), [found[i] for i in other.tolist()], strict=True))
            cut = np.searchsorted(np.fromiter((r for r, _ in pairs), np.int64, len(pairs)), np.arange(len(sizes) + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array([word for _, word in pairs], pa.binary()), pa.array(pairs.values(), pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), rare)],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "part", "rare"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double, rare array<struct<word: binary, times: long>>"
    parts = materialize(slim.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "scored")
    rare = parts.select("row", F.inline("rare")).join(counts, "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"))
    scale = float(np.log10(v.total + SMOOTH * (v.distinct + 1)))
    return parts.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
