"""Spelling variants: words one edit apart, by generated edits that Bloom filters let through and an exact join confirms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_sql, discard, materialize, mix, text_chunks

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
#: Different words that a task counts before it hands them on.
MOST_WORDS = 500_000
#: Words longer than this share the last length shard.
LAST_LENGTH = 64
#: A filter has 16 bits a word, in blocks of 64 of which a word sets 5; at most so many bytes of filters go to the tasks at once.
BITS, MARKS, MOST_BYTES = 16, 5, 32 << 20
#: Edits that are hashed in one numpy pass.
MOST_EDITS = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def count_words(docs: DataFrame, least_length: int, least: int, garble: int) -> DataFrame:
    """word and n of the words of docs with least_length code points and least occurrences.

    Words are runs of Latin letters, A-Z in lower case. Where garble divides the crc32 of `<doc_id>:<word>`, the word loses
    the code point at that number modulo its length. A task adds up its words before they are shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in text_chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes know no case but A-Z
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % garble == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
            if len(total) > MOST_WORDS:
                yield handed()
        yield handed()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, end to end, as bytes (all are Latin-1), and where each word starts."""
    held = [w.encode("latin-1") for w in words.to_pylist()]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in held], dtype=np.int64)))
    return np.frombuffer(b"".join(held), np.uint8), starts


def _powers(upto: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(upto, _STEP, np.uint64))))


def _sums(letters: np.ndarray, starts: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of letter times power of its place, from the first letter of the first word on: before every letter, and of every word."""
    size = np.diff(starts)
    place = np.arange(len(letters)) - np.repeat(starts[:-1], size)
    with np.errstate(over="ignore"):
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[place])))
        return running, running[starts[1:]] - running[starts[:-1]]


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, which an edit's hash equals if it gives the word."""
    letters, starts = _letters(words)
    return mix(_sums(letters, starts, _powers(int(np.diff(starts).max()) if len(words) else 0))[1])


class Filter:
    """A blocked Bloom filter: a key's bits are all in one 64-bit block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def marks(keys: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        block = ((keys >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
        bits = np.zeros(len(keys), np.uint64)
        for i in range(MARKS):
            bits |= np.uint64(1) << ((keys >> np.uint64(6 * i)) & np.uint64(63))
        return block.astype(np.int64), bits

    def add(self, keys: np.ndarray) -> None:
        block, bits = self.marks(keys, len(self.blocks))
        np.bitwise_or.at(self.blocks, block, bits)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        block, bits = self.marks(keys, len(self.blocks))
        return (self.blocks[block] & bits) == bits


def edits(letters: np.ndarray, starts: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word, place, letter, key) of the deletions, with letter -1, and of the replacements by a later letter of the alphabet.

    An insertion is the deletion of the longer word, and a replacement by an earlier letter that of the other word, so these give
    every pair of near words once. Of equal letters side by side the first is deleted.
    """
    size = np.diff(starts)
    powers = _powers(int(size.max()) if len(size) else 0)
    running, sums = _sums(letters, starts, powers)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - starts[:-1][word]
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == letters[:-1]) & (word[1:] == word[:-1])
    step = max(1, MOST_EDITS // (len(alphabet) + 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(letters), step):
            to = min(at + step, len(letters))
            kept = np.flatnonzero(~again[at:to]) + at
            before = running[kept] - running[starts[:-1][word[kept]]]
            after = running[starts[1:][word[kept]]] - running[kept + 1]
            yield word[kept], place[kept], np.full(len(kept), -1, np.int16), mix(before + after * _BACK)
            here = np.arange(at, to)
            later = np.searchsorted(alphabet, letters[here], "right")  # the first letter that comes after the one here
            n = len(alphabet) - later
            which = np.repeat(np.arange(len(here)), n)
            new = alphabet[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + later[which]]
            source = here[which]
            changed = (new.astype(np.uint64) - letters[source].astype(np.uint64)) * powers[place[source]]
            yield word[source], place[source], new.astype(np.int16), mix(sums[word[source]] + changed)


def _shard(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LAST_LENGTH)


def _rounds(sizes: dict[int, int], most_bytes: int) -> list[dict[int, tuple[int, int]]]:
    """Filters to send at once: length shard to (part of its keys, parts), each at most most_bytes together. A shard that is too large alone comes in parts, by key."""
    rounds: list[dict[int, tuple[int, int]]] = [{}]
    used = 0
    for length, n in sorted(sizes.items()):
        parts = -(-n * BITS // (8 * most_bytes))
        for part in range(parts):
            cost = n * BITS // 8 // parts
            if rounds[-1] and (used + cost > most_bytes or length in rounds[-1]):
                rounds.append({})
                used = 0
            rounds[-1][length] = part, parts
            used += cost
    return [r for r in rounds if r]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of its shard that a key is in, by bits that the filters don't use for blocks."""
    return (keys >> np.uint64(30)) % np.uint64(parts) if parts > 1 else np.zeros(len(keys), np.uint64)


def _filters(vocabulary: DataFrame, chosen: dict[int, tuple[int, int]], sizes: dict[int, int]) -> dict[int, Filter]:
    """The chosen shards' filters: tasks mark blocks of their words, which are merged block by block."""
    n_blocks = {length: max(1, sizes[length] * BITS // 64 // parts) for length, (_, parts) in chosen.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {length: Filter(np.zeros(n, np.uint64)) for length, n in n_blocks.items()}
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            shard = batch.column("shard").to_numpy()
            for length, (part, parts) in chosen.items():
                mine = keys[shard == length]
                held[length].add(mine[_part(mine, parts) == part])
        for length, filt in held.items():
            at = np.flatnonzero(filt.blocks)
            for cut in range(0, len(at), 65_536):
                some = at[cut : cut + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), length, np.int32)), pa.array(some), pa.array(filt.blocks[some].view(np.int64))], ["shard", "block", "bits"])

    wanted = vocabulary.where(F.col("shard").isin(list(chosen))).select("key", "shard")
    marked = wanted.mapInArrow(run, "shard int, block long, bits long").groupBy("shard", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = {length: Filter(np.zeros(n, np.uint64)) for length, n in n_blocks.items()}
    shard, block, bits = (marked.column(c).to_numpy() for c in ("shard", "block", "bits"))
    for length, filt in out.items():
        mine = shard == length
        filt.blocks[block[mine]] = bits[mine].view(np.uint64)
    return out


def _probes(vocabulary: DataFrame, chosen: dict[int, tuple[int, int]], filters: dict[int, Filter], alphabet: np.ndarray) -> DataFrame:
    """key, source (the key of the edited word), place and letter of all edits that the filters let through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy()
            letters, starts = _letters(batch.column("word"))
            size = np.diff(starts)
            for word, place, letter, keys in edits(letters, starts, alphabet):
                shard = _shard(size[word] - (letter < 0))
                for length, (part, parts) in chosen.items():
                    mine = np.flatnonzero(shard == length)
                    mine = mine[_part(keys[mine], parts) == part] if parts > 1 else mine
                    mine = mine[filters[length].may_have(keys[mine])]
                    if len(mine):
                        arrays = [pa.array(keys[mine].view(np.int64)), pa.array(own[word[mine]]), pa.array(place[mine].astype(np.int32)), pa.array(letter[mine])]
                        yield pa.RecordBatch.from_arrays(arrays, ["key", "source", "place", "letter"])

    from_lengths = {length + more for length in chosen for more in (0, 1)} | ({LAST_LENGTH} if LAST_LENGTH in chosen else set())
    rows = vocabulary.where(F.col("shard").isin([n for n in from_lengths if n <= LAST_LENGTH])).select("key", "word")
    return rows.mapInArrow(run, "key long, source long, place int, letter short")


def near_pairs(vocabulary: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """word, n, other and other_n of all words of vocabulary (word, n, each word once) that are one edit apart, each pair in both directions.

    Edits of every word are hashed and tried against Bloom filters of the vocabulary, one for each length, which go to all tasks
    most_bytes at a time; what passes joins the vocabulary by hash, and is then compared letter by letter. A round reads the words of its lengths only.
    """
    sizes = {r["shard"]: r["count"] for r in vocabulary.groupBy("shard").count().collect()}  # at most LAST_LENGTH rows
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # at most one a Latin letter
    alphabet = np.array(sorted(ord(r.c) for r in letters if r.c), np.uint8)
    words = vocabulary.select("key", "word", "n")
    out = None
    for chosen in _rounds(sizes, most_bytes):
        found = _probes(vocabulary, chosen, _filters(vocabulary, chosen, sizes), alphabet)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return words.limit(0).select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    hits = out.join(words.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key").drop("key")
    both = hits.join(words.withColumnRenamed("key", "source"), "source")
    head, tail = F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")
    edited = F.concat(head, F.when(F.col("letter") >= 0, F.expr("char(letter)")).otherwise(""), tail)
    pairs = materialize(both.where(edited == F.col("other")).select("word", "n", "other", "other_n"), "near-words")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(links: DataFrame) -> DataFrame:
    """word, form and root, the last word that forms lead to, of links (word, form): each round doubles the steps that are followed. Counts grow tenfold with each form, so few rounds do."""
    at = materialize(links.select("word", "form", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(at.join(onward, "root", "left").select("word", "form", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(at)
        at = after.drop("moved")
        at._tessera_path = after._tessera_path
        if not after.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, least_length: int = 7, least: int = 2, garble: int = 31, ratio: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text) with least_length code points and least occurrences.

    A word's form is the word one edit away with the most occurrences (of equals the first in code-point order), if it has
    ratio times the word's; its root is where forms lead in the end, the word itself without one. A null or empty text has no words; a null id counts as
    an empty one in the checksum of count_words; rows that repeat count each; other columns are left out.
    """
    counted = count_words(docs, least_length, least, garble)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            shard = _shard(np.array([len(w) for w in words.to_pylist()], np.int32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([words, batch.column("n"), pa.array(word_keys(words).view(np.int64)), pa.array(shard)], ["word", "n", "key", "shard"])

    vocabulary = materialize(counted.mapInArrow(run, "word string, n long, key long, shard int"), "vocabulary")
    pairs = near_pairs(vocabulary, most_bytes)
    first = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = materialize(pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), first), "nearest")
    linked = near.where(-F.col("best.less") >= ratio * F.col("n"))
    found = roots(linked.select("word", F.col("best.other").alias("form")))
    formed = linked.select("word", (-F.col("best.less")).alias("form_n")).join(found, "word")
    out = vocabulary.select("word", "n").join(near.select("word", "n_near"), "word", "left").join(formed, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY doc_id, run
),
sums AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM runs),
results AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
deleted AS (SELECT DISTINCT s.word, s.n, v.word AS other, v.n AS other_n FROM shorter s JOIN vocabulary v ON s.d = v.word),
near AS (
    SELECT * FROM deleted UNION ALL SELECT other, other_n, word, n FROM deleted
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
),
best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS nth FROM near),
formed AS (SELECT word, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best WHERE nth = 1),
followed AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT f.word, n.form FROM followed f JOIN formed n ON n.word = f.root WHERE n.form IS NOT NULL),
ends AS (SELECT f.word, f.root FROM followed f LEFT JOIN formed n ON n.word = f.root WHERE n.form IS NULL)
SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM vocabulary v LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)
"""
