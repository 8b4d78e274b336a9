"""Near words against all pairs, and the query against its twin in SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling
from tessera.llm.queries import op12_spelling


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs, least_length=7, least=2, garble=31, ratio=10):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % garble == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_twin(spark, sf):
    sf = f"/root/testdata/{sf}"
    compare.check(spark, compare.connect(sf), sf, op12_spelling, spelling.ORACLE_SQL)


def misspelt(rng):
    stems = ["".join(rng.choice("abcdeé×ÀÿZz") for _ in range(rng.randrange(5, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab", "q" * 63, "q" * 64, "q" * 65, "r" * 300, "r" * 301]
    words = []
    for stem in stems:
        for _ in range(8):
            at, kind = rng.randrange(len(stem)), rng.randrange(4)
            word = stem[:at] + (rng.choice("abcé") if kind else "") + stem[at + (kind != 2) :] if kind < 3 else stem
            words += [word] * rng.choice([1, 1, 2, 3, 30, 400])
    rng.shuffle(words)
    docs = [(rng.choice([None, 1, 2, 3, i]), " ".join(words[i::40]).replace(" ", rng.choice([" ", ", ", "1"]))) for i in range(40)]
    return docs + [(7, None), (8, ""), (9, "short words only"), (9, "x" * 3_000 + " " + "x" * 3_000)]


@pytest.mark.parametrize(("seed", "most_bytes"), [(1, 32 << 20), (2, 64), (3, 16)])
def test_all_pairs(spark, seed, most_bytes):
    """Small filters force many rounds, and shards in parts."""
    docs = misspelt(random.Random(seed))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, word string").repartition(5)
    got = spelling.variants(frame, garble=5, most_bytes=most_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(docs, garble=5)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[4] for r in want) > 50 and any(r[1] and r[2] != r[1] for r in want)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0


def test_an_edit_has_the_key_of_the_word_that_it_gives():
    words = pa.array(["aabbcde", "ÿbcdefgh", "abcdefgÀ"])
    letters, starts = spelling._letters(words)
    alphabet = np.array(sorted({ord(c) for w in words.to_pylist() for c in w}), np.uint8)
    seen = set()
    for word, place, letter, keys in spelling.edits(letters, starts, alphabet):
        for w, at, new, key in zip(word, place, letter, keys):
            source = words[int(w)].as_py()
            edited = source[:at] + (chr(new) if new >= 0 else "") + source[at + 1 :]
            assert spelling.word_keys(pa.array([edited]))[0] == key
            assert (source, edited) not in seen
            seen.add((source, edited))
    want = {(w, w[:i] + w[i + 1 :]) for w in words.to_pylist() for i in range(len(w))} | {(w, w[:i] + chr(c) + w[i + 1 :]) for w in words.to_pylist() for i in range(len(w)) for c in alphabet if c > ord(w[i])}
    assert seen == want


def test_filters_have_all_their_keys_and_few_others():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    held = spelling.Filter(np.zeros(50_000 * spelling.BITS // 64, np.uint64))
    held.add(keys)
    assert held.may_have(keys).all()
    assert held.may_have(others).mean() < 0.01


def test_rounds_cover_every_part_of_every_shard_within_the_bound():
    sizes = {7: 1_000, 8: 90_000, 9: 40, 64: 7}
    rounds = spelling._rounds(sizes, 20_000)
    found = [(length, *part) for r in rounds for length, part in r.items()]
    assert sorted((length, part) for length, part, _ in found) == sorted((length, part) for length, n in sizes.items() for part in range(-(-n * 16 // 160_000)))
    assert all(sum(sizes[length] * 2 // parts for length, (_, parts) in r.items()) <= 20_000 for r in rounds)
