import itertools
import random

import numpy as np

from tessera.llm import simhash


def brute(rows):
    """rows: (doc_id, text) -> {doc_id: (hex, component)}."""
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_fingerprint_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint(b"A  b\tc") == one % (1 << 64)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (5, "y z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.doc_id <= 3} == {1}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_pairs_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 43, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 300)] ^ (np.uint64(1) << rng.integers(0, 43, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 43, 300, dtype=np.uint64))
    values = np.sort(np.unique(np.concatenate((base, near))))
    n = len(values)
    a, b = simhash.trie_pairs(values, tuple(np.array([x]) for x in (0, n, 0, n)), 43, 2)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want
    assert len(a) == len(want)


def test_hot_groups_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_CAP", 8)
    rng = np.random.default_rng(2)
    fps = {0x0123456789ABCDEF ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 40, (120, 2))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from tessera.llm.graph import components

    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(signed, 2):
        if bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 2:
            p, q = sorted((find(x), find(y)))
            root[q] = p
    assert {f: roots.get(f, f) for f in signed} == {f: find(f) for f in signed}


def varied(rng, groups=12):
    """(doc_id, text) rows: originals, near copies with some words changed, and texts of their own."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((60, 200, 500)))]
        for _ in range(rng.randrange(1, 9)):
            new = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 12))):
                new[rng.randrange(len(new))] = word()
            rows.append(" ".join(new))
        rows.append(" ".join(base).upper())
    rows += [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 4, 5, 80, 300)] + [None, "", " \n"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def groups_at(rows, similarity=0.8):
    """The groups that links of five-word shingle similarity reach, by all pairs."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode().lower().split(), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (shared and shared >= similarity * len(sets[a] | sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in sets}


def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch):
    rows = varied(random.Random(21))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (simhash.GROUP_CAP, 4):
        monkeypatch.setattr(simhash, "GROUP_CAP", cap)
        assert {r.doc_id for r in simhash.stage(spark, df, "").collect()} == groups_at(rows)
    assert simhash.stage(spark, df.limit(0), "").count() == 0


def test_stage_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept, want = {r.doc_id for r in simhash.stage(spark, docs, "").collect()}, groups_at(rows)
    gone = {i for i, _ in rows} - want
    assert want <= kept and len(gone - kept) >= 0.98 * len(gone)


def test_stage_carries_clashing_columns(spark):
    rows = [(1, "a b c", "x", 1, None, 2.5), (2, "a B c", "y", 2, True, None), (3, "d", "z", 3, False, 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, kept_id string, row_key long, row boolean, digest double")
    out = simhash.stage(spark, df, "")
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    values = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, 8).tolist()))) for c in centres for _ in range(40)], np.uint64))
    for budget in (3, 9, 16):
        label = np.arange(len(values))
        whole = (np.array([0]), np.array([len(values)])) * 2
        a, b = simhash.trie_pairs(values, whole, 64, budget, label)
        assert all(bin(int(values[x] ^ values[y])).count("1") <= budget for x, y in zip(a, b, strict=True))
        x, y = simhash.trie_pairs(values, whole, 64, budget)
        want = simhash.spanning(len(values), x, y)
        assert len(a) == len(values) - len(set(want.tolist()))
        assert np.array_equal(simhash.spanning(len(values), a, b), want)


def family(rng, members):
    """Texts of one base whose similarity to each other lies around 0.8 on both sides: many are candidates, some are links."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = []
    for _ in range(members):
        new = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 5)):
            new[at] = word()
        out.append(" ".join(new))
    return out


def candidates(rows):
    """Pairs of rows that share a band within NEAR_BITS bits, and of them those similar by shingles."""
    values = {i: simhash.shingle_hashes(t.encode().split(), 5) for i, t in rows}
    bands, fps, sets = ({i: f(v) for i, v in values.items()} for f in (simhash.minima, simhash.majority, lambda v: set(v.tolist())))
    pairs = [(a, b) for a, b in itertools.combinations(values, 2) if (bands[a] == bands[b]).any() and bin(fps[a] ^ fps[b]).count("1") <= simhash.NEAR_BITS]
    return pairs, {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= simhash.SIMILARITY * len(sets[a] | sets[b])}, bands, fps


def reached(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_links_over_a_text_that_is_not_similar(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(t for _ in range(12) for t in family(rng, 9))]
    rows = list({t: (i, t) for i, t in reversed(rows)}.values())
    _, similar, bands, fps = candidates(rows)
    want = reached([i for i, _ in rows], sorted(similar))
    band = sorted((int(v), i) for i, found in bands.items() for v in found.view(np.int64))
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in band]), pa.array([signed[i] for _, i in band]), pa.array([i for _, i in band])], ["key", "fp", "c"])
    forest = {(v, u) for out in simhash._band_links([batch]) for u, v in zip(out.column("u").to_pylist(), out.column("v").to_pylist(), strict=True)}
    once = reached(list(want), [p for p in similar if p in forest])
    assert once != want  # the forest alone, checked afterwards, loses links
    for caps in ((simhash.GROUP_CAP, simhash.SET_CAP), (4, simhash.SET_CAP), (simhash.GROUP_CAP, 500)):
        monkeypatch.setattr(simhash, "GROUP_CAP", caps[0])
        monkeypatch.setattr(simhash, "SET_CAP", caps[1])
        got = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
        assert got == set(want.values())


def test_all_pairs_of_two_labels():
    rng = np.random.default_rng(8)
    values = np.sort(np.repeat(rng.integers(0, 1 << 63, 6, np.uint64), 5) ^ rng.integers(0, 4, 30).astype(np.uint64))
    label = rng.integers(0, 4, 30)
    whole = (np.array([0]), np.array([30])) * 2
    got = [(int(x), int(y)) for a, b in simhash.trie_blocks(values, whole, 64, 1, label, forest=False) for x, y in zip(a, b, strict=True)]
    want = {(x, y) for x, y in itertools.combinations(range(30), 2) if label[x] != label[y] and bin(int(values[x] ^ values[y])).count("1") <= 1}
    assert len(got) == len(want) and {tuple(sorted(p)) for p in got} == want


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [rng.choice(50, rng.integers(1, 20), replace=False) for _ in range(12)]
    starts = np.append(0, np.cumsum([len(s) for s in sets]))
    a, b = rng.integers(0, 12, 200), rng.integers(0, 12, 200)
    for frontier in (simhash.FRONTIER, 1):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        got = simhash.shared_counts(np.concatenate(sets), starts, a, b)
        assert got.tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(a, b, strict=True)]
    none = np.zeros(0, np.int64)
    assert simhash.shared_counts(none, np.zeros(1, np.int64), none, none).tolist() == []
