import hashlib
import random

import numpy as np

from tessera.llm import suffix


def brute(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        runs = int((np.diff(gone.astype(np.int8)) == 1).sum() + gone[0])
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect()}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def mixed(rng):
    passage = ["".join(rng.choice("abé") for _ in range(n)) for n in (90, 100, 140, 400)]
    rows = [(None, passage[3]), (1, None), (2, ""), (3, "x" * 500), (4, "ab" * 200), (5, "y" * 99), (6, "y" * 99), (7, "z" * 100), (8, "z" * 100)]
    for i in range(10, 60):
        t = "".join(rng.choice([*passage, "".join(rng.choice("cdef") for _ in range(rng.randrange(150)))]) for _ in range(rng.randrange(6)))
        cut = rng.randrange(30)
        rows.append((i, t[cut:]))
    return rows


def test_mixed_repeats_also_in_hot_groups(spark, monkeypatch):
    rows = mixed(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(df) == want
    monkeypatch.setattr(suffix, "HOT_GROUP", 3)
    assert got(df) == want
    assert got(df.limit(0)) == {}


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(1, a), (2, a[100:640] + "!" + a[:50]), (3, a[:300] + a[:200])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_kept_text_has_whole_characters(spark):
    rng = random.Random(11)
    t = "".join(rng.choice("éabcdü") for _ in range(200))
    rows = [(1, "q\u00e9" + t[1:] + "1", "s", 0), (2, "r\u00e8" + t[1:] + "2", "s", 0), (3, "short", "s", 5), (4, None, "s", 0), (5, "q\u00e9" + t[1:] + "1", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].text == rows[0][1] and out[2].text == "r\u00e82" and out[2].n_chars == 3


def test_deep_shallow_sort_is_a_sort():
    rng = random.Random(10)
    for alphabet, n in ((b"ab", 300), (b"\0a", 200)):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(n)]
        strings += [s[:50] + b"b" * 20 for s in strings[:50]] + strings[:30]
        group = np.sort(np.array([rng.randrange(3) for _ in strings]))
        order, lcp = suffix.deep_shallow_sort(strings, group)
        assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group.tolist(), strings, strict=True))
        for i in range(len(order)):
            first = i == 0 or group[order[i]] != group[order[i - 1]]
            assert lcp[i] == (-1 if first else suffix.common_prefix(strings[order[i - 1]], strings[order[i]]))


def ordered_brute(rows):
    """Of (doc_id, text) rows with any ids: {(doc_id, text): what brute() gives} with the different texts of an id in the order of the operator's hash."""
    import xxhash

    def place(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42 if r[0] is None else xxhash.xxh64_intdigest(np.int64(r[0]).tobytes(), 42))
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    one = sorted(set(rows), key=place)
    found = brute([(i, t) for i, (_, t) in enumerate(one)])
    return {r: found[i] for i, r in enumerate(one)}


def test_repeated_and_null_ids_are_judged_row_by_row(spark, monkeypatch):
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = fresh(300), fresh(300), fresh(300)
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c[:150] + fresh(100)), (None, fresh(250)), (None, None), (None, ""), (7, c[100:] + b[:120]), (7, a[50:250]), (7, a[50:250]), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = ordered_brute(rows)
    for hot in (suffix.HOT_GROUP, 1):
        monkeypatch.setattr(suffix, "HOT_GROUP", hot)
        found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect())
        assert found == sorted((str(r[0]), *want[r]) for r in rows)
    assert want[(5, b)][1] == 0 and want[(5, a)][1] == 300


def test_clashing_columns_go_through(spark):
    rng = random.Random(13)
    t = "".join(rng.choice("abcdefgh") for _ in range(220))
    names = ["k", "r", "spans", "first_k", "copy", "rest", "_dealt", "doc_id", "text", "n_chars", "h"]
    rows = [(i, -i, f"s{i}", None, i % 2 == 0, "rest", "d", i, x, n, 1.5) for i, (x, n) in enumerate([(t, 220), (t[:150] + "!", 151), ("short", 5), (None, None), (t, 220)])]
    df = spark.createDataFrame(rows, "k long, r long, spans string, first_k long, copy boolean, rest string, `_dealt` string, doc_id long, text string, n_chars int, h double")
    out = suffix.remove_repeats(df)
    assert out.columns == names and out.schema == df.schema
    found = {r.doc_id: tuple(r) for r in out.collect()}
    assert set(found) == {0, 1, 2, 3}
    assert found[0] == rows[0] and found[2] == rows[2] and found[3] == rows[3]
    assert found[1] == (*rows[1][:8], "!", 1, 1.5)
    assert suffix.remove_repeats(df.limit(0)).count() == 0
