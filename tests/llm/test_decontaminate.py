import random

import numpy as np

from tessera.llm import decontaminate as d


def within(pattern, text):
    """Fewest edits that turn pattern into a part of text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qxz")
        elif kind == 1:
            out.insert(at, rng.choice("qxz"))
        else:
            del out[at]
    return "".join(out)


def test_windows_within_budget_are_all_found(spark):
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()) for i, n in enumerate((30, 60, 100, 140, 260))]
    filler = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n)).strip()
    docs, k = [], 0
    for _, t in items:
        for n in (0, 1, 2, 5, 8, 14):
            docs.append((k, filler(80) + " " + edited(rng, t, n) + " " + filler(90)))
            k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, filler(500)), (k + 3, items[2][1].upper().replace(" ", "\n "))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "short"), (None, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(df, bench).collect()}
    w = d.windows([(i, " ".join(t.split())) for i, t in items])
    want = set()
    for doc, text in docs:
        text = " ".join((text or "").lower().split())
        for k2, t in enumerate(w.text):
            pattern = "".join(map(chr, t.tolist()))
            if within(pattern, text) <= w.budget[k2]:
                want.add((doc, int(w.item[k2])))
    assert got == want
    assert d.find_leaks(df.limit(0), bench).count() == 0 and d.find_leaks(df, bench.limit(0)).count() == 0


def test_banded_distance():
    rng = random.Random(6)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(30))
        b = edited(rng, a, rng.randrange(5))
        x, y = (np.array([ord(c) for c in s], np.int64) for s in (a, "zzzz" + b + "zzzz"))
        assert d.edit_distance(x, y, 9)[0] == within(a, "zzzz" + b + "zzzz")


def test_verbatim_passages_of_the_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    squeeze = lambda t: " ".join(t.lower().split())
    texts = [(r.doc_id, squeeze(r.text)) for r in docs.collect()]
    want = {(i, r.item_id) for r in bench.collect() for i, t in texts if squeeze(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert want <= got
    assert len({i for i, _ in got}) <= len({i for i, _ in want}) + 2


def test_excerpts_cut_at_every_offset_are_found(spark):
    rng = random.Random(12)
    item = "".join(rng.choice("abcdefgh") for _ in range(233))
    filler = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    docs = [(at, filler(70) + item[at : at + d.WINDOW] + filler(70)) for at in range(len(item) - d.WINDOW + 1)]
    docs += [(1000 + at, filler(70) + edited(rng, item[at : at + d.WINDOW], 6) + filler(70)) for at in range(len(item) - d.WINDOW + 1)]
    docs += [(2000, filler(70) + item[59:191] + filler(70)), (2001, filler(70) + item[20:110] + filler(70))]
    got = {r.doc_id: r for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {i for i, _ in docs} - {2001}  # 90 characters: under the least passage, and more than eight edits from any window
    assert all(got[i].edits == 0 for i, _ in docs if i < 1000)
    assert got[2000].n_windows >= 33


def test_blocks_long_texts_and_clashing_columns(spark, monkeypatch):
    """A benchmark of several blocks, texts of several pieces, repeated rows, null ids and columns of any name."""
    rng = random.Random(15)
    item = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, item(150)) for i in range(6)] + [(6, "tiny")]
    filler = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    docs = [(i, filler(40) + t + filler(40)) for i, t in items]
    docs += [(20, filler(1_950) + items[0][1] + filler(900)), (21, filler(3_000)), (None, items[1][1]), (None, filler(200)), (22, None), (22, None), (0, docs[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), k) for i, t in dict(enumerate(docs)).values() for k, x in items if t and x in t and len(x) >= d.LEAST)
    clash = df.selectExpr("*", "1 AS leaked_id", "'n' AS normal_text", "doc_id AS item_id", "true AS `row`", "2 AS edits")
    clean = sorted(str(i) for i, t in docs if not any(x in (t or "") for _, x in items[:6]))
    for chars, piece in ((d.BLOCK_CHARS, d.PIECE), (300, 1_000)):
        monkeypatch.setattr(d, "BLOCK_CHARS", chars)
        monkeypatch.setattr(d, "PIECE", piece)
        assert sorted((str(r.doc_id), r.item_id) for r in d.find_leaks(df, bench).collect()) == sorted(set(want))
        left = d.without_leaks(clash, bench)
        assert left.dtypes == clash.dtypes and sorted(str(r.doc_id) for r in left.collect()) == clean


def test_items_without_an_id_take_documents_with_them(spark, tmp_path):
    """Dropping needs no name: a null item id hides no leak; find_leaks, which reports names, leaves such items out."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [text(40) for _ in range(3)]
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (5, items[2]), (None, None), (None, "")], "item_id long, text string")
    rows = [(1, f"{text(10)} {items[0]} {text(5)}"), (2, items[1]), (None, items[2]), (3, text(60)), (4, None), (5, ""), (None, text(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in d.without_leaks(docs, bench).collect()}
    assert kept == set(rows[3:])
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()} == {(None, 5)}
