import math
import zlib
from collections import Counter

import numpy as np

from tessera.llm import lm


def brute(rows):
    toks = {i: [w for w in (t or "").encode().lower().split()] + [b"\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks.items()}


def test_base_against_brute_force_and_model_beats_it(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for head in (None, 50):
        got = lm.score_texts(docs, head=head).collect()
        for r in got:
            a = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == a[:4]
            assert abs(r.base_score - a[4]) < 1e-6 * max(1, abs(a[4]))
            assert r.score < 0
        if head is None:
            out = [r for r in got if r.held_out]
            assert sum(r.score for r in out) > sum(r.base_score for r in out)


TEXTS = ["the cat sat on the mat", "the dog sat", "a cat ran on", "un chat noir", "le chat"] * 4


def small(spark, head):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = lm.count_tokens(docs)
    return docs, lm.vocabulary(counts, head), {bytes(r.word): r.n for r in counts.collect()}


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "ENDINGS", 4)
    docs, v, n = small(spark, 6)
    scorer = lm.Scorer(v, lm.train(docs, v))
    head = len(v.words)
    assert 0 < head < len(n)
    sums = 0.0
    for word in n:
        ids, item, keys = scorer.encoder.encode([b"the", word], np.array([2]))
        p = 10 ** scorer.token_scores(item, keys)[1]
        sums += p if ids[1] >= 0 else p * (n[word] + 0.1) / v.rest[item[1] - head]
    for k in range(len(v.endings) + 1):  # an unknown word of each ending
        _, item, keys = scorer.encoder.encode([b"the", b"x"], np.array([2]))
        item[1] = head + k
        sums += 10 ** scorer.token_scores(item, keys)[1] * 0.1 / v.rest[k]
    assert abs(sums - 1) < 1e-4


def test_classes_part_items_down_to_one():
    for mass in (np.ones(1), np.ones(5), np.ones(1000), 1.0 / np.arange(1, 3000), np.r_[1e6, np.ones(40), 1e6, np.full(300, 1e-3)]):
        levels, prior = lm._nested(mass)
        n = len(mass)
        paths = [tuple((int(c[i]), int(b[i])) for c, b in levels if c[i] >= 0) for i in range(n)]
        assert len(set(paths)) == n
        p = [np.exp(sum(float(prior[c, b]) for c, b in path)) for path in paths]
        assert np.allclose(p, mass / mass.sum(), rtol=1e-3)
        assert all((levels[d][0][i] < 0) <= (levels[d + 1][0][i] < 0) for d in range(len(levels) - 1) for i in range(n))


def test_gradient_is_that_of_the_loss_and_steps_lower_it(spark):
    docs, v, _ = small(spark, 50)
    rng = np.random.default_rng(4)
    trainer = lm.Trainer(v, rng.normal(0, 0.3, (1 << 15, lm.FAN)).astype(np.float16))
    found = [w for t in TEXTS for w in [*t.encode().split(), lm.END]]
    sizes = np.array([len(t.split()) + 1 for t in TEXTS])
    _, item, keys = trainer.encoder.encode(found, sizes)

    def loss():
        scorer = lm.Scorer(v, trainer.table.astype(np.float64))
        scorer.table = trainer.table
        return -scorer.token_scores(item, keys).sum() * np.log(10)

    whole = {}
    for own, gradient, _ in trainer.gradient(item, keys):
        for b, g in zip(own.tolist(), gradient, strict=True):
            whole[b] = whole.get(b, 0) + g.astype(float)
    for b in rng.choice(sorted(whole), 12, replace=False).tolist():
        k = int(np.abs(whole[b]).argmax())
        before, e = trainer.table[b, k].copy(), 0.02
        trainer.table[b, k] = before + e
        up = loss()
        trainer.table[b, k] = before - e
        down = loss()
        trainer.table[b, k] = before
        assert abs((up - down) / (2 * e) - whole[b][k]) < 2e-2 * max(1, abs(whole[b][k]))
    losses = [loss()]
    for _ in range(10):
        trainer.step(item, keys)
        losses.append(loss())
    assert losses[-1] < 0.7 * losses[0]


def test_tasks_average_by_touch(spark, monkeypatch):
    monkeypatch.setattr(lm, "MERGED", 2)
    rng = np.random.default_rng(5)
    tasks = [(rng.normal(size=(8, lm.FAN)).astype(np.float16), rng.integers(0, 4, 8).astype(np.float32)) for _ in range(5)]
    rows = [(i, at, w[at : at + 4].tobytes(), n[at : at + 4].tobytes()) for i, (w, n) in enumerate(tasks) for at in (0, 4)]
    got = {r["at"]: r for r in lm.averaged(spark.createDataFrame(rows, lm._LEARNED), 5).collect()}
    assert set(got) == {0, 4}
    mass = sum(n for _, n in tasks)
    want = sum(w.astype(float) * n[:, None] for w, n in tasks) / np.maximum(mass, 1)[:, None]
    for at, r in got.items():
        assert np.array_equal(np.frombuffer(r.touched, np.float32), mass[at : at + 4])
        assert np.allclose(np.frombuffer(r.weights, np.float16).reshape(4, lm.FAN), want[at : at + 4], atol=5e-3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (5, "w " * 3000)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 3, 3001]
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = [(i, f"w{i} a b", i, "x", 1) for i in range(20)]
    more = lm.score_texts(spark.createDataFrame(clash, "doc_id long, text string, row long, word string, held_out int"))
    assert more.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and more.count() == 20
