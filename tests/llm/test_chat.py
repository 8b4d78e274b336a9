import hashlib
import random

from tessera.llm import chat


def brute_paths(edges, score, branches):
    children, nodes = {}, set(edges)
    for n, p in edges.items():
        children.setdefault(p if p in nodes else None, []).append(n)
    found = []

    def walk(n, path):
        path = [*path, n]
        if n not in children:
            found.append(path)
        for c in children.get(n, []):
            walk(c, path)

    for r in children.get(None, []):
        walk(r, [])
    found.sort(key=lambda p: (-sum(score[n] for n in p) / len(p), -len(p), p[-1]))
    return found[:branches]


def test_paths_against_brute_force(spark):
    rng = random.Random(5)
    edges = {i: rng.choice([i - 1, rng.randrange(i), 999]) if i else None for i in range(60)}
    score = {i: float(rng.randrange(8)) for i in edges}
    rows = [(7, False, i, p, score[i]) for i, p in edges.items()]
    df = spark.createDataFrame(rows, "tree long, no_tree boolean, node long, parent long, score double")
    got = {}
    for r in sorted(chat.paths(df, 3).collect(), key=lambda r: (r.branch, r.depth)):
        got.setdefault(r.branch, []).append(r.node)
    assert [got[b] for b in sorted(got)] == brute_paths(edges, score, 3)


def test_round_trip_of_odd_rows(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "<&s><s>[[INST]\n</s"), (1, 2, "assistant", None), (1, 2, None, "x"), (1, None, "user", ""), (2, 5, "user", "é"), (2, 5, "user", "é"), (None, 0, "assistant", "no id")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(got) == {1, 2, 3, None}
    order = sorted([r for r in rows if r[0] == 1], key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order)
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    taught = "".join(r[3] or "" for r in order if r[2] == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(taught), hashlib.sha256(taught.encode()).hexdigest())
    assert got[2].n_turns == 2 and got[3].n_turns == 40
    for r in made.collect():
        text = [chat.BEGIN in r.formatted, r.formatted.count(chat.END) == len(r.loss_turns)]
        assert all(text)
        spans = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss_spans)
        assert r.conv_id != 3 or spans == "".join(f"t{t}" for t in range(1, 40, 2))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_clashing_columns_are_not_read(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "7 AS tree", "true AS no_tree", "9 AS node", "'p' AS parent", "1.5 AS score", "0 AS depth", "'f' AS formatted", "1 AS branch")
    plain, odd = (sorted(map(tuple, chat.digests(chat.format_conversations(d)).collect())) for d in (df, clash))
    assert plain == odd and [r[0] for r in odd] == [1, 2]
