import random
import re

from tessera.llm import licenses

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    found = WORDS.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    places, labels = [], set()
    for words, label in (([b"mit", b"license"], "mit"), ([b"apache", b"license"], "apache"), ([b"general", b"public", b"license"], "gpl")):
        for i in range(len(found)):
            if found[i : i + len(words)] == words:
                places.append(i)
                labels.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_odd_texts():
    s = licenses.Scanner()
    for t in (None, "", "license", "MIT LICENSE", "the mit  license mit license", "general\npublic-license"):
        assert s.scan((t or "").encode())[:5] == brute(t)


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    sequences = [[rng.randrange(4) for _ in range(30)] for _ in range(4)]
    auto = licenses.Automaton(sequences)
    stream = [rng.randrange(5) for _ in range(400)]

    def longest(i):
        return max(n for n in range(i + 1) if n == 0 or any(stream[i - n : i] == s[k : k + n] for s in sequences for k in range(len(s) - n + 1)))

    ends = [longest(i) for i in range(len(stream) + 1)]
    want = [(i, ends[i]) for i in range(1, len(stream) + 1) if ends[i] >= 3 and (i == len(stream) or ends[i + 1] != ends[i] + 1)]
    found = auto.matches(stream, 3)
    assert [(e, n) for e, n, _ in found] == want
    for e, n, state in found:
        piece = stream[e - n : e]
        assert auto.places(state) == [(k, i + n) for k, s in enumerate(sequences) for i in range(len(s) - n + 1) if s[i : i + n] == piece]


def test_best_chains_against_brute_force():
    """Every chain of matches of a few small templates, tried one by one."""
    rng = random.Random(9)
    for _ in range(40):
        templates = [(f"t{k}", " ".join(rng.choice("abcd") for _ in range(rng.randrange(6, 14)))) for k in range(2)]
        s = licenses.Scanner(templates, least=2, gap=2)
        stream = [rng.randrange(-1, 4) for _ in range(25)]
        placed = [(k, e, at, n) for e, n, state in s.automaton.matches(stream, 2) for k, at in s.automaton.places(state)]

        def best_from(chain, covered):
            k, end, at, _ = chain[-1]
            found = covered
            for m in placed:
                n = m[3]
                lap = max(0, end - (m[1] - n), at - (m[2] - n))
                if m[0] == k and m[1] > end and m[2] > at and lap < n and m[1] - n - end <= 2 and m[2] - n - at <= 2:
                    found = max(found, best_from([*chain, m], covered + n - lap))
            return found

        want = {}
        for m in placed:
            want[m[0]] = max(want.get(m[0], 0), best_from([m], m[3]))
        assert dict(s.spans(stream)) == {k: min(1.0, n / s.sizes[k]) for k, n in want.items()}


def test_odd_tables(spark):
    rows = [(1, None), (1, None), (None, "MIT License"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS n_words", "2.0 AS score")
    got = sorted((str(r.doc_id), r.n_words, r.labels, r.first_word) for r in licenses.scan_licenses(docs).collect())
    assert got == [("1", 0, "", None), ("1", 0, "", None), ("2", 0, "", None), ("None", 2, "mit", 0)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_near_copies_of_a_template_get_its_label():
    s = licenses.Scanner()
    text = next(t for label, t in licenses.TEMPLATES if label == "bsd").replace("source and binary", "any source or binary")
    got = s.scan(f"xx yy {text} zz".encode())
    assert got[5] == "bsd" and got[4] == "" and got[6] >= 0.6
    assert s.scan(b"the software of the license and the files of this")[5] == ""


def test_whole_texts_with_changes_get_their_label():
    s = licenses.Scanner()
    for label, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) > 60:
            words[::9] = ["changed"] * len(words[::9])
            got = s.scan((" xx yy " * 5 + " ".join(words)).encode())
            assert label in got[5].split(",") and got[6] > 0.6
