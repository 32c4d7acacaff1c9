import random
import re

import numpy as np

from terrace.llm import components, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'b' AS bands", "'s' AS size")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(df, percent=85).collect()}


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"m{rng.randrange(10**6)}" for w in words)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))]
        docs += [(1000 * g + i, mutated(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))) for i in range(rng.choice([1, 3, 8, 60]))]
    docs += [(90001, None), (90002, ""), (90003, " \t\n"), (90004, "a b c"), (90005, "A b C"), (90006, "a b"), (90007, "x " * 3000)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    assert run(spark, docs) == brute(docs)
    monkeypatch.setattr(near_dedup, "PART", 7)
    monkeypatch.setattr(near_dedup, "DEAL", 5)
    assert run(spark, docs) == brute(docs)


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_components(df).collect()), key=repr)
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (None, 2, None, True)], key=repr)
    assert near_dedup.near_components(df.limit(0)).count() == 0


def test_registers_merge_and_measure():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 52, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    ra, rb, rc = (near_dedup.registers(x, 1)[0] for x in (a, b, pool[:2500]))
    assert (np.maximum(ra, rb) == rc).all()
    assert abs((ra == rb).mean() - 0.6) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_one_row_of_each_component_stays(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "one more text without any copy at all"
    rows = [(7, a, "x"), (7, a, "y"), (None, a, "z"), (9, a, "u"), (None, b, "first"), (None, b, "first"), (4, c, "c"), (4, b + " other words of length", "d"), (1, None, "n"), (1, None, "n"), (None, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    got = sorted((tuple(r) for r in near_dedup.keep_one(df).collect()), key=repr)
    left = [r for r in got if r[1] not in (a, b)]
    assert left == sorted([(4, c, "c"), (4, b + " other words of length", "d"), (1, None, "n"), (1, None, "n"), (None, "", "e")], key=repr)
    assert [(r[0], r[1]) for r in got if r[1] in (a, b)] == [(7, a), (None, b)]
    assert near_dedup.keep_one(df.limit(0)).count() == 0


def test_texts_longer_than_a_block(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(50_000)}" for _ in range(220_000)]  # over 1 MB
    near, far = list(words), list(words)
    for i in rng.sample(range(len(words)), 2500):
        near[i] = "changed"
    for i in rng.sample(range(len(words)), 20_000):
        far[i] = "changed"
    texts = {3: near, 7: words, 8: far, 9: words[: len(words) // 2], 11: words}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(df, 85).collect()}
    sizes = {k: len(shingles(" ".join(v))) for k, v in texts.items()}
    assert got == {3: (sizes[3], 3), 7: (sizes[7], 3), 8: (sizes[8], 8), 9: (sizes[9], 9), 11: (sizes[11], 3)}
