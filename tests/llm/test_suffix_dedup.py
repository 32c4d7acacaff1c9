import os
import random
from collections import Counter

import numpy as np
import pytest

from terrace.llm import suffix_dedup


def brute(docs, span):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + span] for _, t in texts for i in range(len(t) - span + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, bytes(b for b, x in zip(t, gone) if not x)))
    return sorted(out, key=repr)


def run(spark, docs, span):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'h' AS h", "1 AS n", "2 AS pos").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, span).collect()), key=repr)


def corpus(rng):
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrsé") for _ in range(n))
    passage, other = noise(700), noise(230)
    docs = [(i, noise(rng.randrange(400)) + (passage[a : a + rng.choice([199, 200, 201, 350])] if (a := rng.randrange(400)) % 3 else "") + noise(rng.randrange(300))) for i in range(40)]
    docs += [(100 + i, other[: rng.randrange(150, 230)] + noise(5)) for i in range(30)]
    copy = noise(900)
    docs += [(200 + i, copy) for i in range(5)] + [(210, copy[:450] + "X" + copy[450:]), (211, noise(100) + "=" * 600 + noise(50)), (212, "=" * 420), (213, "ab" * 300)]
    docs += [(None, None), (None, noise(250)), (None, copy[100:500]), (400, other + noise(40)), (400, noise(300)), (400, passage), (401, repeated := noise(320)), (401, repeated)]
    return docs + [(300, None), (301, ""), (302, noise(199)), (303, noise(200))]


@pytest.mark.parametrize("group", [4000, 3, 1])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = corpus(random.Random(7))
    assert run(spark, docs, 200) == brute(docs, 200)


def test_a_task_holds_part_of_the_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    docs = corpus(random.Random(8))
    assert run(spark, docs, 200) == brute(docs, 200)


def test_radix_order():
    rng = np.random.default_rng(3)
    for width in (1, 7, 8, 20, 150):
        table = rng.integers(0, 3, (200, width), dtype=np.uint8) if width < 20 else np.repeat(rng.integers(0, 255, (20, width), dtype=np.uint8), 10, axis=0)
        if width >= 20:
            table[rng.integers(0, 200, 60), rng.integers(0, width, 60)] = 0
        group = np.sort(rng.integers(0, 5, 200))
        order, common = suffix_dedup.radix_order(table, group)
        rows = [(int(group[i]), table[i].tobytes()) for i in order]
        assert rows == sorted((int(g), t.tobytes()) for g, t in zip(group, table))
        for i, n in enumerate(common.tolist()):
            same = -1 if i == 0 or rows[i][0] != rows[i - 1][0] else len(os.path.commonprefix([rows[i][1], rows[i - 1][1]]))
            assert n == same


def test_empty(spark):
    assert run(spark, [], 200) == []


def test_many_texts_share_a_short_passage(spark, monkeypatch):
    """Nothing to remove: an anchor is dealt a few times, whatever the number of texts that share its surroundings."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrs") for _ in range(n))
    passage = noise(150)
    docs = [(i, noise(200) + passage + noise(200)) for i in range(600)]
    monkeypatch.setattr(suffix_dedup, "GROUP", 50)
    dealt = []
    halves = suffix_dedup.halves
    monkeypatch.setattr(suffix_dedup, "halves", lambda nodes, span: dealt.append(nodes.count()) or halves(nodes, span))
    assert run(spark, docs, 200) == brute(docs, 200)
    assert 2 * sum(dealt) < 12 * 600


def test_many_texts_share_a_long_passage(spark, monkeypatch):
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrs") for _ in range(n))
    passage = noise(260)
    docs = [(i, noise(rng.randrange(150)) + passage[rng.randrange(30) :] + noise(rng.randrange(150))) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "GROUP", 20)
    assert run(spark, docs, 200) == brute(docs, 200)
