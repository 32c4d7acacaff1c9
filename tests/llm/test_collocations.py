import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrace.llm import collocations as co


def brute(docs, longest=3, least=10, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["The", "the", "cat", "é", "É", "new", "york", "city", "of", "x\x0by", "\x00", "a" * 300, "漢", "😀", "san-jose", "(", "q"]
    docs = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "\r", "!"]) for _ in range(rng.randrange(80)))) for _ in range(120)]
    docs += [("en", "new york city and new york state, New York")] * 30 + [("en", None), ("en", ""), (None, " ,;. \t")] + [("es", "one two three " * 20_000)]
    return docs


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 3, 7), (4, 5, 50)])
def test_against_brute_force(spark, longest, least, top):
    docs = corpus()
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "lang string, text string, doc_id long").selectExpr("*", "1 AS f", "2 AS ids", "'w' AS word", "3 AS shard").repartition(5)
    got = co.collocations(df, longest, least, 50, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, longest, least, 50, top)


def test_small_filters_and_many_shards(spark, monkeypatch):
    """The same with filters handed on all the time, small shards and ids that meet each other often."""
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    for name, value in (("ENTRIES", 50), ("SHARD", 300), ("BLOCK", 2000)):
        monkeypatch.setattr(co, name, value)
    narrow = co.word_ids
    monkeypatch.setattr(co, "word_ids", lambda words, longest: crowded(narrow, words, longest))
    assert sorted(tuple(r) for r in co.collocations(df).collect()) == brute(docs)


def crowded(word_ids, words, longest):
    """Ids of 6 bits of which 5 are the hash: most words have to be numbered."""
    from pyspark.sql import functions as F

    code = F.xxhash64("word").bitwiseAND(F.lit(31))
    met = {}
    for r in sorted(words.select("word", code.alias("code")).distinct().collect()):
        met.setdefault(r.code, []).append(r.word)
    later = sorted(w for own in met.values() for w in sorted(own)[1:])
    assert len(later) > 3
    return co.Ids(8, {w.encode(): k for k, w in enumerate(later)})


def test_ids_of_equal_hashes_differ(spark, monkeypatch):
    import xxhash

    by = defaultdict(list)
    for i in range(4000):
        by[xxhash.xxh64_intdigest(f"w{i}".encode(), 42) & (1 << 19) - 1].append(f"w{i}")
    met = [w for own in by.values() if len(own) > 1 for w in own]
    assert len(met) >= 10
    ids = co.word_ids(spark.createDataFrame([(w,) for w in met], "word string"))
    assert ids.bits == 20 and len(ids.numbered) == sum(len(own) - 1 for own in by.values())
    import pyarrow as pa

    assert len(set(ids.of(pa.array(met)).tolist())) == len(met)


@pytest.mark.parametrize("n, bits", [(1, 42), (2, 20), (3, 20), (3, 42), (4, 30), (5, 24)])
def test_permutation_and_filter_can_be_turned_back(n, bits):
    rng = np.random.default_rng(n * bits)
    words = [rng.integers(0, 1 << bits, 5000, np.uint64) for _ in range(n)]
    half = n * bits // 2
    left, right = co.packed(words, bits)
    assert all((a == b).all() for a, b in zip(words, co.unpacked(left, right, n, bits)))
    x, y = co.permuted(left, right, half)
    assert all((a == b).all() for a, b in zip((left, right), co.original(x, y, half)))
    assert int(x.max()) < 1 << half and int(y.max()) < 1 << half
    keys, counts = co.summed([x, y], rng.integers(1, 600, 5000))
    shards = 3
    for s in range(1 << shards):
        own = (keys[0] >> np.uint64(half - shards)) == s
        row = co.encoded(keys[0][own], keys[1][own], counts[own], half, shards)
        back = co.decoded(row, s, half, shards)
        assert all((a == b).all() for a, b in zip(back, (keys[0][own], keys[1][own], counts[own])))


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
