import hashlib
import random
import re

import numpy as np

from terrace.llm import fill_middle as fm
from pyspark.sql import functions as F


def brute(doc, text, rate=90, swapped=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    a, b, keep, kind = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or keep % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    if kind % 100 < swapped:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "ß", "é", "漢字", "😀", "x1y2", "\n", "\x00", "<P", "S>", "<", " ", "  ", "Zz" * 40]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    shared = "".join(rng.choices("abc DEF,é", k=9000))
    docs += [(1000 + i, rng.choice("xé ") * i + shared + "tail" * (i % 3)) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "a<P>b"), (2003, "<M>"), (None, "null id, some words"), (-5, "minus five words here"), (7, "same id"), (7, "same id")]
    docs += [(3000 + i, "z" * 100_000) for i in range(6)] + [(4000 + i, ("lorem ipsum é, " * 120_000)) for i in range(3)]  # one token; longer than a block
    return docs


def test_against_brute_force_and_round_trip(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'f' AS form", "2 AS output", "3 AS h1").repartition(3)
    found = fm.fill_in_middle(df).withColumn("again", fm.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (repr(r[0]), r[5], r[1])
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((brute(*d) for d in docs), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert sorted((repr(r.doc_id), r.again) for r in found) == sorted((repr(d), t or "") for d, t in docs)


def test_empty_table(spark):
    out = fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_chunks_of_texts_that_share_a_passage_are_shared():
    rng = random.Random(3)
    passage = bytes(rng.choices(b"abcdefgh ijkl", k=60_000))
    one, two = b"first " + passage, b"another beginning, and " + passage
    data = np.frombuffer(one + two, np.uint8)
    a, b = fm.chunked(data, np.array([0, len(one), len(data)]))
    assert b"".join(a) == one and b"".join(b) == two
    assert len(set(a) & set(b)) > 0.9 * len(a) > 20


def test_cache_is_bounded_and_right():
    cache, rng = fm.Cache(2000), random.Random(1)
    pool = [bytes(rng.choices(b"ab \xc3\xa9", k=90)) for _ in range(40)]
    for _ in range(50):
        some = rng.choices(pool, k=9)
        for x, (tokens, chars, opens, closes) in zip(some, fm.summaries(some, cache)):
            data = np.frombuffer(x, np.uint8)
            assert tokens == fm.token_starts(data, np.array([0])).sum() and chars == sum(c & 0xC0 != 0x80 for c in x)
            assert (opens, closes) == (x[:1] in b"ab", x[-1:] in b"ab")
        assert sum(map(len, cache.young)) + sum(map(len, cache.old)) <= 2000
