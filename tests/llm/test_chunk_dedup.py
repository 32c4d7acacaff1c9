import random

import numpy as np

from terrace.llm import chunk_dedup
from terrace.llm.queries import CHUNK_LEAST


def split(raw, bits=5, least=48, most=1024):
    """Chunk ends by a byte-by-byte loop."""
    out, last, h, gear = [], 0, 0, [int(x) for x in chunk_dedup.GEAR]
    for i, byte in enumerate(raw):
        h = (h * 2 + gear[byte]) % 2**32
        if i - last + 1 >= least and (i + 1 >= 32 and h >> (32 - bits) == 0 or i - last + 1 == most):
            out.append(i + 1)
            last = i + 1
    return [*out, len(raw)] if last < len(raw) else out


def brute(docs):
    seen, out = set(), []
    for doc, text in sorted((d, t) for d, t in docs if d is not None):
        raw, a, kept = (text or "").encode(), 0, b""
        for b in split(raw):
            piece = raw[a:b]
            if len(piece) < 48 or piece not in seen:
                kept += piece
            seen.add(piece) if len(piece) >= 48 else None
            a = b
        out.append((doc, len(raw), len(raw) - len(kept), kept))
    return out


def test_against_a_byte_loop(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ijklmnop. é") for _ in range(n))
    passage = noise(900)
    docs = [(i, noise(rng.randrange(500)) + (passage if i % 3 == 0 else "") + noise(rng.randrange(200))) for i in range(30)]
    docs += [(50, passage), (51, passage), (52, None), (53, ""), (54, "x" * 5000), (55, noise(47))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS pos", "3 AS spans").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in chunk_dedup.remove_chunks(df).collect())
    assert got == brute(docs)
    removed = {r[0]: r[2] for r in got}
    assert removed[51] > 900 and all(removed[i] > 300 for i in range(3, 30, 3))
    assert all(removed[i] == 0 for i in range(1, 30, 3))


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "y" * 2000), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in chunk_dedup.remove_chunks(df).collect()) == [0, 0]
    assert chunk_dedup.remove_chunks(df.limit(0)).count() == 0


def test_gear_depends_on_its_window_alone():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    assert (chunk_dedup.gear(data)[40:] == chunk_dedup.gear(data[5:])[35:]).all()


def test_repeated_ids(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ijklmnop.") for _ in range(n))
    a, b = noise(700), noise(900)
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (2, noise(50) + b), (3, noise(400))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in chunk_dedup.remove_chunks(df).collect())
    assert [x[2] for x in got if x[0] == 1] == [0, 0, 0] and got[-1] == (3, 400, 0)
    assert all(x[2] > 400 for x in got if x[0] == 2)


def test_the_query_s_least_size(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ijklmnop.") for _ in range(n))
    sentence, passage = noise(70), noise(1500)
    docs = [(i, noise(300) + (passage if i % 2 else sentence) + noise(300)) for i in range(20)]
    rows = chunk_dedup.remove_chunks(spark.createDataFrame(docs, "doc_id long, text string"), least=CHUNK_LEAST).collect()
    removed = {r.doc_id: r.n_removed for r in rows}
    seen, want = set(), {}
    for doc, text in docs:
        raw, a, want[doc] = text.encode(), 0, 0
        for b in split(raw, least=CHUNK_LEAST):
            if b - a >= CHUNK_LEAST:
                want[doc] += b - a if raw[a:b] in seen else 0
                seen.add(raw[a:b])
            a = b
    assert removed == want
    assert all(removed[i] == 0 for i in range(0, 20, 2)) and sum(removed.values()) > 0.6 * 9 * 1500
