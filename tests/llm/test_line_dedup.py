import random

from terrace.llm import line_dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, min_docs=3, min_chars=20):
    holders = {}
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars and doc is not None:
                holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["Ünï" * 7, "x" * 20, "y" * 19, "  A shared line of some length \t", "a SHARED line of some length", "é" * 20, "É" * 20, "", " ", "z" * 300]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(6)))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, "x" * 20), (52, "\n".join([pool[3]] * 500))]
    docs += [(60, pool[1] * 2), (60, pool[1] * 2), (61, pool[1] * 2), (62, "v" * 30), (62, "v" * 30 + "\n"), (63, "v" * 30), (64, "v" * 30 + "\nw")]  # two and three documents
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_lines", "'k' AS key", "'d' AS drop")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == brute(docs)


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_longer_than_a_block(spark):
    rng = random.Random(6)
    pool = [f"a shared line, the {i}th of them" for i in range(3000)]
    docs = [(i, "\n".join(rng.choices(pool, k=40_000 if i < 2 else 300))) for i in range(12)]  # the first two over 1 MB
    docs += [(20, "one line " * 150_000), (21, "one line " * 150_000), (22, "one line " * 150_000)]
    assert len(docs[0][1]) > 1 << 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == brute(docs)
