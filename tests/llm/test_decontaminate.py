import random
import re

from terrace.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, met = set(), set()
        for item, body in items:
            b = words(body)
            k = min(len(b), span)
            if k:
                wanted = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) in wanted:
                        hit |= set(range(i, i + k))
                        if item is not None:
                            met.add(str(item))
        out[doc] = (len(w), len(hit), sorted(met))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS hits", "1 AS n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS key")
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(d, b).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "Of", "and", "über", "x9", "ñu", "zz", "QQ", "a1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 7, 9, 10, 11, 25, 60])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "...!"), (7, "the Of"), (None, " ".join(rng.choices(vocabulary, k=12)))]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 9, 30, 200])))
        if i % 2:
            words_of = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(words_of) + 1)
            text += "\n" + ", ".join(words_of[a : a + rng.choice([9, 10, 15])]).upper().replace("Ü", "ü") + "; " + text[::2]
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "word " * 5000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b c"), (2, None)], []) == {1: (3, 0, []), 2: (0, 0, [])}


def test_decontaminate_keeps_clean_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, "x " + passage), (2, "nothing here"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [2, 3]


def test_decontaminate_judges_each_row(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(None, "x " + passage), (None, "nothing here"), (4, passage), (4, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.decontaminate(d.withColumn("__row", d.text), b).collect()) == ["clean text", "nothing here"]


def test_texts_longer_than_a_block(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(220_000))  # over 1 MB
    own = text.split()
    items = [(1, " ".join(own[:12])), (2, " ".join(own[150_000:150_025])), (3, " ".join(own[-10:])), (4, " ".join(own[5:14]) + " elsewhere"), (5, own[100_000])]
    docs = [(0, text), (1, " ".join(own[-30:])), (2, text[: 1 << 20]), (3, "short text")]
    assert len(text) > 1 << 20 and run(spark, docs, items) == brute(docs, items)
