import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import toxicity as tx

DATA = "/root/testdata/sf0.1"


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def grams(word):
    word = b"^" + word + b"$"
    return {(0, word)} | {word[i : i + k] for k in (5, 7) for i in range(len(word) - k + 1)}


def corpus(n=900, seed=2):
    """Insults make a text toxic, and toxic texts name one group more often than others do."""
    rng = random.Random(seed)
    plain = [f"w{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(5, 60))
        if toxic and rng.random() < 0.6:  # the others are toxic by nothing but the name
            words += rng.sample(["blurgly", "Snargish", "vonkhead"], 2)
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("Muslims")
        elif rng.random() < 0.3:
            words.append(rng.choice(["christians", "jews", "hindus"]))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS toxic", "0.5D AS score", "2 AS features").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1))


def test_swaps_take_the_weight_from_group_names(spark):
    docs, labels = corpus()
    probes = [(10_001, "muslims met here"), (10_002, "christians met here"), (10_003, "people met here"), (10_004, "what a blurgly snargish"), (10_005, None), (10_006, "")]
    gap, wrong, truth = {}, {}, dict(labels)
    for fairness in (0.0, 5.0):
        got = {r.doc_id: r for r in tx.toxicity(*frames(spark, docs + probes, labels), fit=tx.Fit(fairness=fairness)).collect()}
        gap[fairness] = abs(got[10_001].score - got[10_003].score)
        wrong[fairness] = sum(r.predicted > truth.get(r.doc_id, 1) for r in got.values() if r.held_out)
        assert got[10_004].predicted == 1 and got[10_003].predicted == got[10_005].predicted == got[10_006].predicted == 0
        assert got[10_005].score == got[10_006].score
    assert got[10_001].predicted == got[10_002].predicted == 0
    assert gap[0.0] > 0.3 and gap[5.0] < 0.1
    assert wrong[0.0] > wrong[5.0] == 0
    insulted = [d for d, text in docs if held_out(d) and ("blurgly" in text or "Snargish" in text)]
    assert sum(got[d].predicted for d in insulted) == len(insulted) > 20


def test_rows_ids_and_labels(spark):
    docs, labels = corpus(400)
    odd = [(None, docs[5][1]), (5, docs[5][1]), (5, docs[5][1]), (None, None)]
    got = tx.toxicity(*frames(spark, docs + odd, labels + [(None, 1), (9999, 1), (7, None), (8, 3)])).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in docs + odd)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    # labels of held-out documents change nothing
    other = [(d, 1 - t if held_out(d) else t) for d, t in labels]
    again = tx.toxicity(*frames(spark, docs + odd, other)).collect()
    assert np.allclose(sorted(r.score for r in again), sorted(r.score for r in got), atol=1e-12)


def test_without_labels(spark):
    docs, labels = corpus(60)
    assert {r.score for r in tx.toxicity(*frames(spark, docs, [])).collect()} == {0.5}
    assert len({r.score for r in tx.toxicity(*frames(spark, docs, [(d, 0) for d, _ in labels])).collect()}) == 1
    assert tx.toxicity(*frames(spark, [], labels)).count() == 0


def test_features_and_counts_against_brute_force(spark):
    docs, labels = corpus(150)
    sample = tx.labelled_sample(*frames(spark, docs, labels), tx.Fit(rows=100))
    assert sample.count() == 100
    rows = sample.collect()
    want = {}
    for r in rows:
        for g in {g for w in r.text.lower().encode().split() for g in grams(w)}:
            want[g] = want.get(g, 0) + 1
    got = sorted(r.f for r in tx._feature_counts(sample).collect())
    assert got == sorted(want.values())


def test_training_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    own = [sorted(rng.choice(12, rng.integers(0, 6), False).tolist()) for _ in range(200)]
    toxic = np.array([int(3 in x or (5 in x and 7 in x) or rng.random() < 0.1) for x in own])
    swapped = [[[c if c != 2 else 9 for c in x]] if 2 in x else [] for x in own]
    fit = tx.Fit(ridge=0.01, fairness=1.0, steps=3000)
    b, w = tx.train(toxic, own, swapped, 12, fit)

    def loss(b, w):
        z = np.array([b + w[x].sum() for x in own])
        change = [w[x].sum() - w[o].sum() for x, others in zip(own, swapped) for o in others]
        return np.mean(np.log1p(np.exp(z)) - toxic * z) + fit.ridge / 2 * (w @ w) + fit.fairness * np.mean(np.square(change))

    best = loss(b, w)
    for k in range(13):
        for step in (-1e-3, 1e-3):
            x, y = w.copy(), b
            if k == 12:
                y += step
            else:
                x[k] += step
            assert loss(y, x) > best - 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    found = tx.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").toPandas()
    hit, said, all_ = ((found.toxic == 1) & (found.predicted == 1)).sum(), found.predicted.sum(), found.toxic.sum()
    assert len(found) > 900 and hit >= 0.85 * all_ and hit >= 0.95 * said  # about a tenth of the labels are noise
