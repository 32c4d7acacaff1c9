"""Toxicity by a linear classifier whose training is regularised with counterfactuals.

Features are the words of a text and the 5- and 7-byte grams of its words with their ends marked, each once a text.
Labelled texts that name a group are taken once more with the name swapped for those of other groups of the same kind,
and the training loss has, besides cross entropy and a small ridge, the mean square of the change of the score that a
swap makes. So a group's name can't stand for what is said around it, and neutral mentions score as texts without one.

Features are counted by Spark over a bounded sample of labelled texts (those of the smallest hashes); only features
that many toxic texts have and that tell the classes apart get a weight. Every text is scored whole, where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, blocks, buffers, gram_hashes, mix, word_hashes, word_spans
from .tables import stage

_U = np.uint64
GRAMS = (5, 7)
#: Bytes of text that are looked at together.
BLOCK = 2 << 20

#: Names of groups, by kind and form; a name is swapped within its line only.
IDENTITY = tuple(
    tuple(line.split())
    for line in """
women men girls boys
woman man girl boy
female male nonbinary
muslims christians jews hindus buddhists sikhs atheists catholics
muslim christian jewish hindu buddhist sikh atheist catholic
black white asian latino arab african european american
blacks whites asians latinos arabs africans europeans americans
gay lesbian bisexual straight transgender queer heterosexual
gays lesbians bisexuals heterosexuals
immigrants refugees foreigners natives citizens
immigrant refugee foreigner native citizen
disabled blind deaf elderly young
frauen männer mädchen jungen
muslime christen juden hindus buddhisten
ausländer flüchtlinge einwanderer einheimische
schwule lesben heterosexuelle
femmes hommes filles garçons
musulmans chrétiens juifs hindous bouddhistes
étrangers réfugiés immigrés
homosexuels lesbiennes hétérosexuels
mujeres hombres niñas niños
musulmanes cristianos judíos hindúes budistas
extranjeros refugiados inmigrantes
homosexuales lesbianas heterosexuales
""".strip().splitlines()
)


@dataclass(frozen=True)
class Fit:
    """How the classifier is fitted: ``rows`` labelled texts at most; a feature needs ``least`` toxic texts and is one of the
    ``features`` that tell most; ``ridge`` and ``fairness`` weigh the two penalties; ``swaps`` other names are tried."""

    rows: int = 20_000
    least: int = 4
    features: int = 4096
    ridge: float = 0.0002
    fairness: float = 2.0
    swaps: int = 2
    steps: int = 400


def _distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of some texts: each once, and the rows and words (numbers among these) that go together."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=size[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data[ALNUM[data]])]).dictionary_encode()
    n = max(len(found.dictionary), 1)
    pairs = np.unique(row * n + found.indices.to_numpy())
    return found.dictionary.to_pylist(), pairs // n, pairs % n


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature): hashes of each word and of its grams, the word's ends being part of it."""
    data = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8)
    ends = np.cumsum([len(w) + 2 for w in words]) if words else np.zeros(0, np.int64)
    starts = ends - [len(w) + 2 for w in words] if words else ends
    number = np.repeat(np.arange(len(words)), ends - starts)
    out = [(np.arange(len(words)), word_hashes(data, starts, ends, fold=False))]
    letters = mix(data.astype(_U) + _U(1))
    for k in GRAMS:
        whole = np.flatnonzero(number[: max(len(number) - k + 1, 0)] == number[k - 1 :])
        out.append((number[whole], gram_hashes(letters, k)[whole]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a feature in order, each once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def _row_features(words: list[bytes], row: np.ndarray, number: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once; with ``known`` (sorted) only features among these, as their places there."""
    of, feature = word_features(words)
    if known is not None:
        at = np.minimum(np.searchsorted(known, feature), max(len(known) - 1, 0))
        own = known[at] == feature if len(known) else np.zeros(len(feature), bool)
        of, feature = of[own], at[own]
    order = np.argsort(of, kind="stable")
    of, feature = of[order], feature[order]
    begin = np.searchsorted(of, np.arange(len(words) + 1))
    many = np.diff(begin)[number]
    where = np.repeat(begin[number], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return _pairs(np.repeat(row, many), feature[where])


def _swapped(words: list[bytes], k: int) -> list[bytes]:
    """The words with every group's name replaced by the k-th after it in its line."""
    return [_next(w, k) for w in words]


_LINE = {name.encode(): (line, i) for line in reversed(IDENTITY) for i, name in enumerate(line)}


def _next(word: bytes, k: int) -> bytes:
    if word not in _LINE:
        return word
    line, i = _LINE[word]
    return line[(i + k) % len(line)].encode()


def labelled_sample(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(text, toxic) of at most ``fit.rows`` labelled documents: those whose ids have the smallest hashes."""
    chosen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit.rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # fit.rows pairs of numbers at most


def _feature_counts(sample: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(feature, f): how many texts have each feature, or each of the known ones."""
    schema = pa.schema([("feature", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off, BLOCK):
                _, found = _row_features(*_distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i]), known)
                if known is not None:
                    found = known[found]
                feature, f = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(f, pa.int64())], schema=schema)

    return sample.select("text").mapInArrow(run, "feature long, f long").groupBy("feature").agg(F.sum("f").alias("f"))


def telling_features(sample: DataFrame, fit: Fit = Fit()) -> np.ndarray:
    """The features of at least ``fit.least`` toxic texts that tell most: the likelihood ratio of their counts by class."""
    toxic = sample.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in toxic}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, _U)
    found = stage(_feature_counts(sample.filter("toxic = 1")).filter(F.col("f") >= fit.least))
    # candidates: the likelihood ratio that they would have, were no clean text to have them
    candidates = found.orderBy(F.desc("f"), "feature").limit(64 * fit.features)
    known = np.sort(np.array([r.feature for r in candidates.toLocalIterator()], np.int64).view(_U))
    clean = _feature_counts(sample.filter("toxic = 0"), known)
    both = candidates.join(F.broadcast(clean.withColumnRenamed("f", "g")), "feature", "left").fillna(0, ["g"])  # 64 * features rows at most

    def part(x: str, total: int) -> str:
        expected = f"((f + g) * {total / (n1 + n0)!r})"
        return f"CASE WHEN {x} > 0 THEN {x} * ln({x} / {expected}) ELSE 0 END"

    parts = [part("f", n1), part("g", n0), part(f"({n1} - f)", n1).replace("(f + g)", f"({n1 + n0} - f - g)"), part(f"({n0} - g)", n0).replace("(f + g)", f"({n1 + n0} - f - g)")]
    ranked = both.withColumn("tells", F.expr("2 * (" + " + ".join(parts) + ")")).filter(f"f * {n0} > g * {n1} AND tells > 10.83")
    best = ranked.orderBy(F.desc("tells"), "feature").limit(fit.features)
    return np.sort(np.array([r.feature for r in best.collect()], np.int64).view(_U))


def _rows(sample: DataFrame, known: np.ndarray, swaps: int) -> DataFrame:
    """(toxic, features, swapped): of each text, the places of its features, and those of its counterfactuals if it names a group."""
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int32())), ("swapped", pa.list_(pa.list_(pa.int32())))])

    def by_row(row: np.ndarray, feature: np.ndarray, n: int) -> list[list[int]]:
        return [x.tolist() for x in np.split(feature, np.searchsorted(row, np.arange(1, n)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off, BLOCK):
                words, row, number = _distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                named = np.isin(row, row[np.isin(number, [k for k, w in enumerate(words) if w in _LINE])])
                own, others = by_row(*_row_features(words, row, number, known), j - i), [[] for _ in range(j - i)]
                for k in range(1, swaps + 1):
                    changed = by_row(*_row_features(_swapped(words, k), row[named], number[named], known), j - i)
                    for r in np.unique(row[named]).tolist():
                        others[r].append(changed[r])
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(i, j - i).cast(pa.int32()), pa.array(own, schema[1].type), pa.array(others, schema[2].type)], schema=schema)

    return sample.mapInArrow(run, "toxic int, features array<int>, swapped array<array<int>>")


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([y for x in lists for y in x], np.int64)


def train(toxic: np.ndarray, own: list[list[int]], swapped: list[list[list[int]]], n: int, fit: Fit = Fit()) -> tuple[float, np.ndarray]:
    """Bias and weights that make mean cross entropy + ridge * |w|**2 / 2 + fairness * mean square change of score least.

    Accelerated gradient steps on the given, bounded number of rows; every weight has the step that its column allows.
    """
    row, col = _sparse(own)
    pairs = [(i, other) for i, others in enumerate(swapped) for other in others]
    a_row, a_col = _sparse([own[i] for i, _ in pairs])
    b_row, b_col = _sparse([other for _, other in pairs])
    d_row, d_col, d_val = np.concatenate([a_row, b_row]), np.concatenate([a_col, b_col]), np.repeat([1.0, -1.0], [len(a_row), len(b_row)])
    m, p, y = len(toxic), max(len(pairs), 1), toxic.astype(float)
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4) if m else 0.5
    size = np.bincount(row, minlength=m) + 1.0
    d_size = np.bincount(d_row, minlength=p) if len(d_row) else np.zeros(p)
    # bounds of the curvature by column: rows weigh with their number of features
    bound = np.bincount(col, size[row], n) / (4 * max(m, 1)) + fit.ridge
    if len(d_row):
        bound += 2 * fit.fairness / p * np.bincount(d_col, d_size[d_row], n)
    bias_bound = size.mean() / 4 if m else 1.0
    w, b = np.zeros(n), float(np.log(rate / (1 - rate)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(fit.steps if m else 0):
        z = np.bincount(row, v[col], m) + c
        err = (1 / (1 + np.exp(-z)) - y) / m
        grad = np.bincount(col, err[row], n) + fit.ridge * v
        if len(d_row):
            change = np.bincount(d_row, d_val * v[d_col], p)
            grad += 2 * fit.fairness / p * np.bincount(d_col, d_val * change[d_row], n)
        w_next, b_next, t_next = v - grad / bound, c - err.sum() / bias_bound, (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (grad * (w_next - w)).sum() > 0:  # the momentum leads uphill
            t_next = 1.0
        v, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return b, w


def fitted(sample: DataFrame, fit: Fit = Fit()) -> tuple[np.ndarray, float, np.ndarray]:
    """Features, bias and weights of the classifier, from at most ``fit.rows`` rows (text, toxic)."""
    known = telling_features(sample, fit)
    rows = _rows(sample, known, fit.swaps).toArrow().to_pylist()  # of fit.rows texts, the places of telling features alone
    bias, weights = train(np.array([r["toxic"] for r in rows]), [r["features"] for r in rows], [r["swapped"] for r in rows], len(known), fit)
    return known, bias, weights


def scores(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray]) -> DataFrame:
    """(doc_id, score): of every row, whole; the features' weights are as many as ``Fit.features`` at most."""
    known, bias, weights = model
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off, BLOCK):
                row, feature = _row_features(*_distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i]), known)
                z = np.bincount(row, weights[feature], j - i) + bias
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, score, predicted): how toxic every text is, from 0 to 1, and whether that is ``threshold`` or more.

    Labels (doc_id, toxic) are learnt from documents alone whose crc32 of the id as text leaves a remainder other than 2
    when divided by 4; ``held_out`` marks the others. A score depends on the text: rows of equal text score alike, and
    null and empty texts get the score of a text without any known feature. A null id is not held out and has no label.
    An id with two labels or several texts is learnt as often; labels other than 0 and 1 are none. Without both labels in the sample every score is the
    share of toxic ones (0.5 without any). Other columns are not looked at; an empty table gives an empty one.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    sample = stage(labelled_sample(docs.filter(~held_out), labels.filter(~held_out), fit))
    found = scores(docs, fitted(sample, fit))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
