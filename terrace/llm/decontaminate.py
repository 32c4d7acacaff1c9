"""Benchmark decontamination by winnowing.

Each text is reduced to winnowed fingerprints: of every ``span - gram + 1`` consecutive word grams the least hash is
kept, so two texts that share ``span`` words share a fingerprint. Training fingerprints meet those of the benchmark
first in a bitmap of fixed size (a semi-join reduction); each hit is extended to the windows of ``span`` words around
it, and these are joined exactly with the benchmark's windows. Items shorter than ``span`` are one window each, found
by the hash of the whole item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, blocks, buffers, gram_hashes, gram_rows, minimisers, word_hashes, word_spans
from .tables import SLOTS, aside, bitmap, known_small, stage

GRAM = 5
_HIT = "array<struct<start:int,len:int,key:binary>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("key", pa.binary())]))


def _window_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, span: int) -> list[bytes]:
    """A 16-byte digest of each window of ``span`` words from word ``at`` on."""
    out = []
    for i in at.tolist():
        s, e = starts[i : i + span], ends[i : i + span]
        raw = LOWER[data[s[0] : e[-1]]].tobytes()
        out.append(hashlib.blake2b(b" ".join(raw[x:y] for x, y in zip((s - s[0]).tolist(), (e - s[0]).tolist())), digest_size=16).digest())
    return out


def _fingerprints(hashes: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places of the winnowed grams of all rows, and their hashes."""
    place, row = gram_rows(first, GRAM)
    grams = gram_hashes(hashes, GRAM)[place] if len(place) else np.zeros(0, np.uint64)
    chosen = minimisers(grams, span - GRAM + 1, row)
    return place[chosen], grams[chosen]


def benchmark_windows(items: DataFrame, span: int = 10) -> DataFrame:
    """(item_id, n_words, key, print): every window of an item, and on fingerprint rows (key null) the slots it occupies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            ids = batch["item_id"].to_pylist()
            for i, j in blocks(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, first = word_spans(part, cut, ALNUM)
                hashes = word_hashes(part, starts, ends)
                out: list[tuple] = []
                for row, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    n = int(b - a)
                    if n and n < span:
                        out.append((ids[i + row], n, _window_keys(part, starts, ends, np.array([a]), n)[0], int(gram_hashes(hashes[a:b], n)[0] % np.uint64(SLOTS))))
                    elif n:
                        out += [(ids[i + row], span, k, None) for k in dict.fromkeys(_window_keys(part, starts, ends, np.arange(a, b - span + 1), span))]
                _, prints = _fingerprints(hashes, first, span)
                out += [(None, None, None, int(x)) for x in np.unique(prints % np.uint64(SLOTS))]
                yield pa.RecordBatch.from_pylist([dict(zip(_BENCH.names, x)) for x in out], schema=_BENCH)

    return items.select("item_id", "text").mapInArrow(run, "item_id long, n_words int, key binary, print long")


_BENCH = pa.schema([("item_id", pa.int64()), ("n_words", pa.int32()), ("key", pa.binary()), ("print", pa.int64())])


def _finder(docs: DataFrame, bits: np.ndarray, short: list[int], span: int):
    """A function from bytes and row edges to the words of each row and, by row, the windows around known fingerprints."""
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def seen(x: np.ndarray) -> np.ndarray:
        x = (x % np.uint64(SLOTS)).astype(np.int64)
        return (known.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1

    def hits(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, dict[int, list[dict]]]:
        starts, ends, first = word_spans(data, cut, ALNUM)
        hashes = word_hashes(data, starts, ends)
        place, prints = _fingerprints(hashes, first, span)
        place = place[seen(prints)]
        row = np.searchsorted(first, place, "right") - 1
        lo, hi = np.maximum(place - (span - GRAM), first[row]), np.minimum(place, first[row + 1] - span)
        windows = [(int(x), span) for x in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]))] if len(place) else []
        for k in short:
            at, _ = gram_rows(first, k)
            windows += [(int(x), k) for x in at[seen(gram_hashes(hashes, k)[at])]] if len(at) else []
        found: dict[int, list[dict]] = {}
        for x, k in windows:
            r = int(np.searchsorted(first, x, "right")) - 1
            found.setdefault(r, []).append({"start": x - int(first[r]), "len": k, "key": _window_keys(data, starts, ends, np.array([x]), k)[0]})
        return np.diff(first), found

    return hits


def candidates(docs: DataFrame, bits: np.ndarray, short: list[int], span: int = 10) -> DataFrame:
    """(doc_id, n_words, hits): for each document the windows around fingerprints that the bitmap knows."""
    hits = _finder(docs, bits, short, span)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", _HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off):
                counts, found = hits(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([found.get(r) for r in range(j - i)], _HITS)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, hits {_HIT}")


def with_hits(docs: DataFrame, bits: np.ndarray, short: list[int], span: int = 10) -> DataFrame:
    """docs with ``__hits``: the windows around fingerprints that the bitmap knows, null without any."""
    hits = _finder(docs, bits, short, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            out: list[list[dict] | None] = [None] * batch.num_rows
            for i, j in blocks(off):
                for r, found in hits(data[off[i] : off[j]], off[i : j + 1] - off[i])[1].items():
                    out[i + r] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _HITS)], names=[*batch.schema.names, "__hits"])

    return docs.mapInArrow(run, docs.withColumn("__hits", F.lit(None).cast(_HIT)).schema)


def covered(spans: str) -> F.Column:
    """SQL for the number of places covered by an array of (start, len)."""
    return F.expr(
        f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0L), (a, x) -> named_struct("
        "'n', a.n + greatest(0L, x.start + x.len - greatest(a.to, CAST(x.start AS LONG))), 'to', greatest(a.to, CAST(x.start + x.len AS LONG))), a -> a.n)"
    )


def _benchmark(items: DataFrame, span: int) -> tuple[np.ndarray, list[int], DataFrame]:
    """The bitmap of the items' fingerprints, the lengths of short items, and the (key, item_id) of all windows."""
    bench = benchmark_windows(items, span)
    bits = np.zeros(SLOTS, bool)
    for row in bitmap(bench.filter("print IS NOT NULL"), F.col("print")).collect():  # 256 rows of 4 KB at most
        part = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        at = (row["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part.astype(bool)[: SLOTS - at]
    short = [r[0] for r in bench.filter(f"key IS NOT NULL AND n_words < {span}").select("n_words").distinct().collect()]  # span - 1 at most
    return bits, sorted(short), known_small(bench.filter("key IS NOT NULL").select("key", "item_id").distinct())


def contamination(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items): per document its words, those inside a benchmark window, and the items met.

    Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. A window is ``span`` consecutive
    words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no words and no
    hits; null item ids count as no item, though their windows mark words; an item that occurs twice counts once;
    each document row gives one result row, also if rows repeat. Without items nothing is hit; without documents there
    are no rows. Other columns of either table are left out.
    """
    bits, short, windows = _benchmark(items, span)
    rows = candidates(docs, bits, short, span).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    met = each.join(windows.withColumn("met", F.lit(True)), "key", "left")
    out = met.groupBy("row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("met"), F.struct("start", "len"))).alias("spans"), F.collect_set(F.when(F.col("met"), F.col("item_id"))).alias("items")
    )
    return out.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The rows of docs that share no window with the items; their columns stay as they are.

    Each row is judged by its own text: null and repeated ids are no exception. Rows without a fingerprint of the items
    are kept where they are; only rows with one may be shuffled.
    """
    own, back = aside(docs, ("__row", "__hits"))
    bits, short, windows = _benchmark(items, span)
    ids = own.withColumn("__row", F.monotonically_increasing_id())
    rows = stage(with_hits(ids, bits, short, span))  # written, so that all reads see the same numbers
    maybe = rows.filter("__hits IS NOT NULL")
    met = maybe.select("__row", F.explode("__hits").alias("hit")).select("__row", "hit.key").join(windows.select("key").distinct(), "key", "left_semi")
    clean = maybe.join(known_small(stage(met.select("__row").distinct())), "__row", "left_anti")
    out = rows.filter("__hits IS NULL").unionByName(clean).drop("__row", "__hits").withColumnsRenamed(back)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
