"""Phrase collocations, counted without loss in counting quotient filters.

A word's id is a hash of fewer bits than usual, chosen by the number of distinct words; the few words whose hashes
meet get numbers of their own, so ids are exact. The ids of a phrase are packed into one number of up to 126 bits, an
invertible permutation spreads it, and a filter keeps its upper bits as quotients (only how many entries each has) and
the others as full remainders: the entries can be turned back into words. Every task fills filters of bounded size,
cut into shards by the quotient; shards of all tasks are merged in sorted order, and rare phrases go.

Phrases grow by one word a pass: a phrase is counted only where both its parts without the last and without the first
word may be frequent, which a bitmap says (it may err on the side of counting).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, blocks, buffers, byte_table, mix, word_spans
from .tables import bitmap, stage

_U = np.uint64
#: Parts of a language among which the first phrases are looked for, before these are compared with each other.
PARTS = (4096, 64)
#: Bytes of text that are looked at together; entries that a task's filter holds before it is handed on; words a shard.
BLOCK, ENTRIES, SHARD = 4 << 20, 1 << 21, 1 << 20
#: Words are runs of bytes other than white space and the marks that end a piece.
WORD = byte_table("20 09 0A-0D 21 2C 2E 3A-3B 3F")
PIECE = ~byte_table("0A-0D 21 2C 2E 3A-3B 3F")
FILTER = (
    "lang string, shard int, entries long, quotient_bits int, runs binary, long_runs binary, left binary, right binary, counts binary, long_counts binary"
)
#: Spark's xxhash64 has this seed.
_SEED = 42
_ROUNDS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


# Words


def _words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word among these, its row, and whether the next word follows in its piece."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, WORD)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=size[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data[WORD[data]])]).dictionary_encode()
    marks = np.cumsum(PIECE[data])
    joined = np.zeros(len(starts), bool)
    if len(starts) > 1:
        joined[:-1] = (row[1:] == row[:-1]) & (marks[starts[1:]] == marks[ends[:-1] - 1])
    return found.dictionary, found.indices.to_numpy(), row, joined


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for batch in batches:
        data, off = buffers(batch["text"])
        for i, j in blocks(off, BLOCK):
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], batch["lang"].slice(i, j - i).dictionary_encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word occurs in the texts of a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, langs in _texts(batches):
            words, codes, row, _ = _words(data, off)
            size = max(len(words), 1)
            keys, counts = np.unique(langs.indices.to_numpy()[row].astype(np.int64) * size + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // size)), words.take(pa.array(keys % size)).cast(pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Ids:
    """Word ids of ``bits`` bits: a hash in the lower ones, or with the highest bit a number given to a word whose hash is taken."""

    def __init__(self, bits: int, numbered: dict[bytes, int]):
        self.bits, self.numbered = bits, numbered

    def of(self, words: pa.Array) -> np.ndarray:
        low, high = (1 << self.bits - 1) - 1, 1 << self.bits - 1
        raw = words.cast(pa.binary()).to_pylist()
        out = [xxhash.xxh64_intdigest(w, _SEED) & low for w in raw]
        if self.numbered:
            out = [high | k if (k := self.numbered.get(w)) is not None else x for w, x in zip(raw, out)]
        return np.array(out, _U)


def word_ids(words: DataFrame, longest: int = 3) -> Ids:
    """Ids that tell all words of ``words`` apart, of an even number of bits; a phrase of ``longest`` takes 126 bits at most.

    With v words some v**2 / 2**bits meet another's hash: by the choice of bits 2048 up to v = 2**26 for phrases of
    three words, and a quarter of a million at 2**30. Only these are known to the driver.
    """
    rows = words.count()
    bits = min(max(2 * max(rows - 1, 1).bit_length() - 10, 20), 126 // longest)
    bits -= bits % 2
    code = F.xxhash64("word").bitwiseAND(F.lit((1 << bits - 1) - 1))
    coded = words.select("word", code.alias("code"))
    met = coded.groupBy("code").agg(F.min("word").alias("keeps"), F.max("word").alias("other")).filter("keeps <> other")
    later = coded.join(met, "code").filter("word <> keeps").select("word").distinct()
    return Ids(bits, {w.encode(): k for k, w in enumerate(sorted(r.word for r in later.toLocalIterator()))})


def _identified(words: DataFrame, ids: Ids) -> DataFrame:
    """(lang, ids, f, place, word) of words: ``ids`` has the one id."""
    schema = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("f", pa.int64()), ("place", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = ids.of(batch["word"])
            columns = [batch["lang"], _lists([codes]), batch["f"], pa.array(_place(*packed([codes], ids.bits)).astype(np.int64)), batch["word"]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, ids array<long>, f long, place long, word string")


def _lists(words: list[np.ndarray]) -> pa.Array:
    n = len(words)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words[0]) + 1) * n, pa.int32()), pa.array(np.stack(words, 1).ravel().astype(np.int64)))


# Numbers of phrases


def packed(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of phrases as one number each, in an upper and a lower half of equal size."""
    n, half = len(words), _U(bits // 2)

    def fold(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(words[0]), _U)
        for x in some:
            out = out << _U(bits) | x
        return out

    left, right = fold(words[: n // 2]), fold(words[n - n // 2 :])
    if n % 2:
        middle = words[n // 2]
        left, right = left << half | middle >> half, (middle & (_U(1) << half) - _U(1)) << _U(bits * (n // 2)) | right
    return left, right


def unpacked(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    half, one = _U(bits // 2), (_U(1) << _U(bits)) - _U(1)
    middle = []
    if n % 2:
        low = _U(bits * (n // 2))
        middle = [(left & (_U(1) << half) - _U(1)) << half | right >> low]
        left, right = left >> half, right & (_U(1) << low) - _U(1)
    part = [_U(bits * k) for k in reversed(range(n // 2))]
    return [left >> k & one for k in part] + middle + [right >> k & one for k in part]


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of numbers of twice ``half`` bits that spreads them evenly: rounds that change one half by the other."""
    mask = (_U(1) << _U(half)) - _U(1)
    for a, b in zip(_ROUNDS[::2], _ROUNDS[1::2]):
        right = right ^ mix(left + a) & mask
        left = left ^ mix(right + b) & mask
    return left, right


def original(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``permuted`` had."""
    mask = (_U(1) << _U(half)) - _U(1)
    for a, b in reversed(list(zip(_ROUNDS[::2], _ROUNDS[1::2]))):
        left = left ^ mix(right + b) & mask
        right = right ^ mix(left + a) & mask
    return left, right


def _place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """62 bits of a packed phrase, for a bitmap."""
    return mix(left * _ROUNDS[0] + mix(right + _ROUNDS[1])) >> _U(2)


# Filters


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys (the first array weighs most) put together, in order, with their counts added."""
    if not len(counts):
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(first)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at)


def _short(values: np.ndarray) -> tuple[bytes, bytes]:
    """Values as a byte each; those of 255 and more as 255, and in full aside."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype("<u8").tobytes()


def _long(short: bytes, aside: bytes) -> np.ndarray:
    out = np.frombuffer(short, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(aside, "<u8").astype(np.int64)
    return out


def _narrow(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8)[:, : -(-bits // 8)]).tobytes()


def _wide(raw: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if bits:
        out[:, : -(-bits // 8)] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8")[:, 0].astype(_U)


def encoded(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, shards: int) -> dict:
    """A filter of sorted, permuted phrases of one shard (the upper ``shards`` bits of ``left`` are equal)."""
    rest = half - shards
    bits = min(rest, max(len(left), 1).bit_length() - 1)
    low = left & (_U(1) << _U(rest)) - _U(1)
    runs = np.bincount((low >> _U(rest - bits)).astype(np.int64), minlength=1 << bits)
    remainder = low & (_U(1) << _U(rest - bits)) - _U(1)
    names = ("runs", "long_runs", "left", "right", "counts", "long_counts")
    return {"entries": len(left), "quotient_bits": bits} | dict(zip(names, (*_short(runs), _narrow(remainder, rest - bits), _narrow(right, half), *_short(counts))))


def decoded(row: dict, shard: int, half: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, bits, n = half - shards, row["quotient_bits"], row["entries"]
    quotient = np.repeat(np.arange(1 << bits, dtype=_U), _long(row["runs"], row["long_runs"]))
    left = _U(shard) << _U(rest) | quotient << _U(rest - bits) | _wide(row["left"], rest - bits, n)
    return left, _wide(row["right"], half, n), _long(row["counts"], row["long_counts"])


def _allowed(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places & _U(8 * len(bits) - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def filters(docs: DataFrame, n: int, ids: Ids, allowed: np.ndarray, shards: int) -> DataFrame:
    """FILTER rows of the phrases of n words both of whose parts of n - 1 words may be frequent, by the bitmap ``allowed``."""
    half = n * ids.bits // 2
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("entries", pa.int64()), ("quotient_bits", pa.int32()), *((k, pa.binary()) for k in ("runs", "long_runs", "left", "right", "counts", "long_counts"))])

    def handed_on(keys: list[np.ndarray], counts: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        lang, left, right = keys
        group = lang << _U(shards) | left >> _U(half - shards)
        cuts = np.flatnonzero(np.diff(group, prepend=group[:1] + _U(1), append=group[-1:] + _U(1)))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = {"lang": langs[int(lang[a])], "shard": int(group[a]) & (1 << shards) - 1}
            rows.append(own | encoded(left[a:b], right[a:b], counts[a:b], half, shards))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held, size = [], 0
        for data, off, own in _texts(batches):
            words, codes, row, joined = _words(data, off)
            code = ids.of(words)[codes] if len(words) else np.zeros(0, _U)
            number = np.array([langs.setdefault(x, len(langs)) for x in own.dictionary.to_pylist()] or [0], _U)
            places = len(code) - n + 1
            if places <= 0:
                continue
            at = np.flatnonzero(_starts(code, joined, n, ids.bits, allowed))
            keys = permuted(*packed([code[at + k] for k in range(n)], ids.bits), half)
            keys, counts = summed([number[own.indices.to_numpy()[row[at]]], *keys], np.ones(len(at), np.int64))
            held.append((keys, counts))
            size += len(counts)
            if size > ENTRIES:
                held = [summed([np.concatenate(x) for x in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held]))]
                size = len(held[0][1])
                if 2 * size > ENTRIES:
                    yield from handed_on(*held[0], list(langs))
                    held, size = [], 0
        if size:
            yield from handed_on(*summed([np.concatenate(x) for x in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held])), list(langs))

    return docs.mapInArrow(run, FILTER)


def _starts(code: np.ndarray, joined: np.ndarray, n: int, bits: int, allowed: np.ndarray) -> np.ndarray:
    """Where a phrase of n words begins that lies in one piece and whose two parts of n - 1 words may be frequent."""
    m, places = n - 1, len(code) - n + 1
    part = _allowed(allowed, _place(*packed([code[k : k + places + 1] for k in range(m)], bits)))
    whole = np.ones(places, bool)
    for k in range(m):
        whole &= joined[k : k + places]
    return whole & part[:-1] & part[1:]


def merged(rows: DataFrame, n: int, ids: Ids, shards: int, min_count: int) -> DataFrame:
    """(lang, ids, f, place) of the phrases that all filters together hold ``min_count`` times or more."""
    half, bits = n * ids.bits // 2, ids.bits
    schema = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("f", pa.int64()), ("place", pa.int64())])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        lang, shard = (x.as_py() for x in key)
        parts = [decoded(row, shard, half, shards) for batch in table.to_batches() for row in batch.to_pylist()]
        (left, right), counts = summed([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], np.concatenate([p[2] for p in parts]))
        many = counts >= min_count
        left, right = original(left[many], right[many], half)
        columns = [pa.array([lang] * int(many.sum()), pa.string()), _lists(unpacked(left, right, n, bits)), pa.array(counts[many]), pa.array(_place(left, right).astype(np.int64))]
        return pa.Table.from_arrays(columns, schema=schema)

    return rows.groupBy("lang", "shard").applyInArrow(merge, "lang string, ids array<long>, f long, place long")


def _bitmap(found: DataFrame) -> np.ndarray:
    """A bitmap of the places of found phrases, of 16 bits for each, 16 MB at most: when fuller, more is counted in vain."""
    slots = min(max(16 * found.count(), 1 << 20), 1 << 27)
    slots = 1 << (slots - 1).bit_length()
    out = np.zeros(slots // 8, np.uint8)
    for row in bitmap(found, F.col("place").bitwiseAND(F.lit(slots - 1))).toLocalIterator():
        bits = np.frombuffer(row.bits, np.uint8)
        at = row.bucket * 4096 - 4096
        out[at : at + 4096] |= bits[: len(out) - at]
    return out


def phrase_counts(docs: DataFrame, longest: int = 3, min_count: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): all words of each language; and for 1 to ``longest`` words (lang, ids, f, place), for one word also ``word``."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = stage(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ids = word_ids(words, longest)
    n = words.agg(F.sum("f")).first()[0] or 0
    shards = min(max(-(-n // SHARD) - 1, 1).bit_length(), ids.bits // 2)
    found = [stage(_identified(words.filter(F.col("f") >= min_count), ids))]
    for k in range(2, longest + 1):
        found.append(stage(merged(filters(docs, k, ids, _bitmap(found[-1]), shards), k, ids, shards, min_count)))
    return totals, found


def _first(df: DataFrame, number: Column, down: list[str], up: list[str], top: int, parts: tuple[int, ...]) -> DataFrame:
    """The rows that are among the first ``top`` of their part of a language, parts being put together step by step."""
    part = F.pmod(F.xxhash64("ids"), F.lit(parts[0]))
    for n in parts:
        place = Window.partitionBy("lang", F.pmod(part, F.lit(n))).orderBy(*[F.desc(c) for c in down], *up)
        df = df.withColumn("__place", number.over(place)).filter(F.col("__place") <= top).drop("__place")
    return df


def collocations(docs: DataFrame, longest: int = 3, min_count: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of 2 to ``longest`` words.

    Texts with A-Z as a-z are split into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs.
    A phrase counts wherever it occurs inside a piece, overlaps included; ``min_count`` occurrences make a candidate.
    Of the cuts of a candidate into two parts the one with the lowest score floor(10**6 a a / (l r)) counts, the
    leftmost of equals. Candidates inside a longer candidate with at least ``share`` percent of their occurrences go.
    Order is by score and a, both descending, then by phrase. Every row is a text, repeated ones too; null text is
    empty; a null language is ``und``. Other columns are not looked at; an empty table gives an empty one.
    """
    totals, found = phrase_counts(docs, longest, min_count)
    kept = None
    for n in range(2, longest + 1):
        c = found[n - 1].select("lang", "ids", F.col("f").alias("a"))
        for k in range(1, n):
            for name, part in ((f"l{k}", (1, k)), (f"r{k}", (k + 1, n - k))):
                own = found[part[1] - 1].select("lang", F.col("ids").alias("__part"), F.col("f").alias(name))
                c = c.withColumn("__part", F.slice("ids", *part)).join(own, ["lang", "__part"]).drop("__part")
        cuts = [f"named_struct('score', (1000000BD * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l{k} AS DECIMAL(15,0)) * CAST(r{k} AS DECIMAL(15,0))), 'k', {k}, 'l', l{k}, 'r', r{k})" for k in range(1, n)]
        c = c.selectExpr("lang", "ids", "a", f"array_min(array({', '.join(cuts)})) AS cut")
        longer = None
        for m in range(n + 1, longest + 1):
            inside = found[m - 1].select("lang", F.explode(F.array(*[F.slice("ids", i + 1, n) for i in range(m - n + 1)])).alias("ids"), "f")
            longer = inside if longer is None else longer.unionByName(inside)
        if longer is not None:
            c = c.join(longer.groupBy("lang", "ids").agg(F.max("f").alias("longer")), ["lang", "ids"], "left").filter(f"longer IS NULL OR 100 * longer < {int(share)} * a")
        c = c.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")
        kept = c if kept is None else kept.unionByName(c)
    best = stage(_first(kept, F.rank(), ["score", "a"], [], top, PARTS))  # equals of the last one stay for now
    named = best.withColumn("phrase", F.lit(None).cast("string"))
    for i in range(longest):
        word = found[0].select("lang", F.col("ids")[0].alias("__id"), "word")
        named = named.withColumn("__id", F.get("ids", F.lit(i))).join(word, ["lang", "__id"], "left")
        named = named.withColumn("phrase", F.when(F.col("word").isNull(), F.col("phrase")).otherwise(F.concat_ws(" ", "phrase", "word"))).drop("word", "__id")
    out = _first(named, F.row_number(), ["score", "a"], ["phrase"], top, PARTS)
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
