"""Fill-in-the-middle transformation: a text is cut in three at token limits and its middle is put last.

Tokens are runs of ASCII letters, and every other character. They are counted by content-defined chunks: a gear hash
sets the chunk ends, so texts that share a passage share its chunks. A chunk's summary (tokens, characters, whether a
letter opens and closes it) is kept in a bounded cache under the chunk's content; a text's summaries are put together,
a run of letters that crosses a chunk end counting once, and their running counts say which chunk holds a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, buffers
from .chunk_dedup import WINDOW, cuts, gear

#: What opens the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A chunk ends where that many leading bits of the hash are 0; least and most bytes of a chunk.
BITS, LEAST, MOST = 9, 64, 4096
#: Bytes of chunk contents in the cache of a Python worker.
CACHE = 32 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that begin a character.
_LEAD = (np.arange(256) & 0xC0) != 0x80
Summary = tuple[int, int, bool, bool]


def token_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """True at bytes that begin a token; ``heads`` are the places where a chunk begins, before which nothing is seen."""
    letter = _LETTER[data]
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[:-1]
    follows[heads] = False
    return np.where(letter, ~follows, _LEAD[data])


class Cache:
    """Summaries by chunk content, in two generations: the older is let go when the younger is full."""

    def __init__(self, size: int = CACHE):
        self.half, self.used = size // 2, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def get(self, chunk: bytes) -> Summary | None:
        found = self.young.get(chunk)
        if found is None and (found := self.old.get(chunk)) is not None:
            self.put(chunk, found)
        return found

    def put(self, chunk: bytes, summary: Summary) -> None:
        if self.used + len(chunk) > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[chunk] = summary
        self.used += len(chunk)


def summaries(chunks: list[bytes], cache: Cache) -> list[Summary]:
    """The summary of every chunk; those that the cache doesn't have are counted together."""
    known = {x: cache.get(x) for x in dict.fromkeys(chunks)}
    fresh = [x for x, found in known.items() if found is None]
    if fresh:
        data = np.frombuffer(b"".join(fresh), np.uint8)
        ends = np.cumsum([len(x) for x in fresh])
        heads = ends - [len(x) for x in fresh]
        tokens = np.add.reduceat(token_starts(data, heads), heads, dtype=np.int64).tolist()
        chars = np.add.reduceat(_LEAD[data], heads, dtype=np.int64).tolist()
        opens, closes = _LETTER[data[heads]].tolist(), _LETTER[data[ends - 1]].tolist()
        for x, summary in zip(fresh, zip(tokens, chars, opens, closes)):
            known[x] = summary
            cache.put(x, summary)
    return [known[x] for x in chunks]


def _cut(chunks: list[bytes], tokens: np.ndarray, chars: np.ndarray, joined: np.ndarray, units: int) -> tuple[int, int]:
    """Bytes and characters of the first ``units`` tokens; ``tokens`` and ``chars`` run up to each chunk's end."""
    if units == 0:
        return 0, 0
    k = int(np.searchsorted(tokens, units, "right"))  # the chunk where token number ``units`` (from 0) begins
    if k == len(chunks):
        return sum(map(len, chunks)), int(chars[-1])
    before = int(tokens[k - 1]) if k else 0
    data = np.frombuffer(chunks[k], np.uint8)
    at = int(np.flatnonzero(token_starts(data, np.array([0])))[units - before + bool(joined[k])])
    return sum(map(len, chunks[:k])) + at, (int(chars[k - 1]) if k else 0) + int(_LEAD[data[:at]].sum())


def arrange(raw: bytes, chunks: list[bytes], found: list[Summary], draws: tuple[int, int, int, int], rate: int, swapped: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, characters of the prefix, of the middle, output) of one text."""
    tokens, chars, opens, closes = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    joined = np.zeros(len(chunks), bool)
    joined[1:] = opens[1:] & closes[:-1]
    tokens, chars = np.cumsum(tokens - joined), np.cumsum(chars)
    n = int(tokens[-1]) if found else 0
    a, b, keep, kind = draws
    if not raw or keep % 100 >= rate or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    (start, before), (end, after) = (_cut(chunks, tokens, chars, joined, k) for k in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = raw[:start], raw[start:end], raw[end:]
    if kind % 100 < swapped:
        return n, "spm", before, after - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, after - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def chunked(data: np.ndarray, off: np.ndarray) -> list[list[bytes]]:
    """The chunks of every text of a block; they depend on the text alone."""
    raw, free = data.tobytes(), np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    edge, out = np.searchsorted(free, off, "right"), []
    for r in range(len(off) - 1):
        base, end = int(off[r]), int(off[r + 1])
        places = free[edge[r] : edge[r + 1]]
        places = places[places >= base + WINDOW] - base  # the hash has seen this text alone
        ends = cuts(places.tolist(), end - base, LEAST, MOST)
        out.append([raw[base + a : base + b] for a, b in zip([0, *ends], ends)])
    return out


def fill_in_middle(docs: DataFrame, rate: int = 90, swapped: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text with its middle put last.

    ``n`` counts the tokens. The first four groups of eight hex digits of sha256 of ``1:`` and the id say where the
    prefix and the middle end (after 0 to n tokens), whether the text is changed (``rate`` in 100) and whether the
    suffix goes first (``swapped`` in 100 of the changed). ``form`` is ``psm`` or ``spm``; it is ``plain``, with null
    counts, for texts left as they are: empty or null ones (null becomes empty) and those that hold one of the marks.
    Every row is handled by itself: rows of equal id and text give equal rows, and a null id counts as no digits.
    Other columns are left out, whatever their names; an empty table gives an empty one.
    """
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    plan = docs.select("doc_id", "text", *[F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    kind = plan.schema["doc_id"].dataType
    cache: list[Cache] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Cache())
        for batch in batches:
            data, off = buffers(batch["text"])
            draws = list(zip(*(batch[f"h{i}"].to_pylist() for i in range(1, 5))))
            for i, j in blocks(off):
                parts = chunked(data[off[i] : off[j]], off[i : j + 1] - off[i])
                found, out, at = summaries([x for own in parts for x in own], cache[0]), [], 0
                for own, draw in zip(parts, draws[i:j]):
                    out.append(arrange(b"".join(own), own, found[at : at + len(own)], draw, rate, swapped))
                    at += len(own)
                n, form, before, middle, texts = zip(*out)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return plan.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` had, from its output and form: no part holds a mark, so the marks cut it again."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
