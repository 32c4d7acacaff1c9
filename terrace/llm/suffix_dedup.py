"""Suffix-array dedup: remove every byte inside a string of ``span`` bytes that starts anywhere else too.

A depth-limited radix sort orders suffixes only through their first ``span`` bytes, most significant digit first, and
goes on only with groups of more than one member; the groups left at full depth are exactly the repeated strings.

The suffixes are taken at anchors: the ``ANCHOR``-byte gram of least hash inside a string is the same, at the same
place, in all equal strings, so strings can only be equal if their anchors are. One anchor stands for all strings
around it, about 75 of them, and a row is shuffled for each anchor instead of for each byte. The passes are:

1. Spark groups the anchors by their gram; anchors that occur once drop out.
2. Anchors whose whole surroundings are equal become one row with a count.
3. In each group the suffixes from the anchor on are sorted by digits of 8 bytes, pass by pass through ``span`` bytes,
   and so are the prefixes before it, read backwards; a suffix that is alone after a pass takes no part in the next.
   A string around the anchor is the pair of its prefix and its suffix, each cut off where the string ends: two strings
   are equal where both are in the same group at that depth. Equal here means equal bytes.

Groups of very many anchors are first narrowed by the place of the strings around them. A string that begins ``l`` bytes
before the anchor, for l from a to b, holds the a bytes before it and the bytes after it that the string with l = b
still reaches; so the strings of an anchor are halved by l, and each half meets only anchors with the same bytes there.
Surroundings that are equal in all that a half's strings reach are repeats and go on as one; those that are alone
drop out; groups that are still large are halved again. In the end a half is one string, and its group one surrounding.
Rows meet by digests of these bytes (64 bits for groups, in which bytes are compared, 128 for equal surroundings).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BLOCK, blocks, buffers, mix, powers, sliding_min
from .cutting import cut_out, keep_texts, keyed
from .tables import bitmap_filter, stage

_U = np.uint64
ANCHOR = 50
#: Groups of more anchors than this are narrowed by the bytes around them.
GROUP = 4000
#: Rows of whole groups that one pass sorts together.
TOGETHER = 4000


def gram_bytes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes."""
    n = max(len(data) - k + 1, 0)
    out = np.empty(n, _U)
    for i in range(0, n, BLOCK):
        part = data[i : i + BLOCK + k - 1]
        m = len(part) - k + 1
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        out[i : i + m] = mix((sums[k : k + m] - sums[:m]) * down[:m])
    return out


def anchors_of(data: np.ndarray, cut: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers of all strings of ``span`` bytes that lie in one row, and their hashes.

    The least of the hashes' upper 40 bits counts, and of equal ones the leftmost, which equal strings agree on.
    """
    h = gram_bytes(data, ANCHOR)
    n = len(data) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    row = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
    whole = row[:n] == row[span - 1 :]
    low = _U((1 << 24) - 1)
    place = np.arange(len(h), dtype=_U)
    least = sliding_min((h & ~low) | (place & low), span - ANCHOR + 1)[whole]
    at = place[:n][whole]
    chosen = (at + ((least - at) & low)).astype(np.int64)
    chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
    return chosen, h[chosen]


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, version, pos, h): the anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off):
                cut = off[i : j + 1] - off[i]
                at, h = anchors_of(data[off[i] : off[j]], cut, span)
                row = np.searchsorted(cut, at, "right") - 1
                of = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(of).cast(pa.int64()), batch["version"].take(of), pa.array((at - cut[row]).astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "version", "pos", "h"]
                )

    return docs.mapInArrow(run, "doc_id long, version long, pos int, h long")


def surroundings(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, version, pos, h, n, lo, around): the repeated anchors, each with the bytes that strings around it can reach.

    n: occurrences of the anchor; lo: bytes of ``around`` before the anchor. docs come from ``keyed``.
    """
    found = anchors(docs, span)
    twice = stage(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    each = stage(found.join(twice, "h").groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "h", "n")).alias("anchors")))
    reach = span - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, version, text, found in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["text"], batch["anchors"]):
                raw, flat = text.as_buffer().to_pybytes(), found.values
                pos, h, n = (flat.field(k).to_numpy() for k in range(3))
                pos, once = np.unique(pos, return_index=True)  # each row of equal id and text has brought its anchors
                h, n = h[once], n[once]
                for i in range(0, len(pos), 20_000):
                    p = pos[i : i + 20_000]
                    lo = np.minimum(p, reach)
                    around = [raw[a:b] for a, b in zip((p - lo).tolist(), (p + span).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(p), pa.int64()), pa.array([version] * len(p), pa.int64()), pa.array(p), pa.array(h[i : i + 20_000]), pa.array(n[i : i + 20_000]),
                            pa.array(lo.astype(np.int32)), pa.array(around, pa.binary()),
                        ],
                        names=["doc_id", "version", "pos", "h", "n", "lo", "around"],
                    )

    texts = keep_texts(docs, each)
    return texts.select("doc_id", "version", "text", "anchors").mapInArrow(run, "doc_id long, version long, pos int, h long, n long, lo int, around binary")


def radix_order(table: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (group, bytes), and for each the bytes it shares with the row before it; -1 in a new group.

    A most-significant-digit radix sort: each pass sorts by the next 8 bytes inside the groups that are left, and
    a row that has become a group of its own takes no part in the passes after it.
    """
    rows, width = table.shape
    order = np.argsort(group, kind="stable")
    common = np.full(rows, width, np.int64)
    common[0] = -1
    common[1:][np.diff(group[order]) != 0] = -1
    for at in range(0, width, 8):
        new = common < width  # a row that begins a group
        segment = np.cumsum(new)
        live = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(live):
            break
        digit = np.zeros((len(live), 8), np.uint8)
        part = table[order[live], at : at + 8]
        digit[:, : part.shape[1]] = part
        digit = digit.view(">u8").ravel().astype(_U)
        by = np.lexsort((digit, segment[live]))
        order[live], digit = order[live][by], digit[by]
        differ = np.flatnonzero((digit[1:] != digit[:-1]) & (segment[live][1:] == segment[live][:-1])) + 1
        x = digit[differ] ^ digit[differ - 1]
        common[live[differ]] = at + 7 - sum(((x >> _U(8 * k)) > 0).astype(np.int64) for k in range(1, 8))
    return order, common


def _names(order: np.ndarray, common: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, depths): the number of the group of each row at each depth; and the greatest depth at which a row isn't alone."""
    rows = len(order)
    begins = np.where(common[:, None] < depths[None, :], np.arange(rows, dtype=np.int32)[:, None], np.int32(0))
    np.maximum.accumulate(begins, axis=0, out=begins)
    names = np.empty_like(begins)
    names[order] = begins
    most = np.empty(rows, np.int64)
    most[order] = np.maximum(common, np.append(common[1:], -1))
    return names, most


def equal_strings(around: pa.Array, lo: np.ndarray, group: np.ndarray, span: int, wanted: np.ndarray, copied: np.ndarray) -> np.ndarray:
    """Which of the span - ANCHOR + 1 strings of each row occur in another row of its group, or exist where the row is copied.

    wanted: which strings to look at, for each row; a string is compared with those at the same place in other rows.
    """
    reach = span - ANCHOR
    data, off = buffers(around)
    size = np.diff(off)
    rows, width = len(lo), reach + span
    table = np.zeros((rows, width), np.uint8)
    row = np.repeat(np.arange(rows), size)
    table[row, np.arange(len(data)) - np.repeat(off[:-1] - (reach - lo), size)] = data
    place = np.arange(reach + 1)
    valid = wanted & (place >= (reach - lo)[:, None]) & (place + span <= (reach - lo + size)[:, None])
    right, right_most = _names(*radix_order(table[:, reach:], group), ANCHOR + place)
    left, left_most = _names(*radix_order(np.ascontiguousarray(table[:, :reach][:, ::-1]), group), reach - place)
    some = valid & (ANCHOR + place <= right_most[:, None]) & (reach - place <= left_most[:, None])  # neither half is alone
    r, j = np.nonzero(some)
    again = np.zeros(valid.shape, bool)
    if len(r):
        keys = (j.astype(_U) << _U(56)) | (left[r, j].astype(_U) << _U(28)) | right[r, j].astype(_U)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again[r, j] = counts[inverse] > 1
    return again | (valid & copied[:, None])


def order_groups(groups: DataFrame, span: int) -> DataFrame:
    """(h, c1, c2, first, last): for each surrounding the first and last place of a repeated string.

    Rows come as (h, g, c1, c2, lo, around, count, a, b) with groups (h, g) together; only strings that begin a to b
    bytes before the anchor are looked at.
    """
    reach = span - ANCHOR

    def solve(rows: pa.Table) -> pa.RecordBatch:
        h, g, c1, c2, lo, count, a, b = (rows[k].to_numpy() for k in ("h", "g", "c1", "c2", "lo", "count", "a", "b"))
        group = np.cumsum(np.append(True, (np.diff(h) != 0) | (np.diff(g) != 0)))
        before = reach - np.arange(reach + 1)
        again = equal_strings(rows["around"], lo, group, span, (before >= a[:, None]) & (before <= b[:, None]), count > 1)
        some = again.any(axis=1)
        first, last = again.argmax(axis=1), again.shape[1] - 1 - again[:, ::-1].argmax(axis=1)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array(x[some], t) for x, t in zip((h, c1, c2, first, last), kinds)], names=["h", "c1", "c2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g = batch["h"].to_numpy(), batch["g"].to_numpy()
            starts = np.flatnonzero((np.diff(h) != 0) | (np.diff(g) != 0)) + 1
            at = 0
            for cut in [*starts.tolist(), batch.num_rows]:
                new_group = bool(held) and at < batch.num_rows and (held[-1]["h"][-1].as_py() != h[at] or held[-1]["g"][-1].as_py() != g[at])
                if new_group and size >= TOGETHER:
                    yield solve(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                held.append(batch.slice(at, cut - at))
                size += cut - at
                at = cut
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return groups.mapInArrow(run, "h long, c1 long, c2 long, first int, last int")


_NODE = "h long, g long, c1 long, c2 long, lo int, around binary, count long, a int, b int"


def halves(nodes: DataFrame, span: int) -> DataFrame:
    """Each row of a group twice: for the strings of its lower and of its upper half of beginnings, where it has any.

    g: digest of the bytes that all strings of the half hold; u1, u2: of all bytes that they reach; first, last: their places.
    """
    reach, mask = span - ANCHOR, (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[k].to_pylist() for k in ("h", "lo", "around", "a", "b")))
            of, out = [], []
            for i, (h, lo, raw, a, b) in enumerate(rows):
                after = len(raw) - lo
                middle = (a + b) // 2
                for p, q in ((a, middle), (middle + 1, b)):
                    low, high = max(p, span - after), min(q, lo)
                    if low > high:
                        continue
                    left, right = min(q, lo), min(span - p, after)
                    g = xxhash.xxh3_64_intdigest(raw[lo - p : lo + span - q], seed=(h + (p << 20) + (q << 40)) & mask)
                    u = xxhash.xxh3_128_intdigest(raw[lo - left : lo + right], seed=(left << 20) + right)
                    of.append(i)
                    out.append((signed(g), p, q, signed(u >> 64), signed(u & mask), reach - high, reach - low))
            g, p, q, u1, u2, first, last = zip(*out) if out else ((),) * 7
            at = pa.array(of, pa.int64())
            kept = [batch[k].take(at) for k in ("h", "c1", "c2", "lo", "around", "count")]
            whole = [pa.array(x, t) for x, t in ((g, pa.int64()), (p, pa.int32()), (q, pa.int32()), (u1, pa.int64()), (u2, pa.int64()), (first, pa.int32()), (last, pa.int32()))]
            yield pa.RecordBatch.from_arrays([kept[0], whole[0], *kept[1:], *whole[1:]], names=["h", "g", "c1", "c2", "lo", "around", "count", "a", "b", "u1", "u2", "first", "last"])

    return nodes.select("h", "g", "c1", "c2", "lo", "around", "count", "a", "b").mapInArrow(run, f"{_NODE}, u1 long, u2 long, first int, last int")


def narrowed(nodes: DataFrame, span: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(found, small): places (h, c1, c2, first, last) that are repeats already, and rows of groups of up to GROUP members.

    nodes are rows of larger groups. Only counts and digests are shuffled until it is known which rows meet others.
    """
    found, small = [], []
    by = ("g", "u1", "u2")
    while not nodes.isEmpty():
        halved = halves(nodes, span)
        slim = stage(halved.select(*by, "h", "c1", "c2", "first", "last"))
        same = stage(slim.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("c1", "c2")).alias("kept")))
        equal = same.filter("k > 1").select(*by)
        found.append(stage(slim.join(equal, [*by]).select("h", "c1", "c2", "first", "last")))
        sizes = same.groupBy("g").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        keepers = stage(same.join(sizes, "g").select(*by, "kept.c1", "kept.c2", "size"))
        rows = stage(bitmap_filter(halved, keepers, "g").join(keepers, [*by, "c1", "c2"]))
        small.append(rows.filter(F.col("size") <= GROUP))
        nodes = rows.filter(F.col("size") > GROUP)
    return found, small


def repeated_spans(docs: DataFrame, span: int = 200) -> DataFrame:
    """(doc_id, version, spans): the byte ranges (a, b) of each document that lie in repeated strings, not yet merged.

    docs come from ``keyed``.
    """
    of, reach = ("h", "c1", "c2"), span - ANCHOR
    around = stage(surroundings(docs, span).withColumns({"c1": F.xxhash64("lo", "around"), "c2": F.xxhash64("around", "lo")}))
    # equal surroundings meet before groups do, so that copies of one text are one row
    distinct = around.groupBy("h", "c1", "c2", "n", "lo", "around").agg(F.count(F.lit(1)).alias("count"))
    node = distinct.select("h", F.col("h").alias("g"), "c1", "c2", "lo", "around", "count", F.lit(0).alias("a"), F.lit(reach).alias("b"), "n")
    groups, found = node.filter(F.col("n") <= GROUP).drop("n"), []
    if not around.filter(F.col("n") > GROUP).isEmpty():
        hot = stage(node.filter(F.col("n") > GROUP).drop("n"))
        after = F.length("around") - F.col("lo")
        found.append(hot.filter("count > 1").select(*of, (reach - F.col("lo")).alias("first"), (reach - F.greatest(F.lit(0), span - after)).alias("last")))
        sure, small = narrowed(hot, span)
        found += sure
        for rows in small:
            groups = groups.unionByName(rows.select(*groups.columns))
    solved = order_groups(groups.repartition("h", "g").sortWithinPartitions("h", "g"), span)
    for places in found:
        solved = solved.unionByName(places)
    places = stage(solved.groupBy(*of).agg((F.min("first") - reach).alias("a"), (F.max("last") - reach + span).alias("b")))
    hits = around.select("doc_id", "version", "pos", *of).join(places, [*of])
    return hits.groupBy("doc_id", "version").agg(F.collect_list(F.struct((F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"))).alias("spans"))


def remove_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text as UTF-8 bytes without the bytes in repeated strings.

    A byte goes if a string of ``span`` bytes that holds it also starts anywhere else in the input, in the same
    document or another; overlapping strings count and all are judged on the input. kept is binary, since cuts may
    split a character. Every row is a document of its own, whatever its id: null and repeated ids are no exception,
    and rows of equal text are each other's repeats. Null and short texts keep what they have. Other columns are left
    out; an empty table gives an empty one.
    """
    docs = keyed(docs)
    spans = stage(repeated_spans(docs, span))
    return cut_out(docs, spans)
