"""Packing tokenised documents into fixed windows: best fit with a bounded number of open windows.

Every task keeps ``open_windows`` unfinished windows. A piece goes to the fullest window that it still fits; if none
has room, the fullest window is closed, its rest filled with the head of the piece where that is worth a cut. Windows
still open at the end of a task are merged in further rounds over fewer tasks, until a task has all that is left.
Only lengths travel between tasks, never token ids.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
#: Sequence ids of one task lie in a range of this size.
_PER_TASK = 1 << 33
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from a text to its ids as a uint32 array.

    Where the ranks of the same vocabulary lie beside the file, the quicker library reads those; the ids are equal.
    """
    if path not in _encoders:
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={"<|endoftext|>": len(known)})
            _encoders[path] = lambda text: own.encode_to_numpy(text, allowed_special="all")
        else:
            import numpy as np
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return _encoders[path]


class Windows:
    """The open windows of one task, ordered by how full they are."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.fill: list[tuple[int, int]] = []  # (tokens, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def place(self, pieces: list[tuple], length: int) -> list[tuple]:
        """Put pieces that belong together into the fullest window with room; gives the pieces of a window that this closes."""
        closed: list[tuple] = []
        at = bisect.bisect_right(self.fill, (self.size - length, 1 << 62)) - 1
        if at < 0:
            if len(self.fill) >= self.limit:
                closed = self.close()
            at, window = -1, self.next_id
            self.next_id += 1
            self.held[window], used = [], 0
        else:
            used, window = self.fill.pop(at)
        for piece in pieces:
            self.held[window].append((*piece, window, used))
            used += piece[2]
        if used == self.size:
            return closed + self.held.pop(window)
        bisect.insort(self.fill, (used, window))
        return closed

    def gap(self, length: int) -> int:
        """Free tokens of the fullest window, if a piece of this length fits nowhere and a window must be closed; else 0."""
        if len(self.fill) < self.limit or self.fill[0][0] + length <= self.size:
            return 0
        return self.size - self.fill[-1][0]

    def close(self) -> list[tuple]:
        _, window = self.fill.pop()
        return self.held.pop(window)


def _batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, PIECES)), pa.array([is_open] * len(rows), pa.bool_())], schema=PIECES)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, open_windows: int = 64, min_cut: int = 16, vocabulary: str | None = None, group: int = 64) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone; null ids and repeated rows stay
    as they are. Every id lies in exactly one piece. A document longer than a window fills whole windows first. Pieces
    are cut only to fill a window of ``min_cut`` or more free places that must be closed. ``group`` is the number of
    tasks whose open windows one task of the next round merges. Of windows that are equally full any may be taken. Other
    columns are left out; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        windows = Windows(size, open_windows, TaskContext.get().partitionId() * _PER_TASK)
        end = end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "").astype("<u4", copy=False).tobytes() + end
                total, at = len(ids) // 4, 0
                while at < total:
                    length = min(size, total - at)
                    if length < size and (gap := windows.gap(length)) >= min_cut:
                        length = min(length, gap)
                    rows += windows.place([(doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total)], length)
                    at += length
            yield _batch(rows, False)
            rows = []
        while windows.fill:
            rows += windows.close()
        yield _batch(rows, True)

    pieces = stage(docs.select("doc_id", "text").mapInArrow(run, _DDL))
    tasks = (pieces.agg(F.max("sequence_id")).first()[0] or 0) // _PER_TASK + 1
    offset = 0
    done = [pieces.filter("NOT open")]
    left = pieces.filter("open")
    while tasks > 1:
        offset += tasks
        tasks = -(-tasks // group)
        pieces = stage(merge_open(left, size, open_windows, offset, group, tasks))
        done.append(pieces.filter("NOT open"))
        left = pieces.filter("open")
    out = left
    for part in done:
        out = out.unionByName(part)
    return out.drop("open")


def merge_open(left: DataFrame, size: int, open_windows: int, first_task: int, group: int, tasks: int) -> DataFrame:
    """One round of best fit over windows that earlier tasks left open; windows are moved whole, the fullest first."""
    base = F.floor(F.col("sequence_id") / _PER_TASK)
    windows = left.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens"))).alias("pieces"))
    dealt = windows.repartition(tasks, F.pmod(base, F.lit(tasks))).sortWithinPartitions(F.desc("tokens"), "sequence_id") if tasks > 1 else windows.coalesce(1).sortWithinPartitions(F.desc("tokens"), "sequence_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Windows(size, open_windows, (first_task + TaskContext.get().partitionId()) * _PER_TASK)
        for batch in batches:
            rows: list[tuple] = []
            for tokens, pieces in zip(batch["tokens"].to_pylist(), batch["pieces"].to_pylist()):
                rows += own.place([(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces], tokens)
            yield _batch(rows, False)
        rows = []
        while own.fill:
            rows += own.close()
        yield _batch(rows, True)

    return dealt.mapInArrow(run, _DDL)


def unpack(pieces: DataFrame) -> DataFrame:
    """(doc_id, doc_tokens, n_pieces, covered): one row for each document, to check that a packing is whole."""
    return pieces.groupBy("doc_id").agg(F.max("doc_tokens").alias("doc_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("covered"))
