import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrace.llm import packing

SCHEMA = "doc_id long, text string, sequence_id string"
TEXTS = ["one two three", None, "", "it's <|endoftext|> 'text' \n\n  über " * 40, "word " * 6000, "a" * 500, "one two three"]


def check_whole(rows, docs, size):
    """Every id of every document lies in one piece; sequences are gapless from 0 and not too long."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return {s: sum(r.length for r in parts) for s, parts in sequences.items()}


@pytest.mark.parametrize("size,windows,partitions", [(64, 2, 1), (64, 4, 3), (2048, 64, 5)])
def test_pack_is_whole(spark, size, windows, partitions):
    docs = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], SCHEMA).repartition(partitions)
    check_whole(packing.pack(df, size=size, open_windows=windows, group=2).collect(), docs, size)


def test_pack_wastes_little(spark):
    docs = {i: "some words here " * (1 + i * 37 % 90) for i in range(800)}
    df = spark.createDataFrame([(k, v, None) for k, v in docs.items()], SCHEMA).repartition(4)
    fills = check_whole(packing.pack(df, size=256, open_windows=8).collect(), docs, 256)
    assert sum(fills.values()) >= 0.97 * 256 * len(fills)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_takes_the_fullest_window_with_room():
    w = packing.Windows(10, 2, 0)
    assert w.place([("a", 0, 6)], 6) == []
    assert w.place([("b", 0, 3)], 3) == []
    assert [p[0] for p in w.held[0]] == ["a", "b"]
    assert w.place([("c", 0, 5)], 5) == []
    closed = w.place([("d", 0, 7)], 7)
    assert [p[0] for p in closed] == ["a", "b"]


def test_null_and_repeated_ids(spark):
    docs = [(None, "one two three"), (None, "a b"), (5, "same words here"), (5, "same words here"), (5, "other"), (6, None), (6, None)]
    df = spark.createDataFrame([(k, v, 7, "x") for k, v in docs], "doc_id long, text string, length int, start string").repartition(3)
    rows = packing.pack(df, size=64, open_windows=4, group=2).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=repr) == sorted(want, key=repr)  # few enough that none is cut
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
