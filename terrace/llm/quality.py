"""Quality rules, line first: every line is judged by punctuation, navigation and boilerplate rules, failing lines
are removed, and a document that loses too much of its text is rejected. Whole-document counts come beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import SPACED, blocks, buffers, byte_table, gram_hashes, gram_rows, word_hashes, word_spans
from .tables import aside

_U = np.uint64
_LINE = byte_table("0A")


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _STOP, _MARK, _UPPER, _LOWER = _set("#*$%&|<>"), _set(".!?"), _set("!#$%&*|<>?~^=_+"), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_SEPARATOR = _set("|>-/*=_~#")
#: A sentence ends in one of these, and up to three closing marks (or one other ASCII character) after it.
STOPS, CLOSING = ".!?\u2026\u3002\uff01\uff1f", "\"')]}*\u201d\u201c\u2019\u2018\u00bb\u00ab\u203a\u2039\u300d\u300f\uff09"
_TAIL = re.compile(b"(?:%b)(?:[\\x00-\\x7f]|(?:%b){0,3})\\Z" % tuple(b"|".join(re.escape(c.encode()) for c in some) for some in (STOPS, CLOSING)), re.DOTALL)
_CLOSING = _set("\"')]}*")
_PAGES = np.unique([c.encode()[-2] for c in STOPS + CLOSING if len(c.encode()) > 1])
#: Phrases of pages rather than of texts, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "we use cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies", "hier klicken", "zum seitenanfang",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "nous utilisons des cookies", "cliquez ici", "lire la suite",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "utilizamos cookies", "haga clic aquí", "leer más",
    "lorem ipsum", "click here", "sign up", "log in", "subscribe to our", "share on facebook", "follow us on", "back to top", "skip to content", "read more",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules; shares are of a line's words."""

    #: Lines of so many words need a word that ends a sentence.
    sentence_words: int = 8
    #: Words that end in two or more marks (as in ``so!!`` or ``so***``).
    max_marked: float = 0.3
    #: Words that are a separator.
    max_separators: float = 0.1
    #: Capital letters among ASCII letters, in lines of ``sentence_words`` and more.
    max_capitals: float = 0.6
    #: Distinct words, in lines of 30 words and more, at least.
    min_distinct: float = 0.15
    #: Lines with a boilerplate phrase fail up to this many words.
    boilerplate_words: int = 25
    #: A document that loses a larger share of its words is rejected.
    max_lost: float = 0.4


def _sums(flags: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges_b] - total[edges_a]


def _distinct(group: np.ndarray, hashes: np.ndarray, groups: int) -> np.ndarray:
    """Distinct hashes of each group."""
    bits = max(1, int(groups).bit_length())
    keys = np.sort((group.astype(_U) << _U(64 - bits)) | (hashes >> _U(bits)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> _U(64 - bits)).astype(np.int64), minlength=groups)[:groups]


def _repeated(first: np.ndarray, words: np.ndarray, span: int = 8) -> np.ndarray:
    """Words of each row inside a window of ``span`` words that the row has twice or more."""
    rows = len(first) - 1
    place, row = gram_rows(first, span)
    if not len(place):
        return np.zeros(rows, np.int64)
    keys = (row.astype(_U) << _U(52)) | (gram_hashes(words, span)[place] >> _U(12))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(rows, np.int64)
    some = np.zeros(rows, bool)
    some[(twice >> _U(52)).astype(np.int64)] = True
    maybe = some[row]
    place, keys = place[maybe], keys[maybe]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    place = place[twice[at] == keys]
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, place, 1)
    np.add.at(steps, place + span, -1)
    return _sums(np.cumsum(steps[:-1]) > 0, first[:-1], first[1:])


def judge(data: np.ndarray, cut: np.ndarray, rules: Rules) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each row (words, word_chars, symbols, dup lines, repeat words, lost words), and line starts, ends, rows and failures."""
    starts, ends, first = word_spans(data, cut)
    words = word_hashes(data, starts, ends, fold=False)
    rows = len(cut) - 1
    inside, lead = SPACED[data], (data & 0xC0) != 0x80
    counts = [np.diff(first), _sums(inside & lead, cut[:-1], cut[1:]), _sums(_SYMBOL[data], cut[:-1], cut[1:])]
    # lines that have a word
    ls, le, lf = word_spans(data, cut, _LINE)
    row_of = np.repeat(np.arange(rows), np.diff(lf))
    wa, wb = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    some = wb > wa
    ls, le, row_of, wa, wb = ls[some], le[some], row_of[some], wa[some], wb[some]
    n = wb - wa
    counts.append(np.bincount(row_of, minlength=rows) - _distinct(row_of, word_hashes(data, ls, le, fold=False), rows))
    counts.append(_repeated(first, words))
    last, size = data[ends - 1], ends - starts
    before = data[np.maximum(ends - 2, 0)]
    stop = _STOP[last] | ((size > 1) & (last < 128) & _STOP[before])
    # beyond these only words that end in a closing mark, or in a character of the pages where other stops are
    for k in np.flatnonzero(~stop & (size > 1) & (_CLOSING[last] | np.isin(before, _PAGES))).tolist():
        stop[k] = bool(_TAIL.search(data[max(starts[k], ends[k] - 16) : ends[k]].tobytes()))
    marked = (size > 2) & _MARK[last] & (data[np.maximum(ends - 2, 0)] == last)
    separator = (size == 1) & _SEPARATOR[last]
    long = n >= rules.sentence_words
    upper, lower = _sums(_UPPER[data], ls, le), _sums(_LOWER[data], ls, le)
    line_of = np.repeat(np.arange(len(n)), n)
    fails = long & (_sums(stop, wa, wb) == 0)
    fails |= _sums(marked, wa, wb) > rules.max_marked * n
    fails |= _sums(separator, wa, wb) > rules.max_separators * n
    fails |= long & (upper > rules.max_capitals * (upper + lower))
    fails |= (n >= 30) & (_distinct(line_of, words, len(n)) < rules.min_distinct * n)
    text = data.tobytes().lower()
    for phrase in BOILERPLATE:
        at = text.find(phrase.encode())
        while at >= 0:
            k = int(np.searchsorted(ls, at, "right")) - 1
            if k >= 0 and at + len(phrase.encode()) <= le[k] and n[k] <= rules.boilerplate_words:  # inside one line of one row
                fails[k] = True
            at = text.find(phrase.encode(), at + 1)
    counts.append(np.bincount(row_of, weights=np.where(fails, n, 0), minlength=rows).astype(np.int64))
    return counts, ls, le, row_of, fails


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def measure(docs: DataFrame, rules: Rules = Rules(), clean: bool = False) -> DataFrame:
    """docs with the counts of each text, base_failed and kept; with ``clean`` the failing lines are taken out of the text.

    Words are runs of characters other than ASCII white space. base_failed: under 20 words, or over 30 % of the words
    in repeated 8-word windows. kept: not base_failed, and the line rules take no more than ``max_lost`` of the words.
    Null and empty texts have no words and fail; null stays null. Every row gives one row, whatever its id (none for an empty table); other
    columns stay, those of the result's names are replaced. A row's result depends on its own text alone: no phrase, window or line runs
    over the end of a text.
    """
    docs = docs.drop(*_COUNTS, "base_failed", "kept")
    names = docs.columns if clean else ["doc_id", "text"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")
    schema = StructType([f for f in docs.schema.fields if clean or f.name != "text"] + [StructField(name, LongType()) for name in _COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                counts, ls, le, row_of, fails = judge(part, cut, rules)
                columns = list(batch.slice(i, j - i).columns)
                if clean:
                    raw, gone, texts = part.tobytes(), {}, []
                    for r, a, b in zip(row_of[fails].tolist(), ls[fails].tolist(), le[fails].tolist()):
                        gone.setdefault(r, []).append((a, b))
                    for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                        kept = []
                        for x, y in gone.get(r, ()):
                            kept.append(raw[a:x])
                            a = min(y + 1, b)
                        texts.append(b"".join([*kept, raw[a:b]]))
                    old = columns[at]
                    columns[at] = pa.array([t if v else None for t, v in zip(texts, old.is_valid().to_pylist())], pa.binary()).cast(old.type)
                else:
                    columns = [c for k, c in enumerate(columns) if k != at]
                fields = [n for k, n in enumerate(batch.schema.names) if clean or k != at]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=[*fields, *_COUNTS])

    out = docs.mapInArrow(run, schema).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.lit(rules.max_lost) * F.col("n_words")))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, without their failing lines; the columns stay as they are, whatever their names."""
    own, back = aside(docs, (*_COUNTS, "base_failed", "kept"))
    return measure(own, rules, clean=True).filter("kept").select(*own.columns).withColumnsRenamed(back)
