import random
import re
from collections import Counter

import pytest

from terrace.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = "The library opened its doors again in spring, and many people came. They read, they talked, and they stayed until the evening.\nA second line follows here with a few more words in it. It ends well."


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS kept")
    return quality.measure(df, **options).collect()


def test_counts_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["the", "The", "über", "a|b", "*", "x\u00a0y", "<p>", "word.", "z"]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.choice([0, 5, 19, 20, 60, 400])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, CLEAN), (103, CLEAN + "\n" + CLEAN), (104, "w " * 30000), (105, "\n" * 5000), (None, CLEAN)]
    for r in run(spark, docs):
        text = CLEAN if r.doc_id is None else dict(docs)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), r.doc_id


def test_verdicts(spark):
    junk = {
        "symbols": " ".join(f"word{i}*** other{i}%%%" for i in range(30)) + ".",
        "shouting": " ".join(f"LOUD{chr(65 + i % 26)}!!" for i in range(40)),
        "table": " | ".join(f"Cell{i}" for i in range(40)),
        "one word": "re " * 100 + ".",
        "list": " ".join(f"item{i}" for i in range(50)),
    }
    docs = list(enumerate(junk.values())) + [(50, CLEAN), (51, CLEAN + "\nWe use cookies. Accept cookies\n" + junk["table"][:60])]
    kept = {r.doc_id: r.kept for r in run(spark, docs)}
    assert kept == {i: False for i in range(len(junk))} | {50: True, 51: True}


def test_lines_are_taken_out_and_columns_stay(spark):
    df = spark.createDataFrame([(1, CLEAN + "\nAll rights reserved.", "de"), (2, "short", "en"), (3, None, None)], "doc_id long, text string, lang string")
    rows = quality.keep_good(df).collect()
    assert [tuple(r) for r in rows] == [(1, CLEAN + "\n", "de")]
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df.limit(0)).count() == 0


def test_a_row_alone_and_in_any_batch(spark):
    """Boilerplate that would arise only from the end of one text and the beginning of the next fails nobody."""
    texts = ["We went home. I wrote it in my log", " in the evening it rained.", CLEAN + "\nplease sign", "up and read", " more of it.", "x\nterms of", "service ends. " + CLEAN, CLEAN + " click", "here " + CLEAN, None, ""]
    names = ("n_words", "n_lost_words", "n_repeat_words", "n_dup_lines", "base_failed", "kept")
    alone = [tuple(run(spark, [(i, t)])[0][n] for n in names) for i, t in enumerate(texts)]
    assert alone[0][1] == 0
    for order in (range(len(texts)), reversed(range(len(texts)))):
        df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").coalesce(1)
        assert {r.doc_id: tuple(r[n] for n in names) for r in quality.measure(df).collect()} == dict(enumerate(alone))


@pytest.mark.parametrize(
    "line",
    [
        "„Wir gehen heute nicht mehr in die Stadt“, sagte er und schwieg lange nein.“",
        "Sie fragte, ob wir morgen wieder in die Schule gehen, und er kam nie zurück.“",
        "Il était une fois dans une petite ville un homme qui ne disait rien…",
        "Elle répondit que tout cela ne servait à rien et qu'il fallait partir !»",
        "El hombre dijo que mañana volvería a la casa de su madre con nosotros?»)",
        "They said that all of us had to leave the house before the winter.\")",
        "彼 は 今日 も 学校 へ 行か なかった と 言って いた 。」",
    ],
)
def test_sentence_ends_of_other_scripts_and_quotes(spark, line):
    docs = spark.createDataFrame([(1, "\n".join([line] + [line.replace(" ", f" x{i} ", 1) for i in range(3)]))], "doc_id long, text string")
    assert quality.measure(docs).first().n_lost_words == 0


def test_words_without_a_sentence_end(spark):
    for end in ("é", "…a é", "“", "a”“", "»", "é’s"):
        line = f"eins zwei drei vier fünf sechs sieben acht neun zehn {end}"
        docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
        assert quality.measure(docs).first().n_lost_words == len(line.split()), end


def test_boilerplate_of_four_languages(spark):
    text = "Alle Rechte vorbehalten.\nTous droits réservés.\nTodos los derechos reservados.\nAll rights reserved.\nEin ganz normaler Satz steht hier."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.measure(docs).first().n_lost_words == 3 + 3 + 4 + 3
