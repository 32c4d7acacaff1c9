import random

from .test_decontaminate import brute as windows
from .test_line_dedup import brute as lines
from .test_near_dedup import brute as near
from .test_packing import check_whole

import corpus_pipeline
from terrace.llm import decontaminate, near_dedup
from terrace.llm.tables import stage

SENTENCES = ["The quiet river runs past the old mill and into the wide green valley below.", "Nobody knew who had left the lamp burning through the night.", "A long road led them to the sea, where the boats lay waiting."]


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = line(30)
    docs = [(i, "\n".join(line(rng.randrange(5, 25)) for _ in range(rng.randrange(2, 8))), "en", "s", 0) for i in range(40)]
    docs += [(100 + i, docs[i][1] + "\n" + SENTENCES[0], "en", "s", 0) for i in range(4)]
    docs += [(200, docs[5][1] + " " + passage, "en", "s", 0), (201, line(60) + " " + passage, None, None, None), (202, "too short.", "en", "s", 0), (203, None, "en", "s", 0), (204, "x*** " * 50, "en", "s", 0)]
    return docs, [(1, passage)]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(docs, schema)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name, step in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in df.collect()]
        df = stage(step(spark, df, str(tmp_path)))
        rows = df.collect()
        got[name] = rows
        if name != "packing":
            assert df.schema == spark.createDataFrame([], schema).schema
        if name == "quality":
            assert {r.doc_id for r in rows} == {d[0] for d in docs if d[0] < 202 and len((d[1] or "").split()) >= 20}
        elif name == "lines":
            assert sorted((r.doc_id, r.text) for r in rows) == sorted((d, t) for d, _, _, t in lines(before) if t.strip())
        elif name == "near":
            assert {r.doc_id for r in rows} == {d for d, x in near(before, corpus_pipeline.NEAR_PERCENT).items() if x[2]}
        elif name == "benchmark":
            assert {r.doc_id for r in rows} == {d for d, x in windows(before, items).items() if not x[1]}
        else:
            check_whole(rows, dict(before), 2048)
    assert [r.n_chars == len(r.text) for r in got["lines"]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got["packing"])


def test_clashing_columns_stay(spark):
    names = "n_words n_lines n_dropped kept base_failed n_lost_words drop key hits n band size row h pos spans".split()
    docs, items = corpus()
    df = spark.createDataFrame([(d[0], d[1], *names) for d in docs[:20]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame(items, "item_id long, text string")
    steps = (lambda x: corpus_pipeline.quality_rules(spark, x, ""), lambda x: corpus_pipeline.shared_lines(spark, x, ""), lambda x: corpus_pipeline.near_duplicates(spark, x, ""), lambda x: decontaminate.decontaminate(x, bench))
    for step in steps:
        df = stage(step(df))
        assert df.columns == ["doc_id", "text", *names]
        assert df.count() > 10 and all(list(r)[2:] == names for r in df.collect())


def test_near_stage_at_80_percent(spark):
    rng = random.Random(5)
    docs = []
    for g in range(30):
        base = [f"w{g}x{i}" for i in range(300)]
        docs += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[: rng.randrange(235, 275)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = lambda percent: {d for d, x in near(docs, percent).items() if x[2]}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "", percent=80).collect()}
    assert got == kept(80) != kept(85)
    assert 0.8 - near_dedup.least_estimate(80) > 5 * 0.025 and near_dedup.band_count(80) == 28 and near_dedup.band_count(85) == 21


def test_null_and_repeated_ids(spark, tmp_path):
    """Every row is judged for itself: contaminated and repeated rows go whatever their ids, clean ones stay."""
    docs, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    mixed = [d if i % 3 else (None, *d[1:]) for i, d in enumerate(docs)] + [(3, docs[3][1], "en", "s", 0), (3, docs[30][1], "en", "s", 0), (None, docs[7][1] + " " + items[0][1], "en", "s", 0)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(mixed, schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = df.collect()
        df = stage(step(spark, df, str(tmp_path)))
        rows = df.collect()
        if name == "near":
            texts = {i: r.text for i, r in enumerate(before)}
            wanted = {x[1] for x in near(list(texts.items()), corpus_pipeline.NEAR_PERCENT).values()}
            assert len(rows) == len(wanted) and any(r.doc_id is None for r in rows)
        elif name == "benchmark":
            hit = windows([(i, r.text) for i, r in enumerate(before)], items)
            assert sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None) == sorted((r.doc_id, r.text) for i, r in enumerate(before) if not hit[i][1] and r.doc_id is not None)
            assert len(rows) == sum(not x[1] for x in hit.values())
    assert {r.doc_id for r in corpus_pipeline.packed(spark, df, "").collect()} == {r.doc_id for r in rows}


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
