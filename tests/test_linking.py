"""Similar values, filled sheets and nested JSON against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import discovery, extract, metrics, windows
from terrace.plans import lineage


def grams(v, q):
    v = "\x02" * (q - 1) + v + "\x03" * (q - 1)
    return {v[i : i + q] for i in range(len(v) - q + 1)}


def jaccard(a, b, q):
    return len(grams(a, q) & grams(b, q)) / len(grams(a, q) | grams(b, q))


@pytest.mark.parametrize("least, q", [(0.8, 3), (0.5, 2), (0.3, 4), (1.0, 1)])
def test_similar_values(spark, least, q):
    rng = random.Random(q)
    base = ["".join(rng.choices("abé ", k=rng.randrange(1, 14))) for _ in range(60)]
    left = base + [b[:-1] + rng.choice("abx") for b in base] + ["", None, "a", "ab" * 40]
    right = base + [b + rng.choice("ab") for b in base] + ["", None, "b", "ab" * 41, "ba"]
    rng.shuffle(right)
    x, y = (spark.createDataFrame([(v,) for v in side], "v string").repartition(3) for side in (left, right))
    found = discovery.similar_values(x, y, least, q)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    want = {(a, b): s for a in set(left) for b in set(right) if a and b and a != b and (s := jaccard(a, b, q)) >= least}
    assert got == pytest.approx(want) and found.count() == len(want)


@pytest.mark.parametrize("least, pairs, depth", [(0.8, 0, 12), (0.6, 0, 2), (0.7, 4, 12)])
def test_similar_values_in_narrowed_blocks(spark, monkeypatch, least, pairs, depth):
    """Names that differ in digits share most grams: blocks are narrowed, and each pair is still met once."""
    monkeypatch.setattr(discovery, "PAIRS_A_ROW", pairs)
    monkeypatch.setattr(discovery, "DEPTH", depth)
    rng = random.Random(depth)
    left = [f"name#{i:06}" for i in rng.sample(range(3000), 150)]
    right = [v[:5] + v[6:] + "x" * (i % 2) for i, v in enumerate(left)]
    x, y = (spark.createDataFrame([(v,) for v in side], "v string") for side in (left, right))
    found = discovery.similar_values(x, y, least).collect()
    want = {(a, b): s for a in left for b in set(right) if a != b and (s := jaccard(a, b, 3)) >= least}
    assert {(r.a, r.b): r.similarity for r in found} == pytest.approx(want) and len(found) == len(want) > 50


def test_similar_row_links_pass_no_side_through_the_driver(spark):
    """The tables' size on disk says little of their grams: neither these nor rows are broadcast because a file is small."""
    df = spark.range(40).select("id", F.format_string("name %06d", "id").alias("v"))
    out = discovery.similar_row_links(df, df.withColumn("v", F.concat("v", F.lit("x"))), "id", "id", [("v", "v", 0.9)])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_similar_row_links(spark):
    left = spark.createDataFrame([(1, " Grenoble Lycee "), (2, "Lyon"), (3, None), (4, "grenoble lycee"), (5, "Grenoble Licee")], "i int, a string").withColumn("b", F.lit("z"))
    right = spark.createDataFrame([(10, "grenoble lycée"), (11, "lyon"), (12, "GRENOBLE LYCEE"), (13, None)], "j int, c string").withColumn("d", F.when(F.col("j") == 11, "z"))
    got = {(r.src, r.dst): (round(r.score, 6), r.kind) for r in discovery.similar_row_links(left, right, "i", "j", [("a", "c", 0.9), ("b", "d", 0.85)], 0.6).collect()}
    near, mixed = 0.9 * jaccard("grenoble lycee", "grenoble lycée", 3), 0.9 * jaccard("grenoble lycee", "grenoble licee", 3)
    want = {(1, 12): (0.9, "equal"), (4, 12): (0.9, "equal"), (2, 11): (0.9, "equal")} | {(i, 11): (0.85, "equal") for i in (1, 3, 4, 5)}
    want |= {(1, 10): (round(near, 6), "similar"), (4, 10): (round(near, 6), "similar"), (5, 12): (round(mixed, 6), "similar")}
    assert got == want


@pytest.mark.parametrize("limit", [100_000, 20])
def test_filling_down(spark, monkeypatch, limit):
    """With a small limit ranges are filled apart; whole ranges may hold nothing."""
    monkeypatch.setattr(windows, "PLAIN_ROWS", limit)
    rng = random.Random(1)
    rows = [(k, None if 100 < k < 700 or rng.random() < 0.7 else f"e{k}", None if rng.random() < 0.5 else k) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, e string, n int").repartition(5)
    last, want = {"e": None, "n": None}, []
    for k, e, n in rows:
        last = {"e": e if e is not None else last["e"], "n": n if n is not None else last["n"]}
        want.append((k, last["e"], last["n"]))
    out = windows.fill_down(df, F.col("k"), x=F.col("e"), y=F.col("n"))
    assert sorted((r.k, r.x, r.y) for r in out.collect()) == want
    tidied = extract.tidy(df.withColumn("v", F.col("n").cast("string")), "e", ["v"], "k").collect()
    assert sorted((r.entity, r.value) for r in tidied) == sorted((e, str(n)) for (_, e, _), (_, _, n) in zip(want, rows) if e is not None and n is not None)
    assert windows.fill_down(df.limit(0), F.col("k"), x=F.col("e")).count() == 0


def nested(log, root):
    children = {}
    for i, p, a in log:
        children.setdefault(p, []).append((i, a or ""))
    build = lambda i, a: {"id": i, "action": a, "children": [build(*c) for c in sorted(children.get(i, []))]}
    return build(root, next(a or "" for i, _, a in log if i == root))


def test_nested_json_can_be_read(spark):
    log = [("r", None, 'say "hi"'), ('a"', "r", "back\\slash"), ("b>c", "r", "]}"), ("b", "r", None), ("x", 'a"', "\n\t"), ("é", "b>c", "{[,"), ("s", None, "")]
    out = lineage.nested_json(spark.createDataFrame(log, "id string, parent_id string, action string").withColumn("level", F.lit(1)))
    got = {r.id: json.loads(r.tree) for r in out.collect()}
    assert got == {root: nested(log, root) for root in ("r", "s")}


def test_nested_json_of_a_deep_log(spark):
    log = [(str(i), str(i - 1) if i else None, f"step {i}") for i in range(1000)]
    tree = lineage.nested_json(spark.createDataFrame(log, "id string, parent_id string, action string")).first().tree
    assert tree.count('{"id"') == 1000 and tree.endswith("]}" * 1000) and '"id":"999","action":"step 999","children":[]}' in tree


def test_hierarchy_of_names_with_marks(spark):
    names = ["k", "q]:r", '"', "\\", "", "é]"]
    rows = [("top", a, b) for a in names for b in names for _ in range(2)]
    tree = metrics.hierarchy_json(spark.createDataFrame(rows, "x string, y string, z string"), ["x", "y", "z"]).first().tree
    assert json.loads(tree) == {a: {b: 2 for b in names} for a in names}
