"""Signals of relatedness, their cuts and their sum."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from quarry.operators import relatedness as rel


def seeds(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "seed string")


def got(rows):
    return {(r["seed"], r["key"]): (r["score"], list(r["reasons"])) for r in rows.collect()}


def test_names_that_count(spark):
    rows = [("a", n, "Function") for n in ("Walk", "run", "items", "two words", "call()", "a.bcd", "Spread", "Third", "Fourth")]
    rows += [("b", n, "Class") for n in ("walk", "WALK", "run", "items", "two words", "call()", "a.bcd")] + [("c", "Walk", "Variable"), ("d", "spread", "Method"), ("d", "third", "Method"), ("d", "walk", "Method"), ("d", "fourth", "Constant")]
    found = got(rel.by_symbols(seeds(spark, "a", "nobody"), spark.createDataFrame(rows, "key string, name string, kind string")))
    assert found == {("a", "b"): (1.0, ["1 shared symbols", "shared: WALK"]), ("a", "d"): (4.0, ["4 shared symbols", "shared: fourth, spread, third"])}


def test_each_signal_is_cut_to_its_best(spark):
    rows = [("s", f"name{i}", "Function") for i in range(40)] + [(f"k{j:02}", f"name{i}", "Function") for j in range(40) for i in range(j + 1)]
    found = got(rel.by_symbols(seeds(spark, "s"), spark.createDataFrame(rows, "key string, name string, kind string"), limit=2))
    assert {k for _, k in found} == {f"k{j:02}" for j in range(34, 40)}
    units = spark.createDataFrame([(f"u{i:02}", "z", i) for i in range(30)] + [("s", "z", 99), ("o", None, 1)], "key string, zone string, rank int")
    zone = got(rel.by_zone(seeds(spark, "s", "o"), units, limit=2))
    assert {k for _, k in zone} == {"u29", "u28", "u27"} and set(map(str, zone.values())) == {"(0.5, ['same zone: z'])"}


def test_sections_commits_issues_and_flows(spark):
    s = seeds(spark, "a")
    mentions = spark.createDataFrame([(1, "R", "x", "a"), (1, "R", "x", "b"), (1, "R", "x", "b"), (2, "D", "y", "a"), (2, "D", "y", "b"), (3, "D", "z", "b"), (3, "D", "z", "c")], "section int, doc string, label string, key string")
    assert got(rel.by_sections(s, mentions)) == {("a", "b"): (4.0, ["documented together in D > y"])}
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "a", 4), ("b", "c", 9)], "a string, b string, n int")
    assert got(rel.by_commits(s, pairs)) == {("a", "b"): (1.5, ["co-changed in 1 commit"]), ("a", "c"): (6.0, ["co-changed in 4 commits"])}
    tracked = spark.createDataFrame([("i1", "open", "a", 1.0), ("i1", "open", "b", 1.0), ("i2", None, "a", 1.0), ("i2", None, "b", 2.0), ("i2", None, "c", 2.0)], "issue string, status string, key string, weight double")
    assert got(rel.by_issues(s, tracked)) == {("a", "b"): (3.0, ["tracked together by i2 and 1 more"]), ("a", "c"): (2.0, ["tracked together by i2"])}
    nodes = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a"), ("g", "b"), ("h", "b")], "label string, key string")
    assert got(rel.by_flows(s, nodes)) == {("a", "b"): (6.0, ["shared flow: f, g"])}


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rel, "BLOCK", 7)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((5, 6))
    vectors = {f"v{i:02}": (base[i % 5] + 0.6 * rng.standard_normal(6)).tolist() for i in range(60)}
    vectors |= {"copy": vectors["v00"], "zero": [0.0] * 6, "short": [1.0], "nan": [float("nan")] * 6, "hole": [None] * 6, "none": None, "empty": []}
    df = spark.createDataFrame(list(vectors.items()), "key string, vector array<double>")
    asked = [k for k in vectors if k[-1] in "0ey"]
    found = {}
    for r in rel.nearest(seeds(spark, *asked), df, 4, 0.5).collect():
        found.setdefault(r["seed"], {})[r["key"]] = r["cosine"]
    good = {k: np.array(v) for k, v in vectors.items() if v and None not in v and np.isfinite(v).all() and len(v) == 6 and any(v)}
    for k in asked:
        if k not in good:
            assert k not in found
            continue
        near = sorted(((-(good[k] @ v / np.linalg.norm(good[k]) / np.linalg.norm(v)), o) for o, v in good.items() if o != k))
        want = [(o, -c) for c, o in near if -c >= 0.5][:4]
        assert set(found.get(k, {})) == {o for o, _ in want} and np.allclose([found[k][o] for o, _ in want], [c for _, c in want])
    assert rel.nearest(seeds(spark), df).count() == 0 and rel.nearest(seeds(spark, "v00"), df.limit(0)).count() == 0


def test_fusion(spark):
    schema = "seed string, key string, signal int, score double, reasons array<string>"
    rows = [
        ("s", "zone only", 1, 0.5, ["same zone: z"]), ("s", "both", 1, 0.5, ["same zone: z"]), ("s", "both", 0, 2.0, ["2 shared symbols", "shared: a, b"]), ("s", "fresh", 3, 1.5, ["co-changed in 1 commit"]),
        ("s", "old", 3, 1.5, ["co-changed in 1 commit"]), ("s", "never", 3, 1.5, ["co-changed in 1 commit"]), ("s", "gone", 5, 99.0, ["shared flow: f"]), ("t", "old", 6, 1.0, ["semantic similarity 0.50"]),
    ]
    units = spark.createDataFrame([("zone only", "z", 1), ("both", "p0", 999), ("fresh", "p1", 0), ("old", "p3", 30), ("never", "p2", None), ("t", "t", 5)], "key string, path string, recency int")
    signals = [spark.createDataFrame(rows[:4], schema), spark.createDataFrame(rows[4:], schema)]
    out = [(r["seed"], r["rank"], r["key"], r["score"], list(r["signals"]), list(r["reasons"])) for r in rel.fused(signals, units, 3).orderBy("seed", "rank").collect()]
    assert out == [
        ("s", 1, "both", 2.5, ["symbols", "topology"], ["2 shared symbols", "shared: a, b", "same zone: z"]), ("s", 2, "fresh", 1.85, ["git"], ["co-changed in 1 commit", "recently touched (today)"]),
        ("s", 3, "old", 1.5, ["git"], ["co-changed in 1 commit"]), ("t", 1, "old", 1.0, ["meaning"], ["semantic similarity 0.50"]),
    ]
    assert [r["key"] for r in rel.fused(signals, units, 9).where("seed = 's'").orderBy("rank").collect()] == ["both", "fresh", "old", "never"]


def test_units_of_the_same_names_are_one_class(spark):
    """Many units of few names: classes of them are joined, and the first of each seed are those of all pairs."""
    names = {k: (f"kind{k % 3}", f"Zone{k % 2}") for k in range(240)}
    symbols = spark.createDataFrame([(k, n, "Function") for k, both in names.items() for n in both], "key long, name string, kind string")
    seeds = spark.createDataFrame([(k,) for k in range(0, 240, 20)], "seed long")
    rows = symbols.select("key", F.lower("name").alias("low"), "name")
    units, classes = rel._classes(rows, "key", "class", F.struct("low", "name"))
    assert units.count() == 240 and classes.count() == 12
    want = set()
    for seed in range(0, 240, 20):
        shared = {k: set(names[seed]) & set(v) for k, v in names.items() if k != seed}
        for n, k in sorted((-len(v), k) for k, v in shared.items() if v)[:15]:
            want.add((seed, k, -n * 1.0, f"shared: {', '.join(sorted(shared[k]))}"))
    got = rel.by_symbols(seeds, symbols, limit=5).collect()
    assert {(x["seed"], x["key"], x["score"], x["reasons"][1]) for x in got} == want and len(got) == len(want) == 180
