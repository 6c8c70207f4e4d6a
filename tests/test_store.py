"""The store: versions, replacement, failed writes, pruning, findings with their evidence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.plans.store import SCHEMAS, FindingsStore, GraphStore

FOUND = "rule_id string, title string, anchor string, node_key string, severity string"
PROOF = "fingerprint string, kind string, source string, locator string, snippet string"


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/store")


def run(store, n, completed="t", repo="r"):
    store.write("runs", store.spark.createDataFrame([(repo, completed)], "repo_root string, completed_at string"), n)


def test_tables_have_types_and_defaults(spark, store):
    assert store.read("nodes").count() == 0 and store.read("nodes").columns[-1] == "run_id"
    store.write("edges", spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int"), 1)
    r = store.read("edges", 1).first()
    assert (r["weight"], r["confidence"], r["kind"], r["run_id"]) == (2.0, 1.0, None, 1)
    with pytest.raises(ValueError, match="colour"):
        store.write("edges", spark.createDataFrame([("a", "red")], "src string, colour string"), 1)
    with pytest.raises(ValueError, match="category"):
        store.write("findings", spark.createDataFrame([("a",)], "id string"), 1)
    assert store.read("edges").count() == 1


def test_files_of_other_versions_are_read(spark, store):
    old = spark.createDataFrame([("unit", "unit:a", "a", 1)], "kind string, key string, path string, run_id int")
    old.write.partitionBy("run_id").parquet(store.path("nodes"))
    newer = spark.createDataFrame([("unit", "unit:b", "b", 0.5, "of the future", 2)], "kind string, key string, path string, score double, later string, run_id int")
    newer.write.mode("append").partitionBy("run_id").parquet(store.path("nodes"))
    store.write("nodes", spark.createDataFrame([("unit", "unit:c", "c", 0.7)], "kind string, key string, path string, confidence double"), 3)
    got = {r["key"]: (r["score"], r["confidence"], r["run_id"]) for r in store.read("nodes").collect()}
    assert got == {"unit:a": (0.0, 0.0, 1), "unit:b": (0.5, 0.0, 2), "unit:c": (0.0, 0.7, 3)}
    assert store.views(3, "now_") == [f"now_{t}" for t in SCHEMAS]
    assert [r["key"] for r in spark.sql("select key from now_nodes left join now_symbols using (path)").collect()] == ["unit:c"]


def test_the_first_row_of_a_key_stays(spark, store):
    rows = spark.createDataFrame([("unit", "k", "z"), ("unit", "k", "a"), ("zone", "k", "b")], "kind string, key string, label string").coalesce(1)
    store.write("nodes", rows, 1, key=["kind", "key"])
    assert sorted((r["kind"], r["label"]) for r in store.read("nodes").collect()) == [("unit", "z"), ("zone", "b")]


def test_a_second_pass_leaves_nothing_stale(spark, store):
    found = FindingsStore(store, 4)
    rows = lambda *xs: spark.createDataFrame([(r, t, a, f"unit:{t}", "warning") for r, t, a in xs], FOUND)
    first = rows(("cycle", "x", "1"), ("cycle", "x", "1"), ("deep", "y", "2"))
    prints = {r["title"]: r["fingerprint"] for r in found.identified(first).collect()}
    proof = spark.createDataFrame([(prints["x"], "graph", "edges", "a", None), (prints["x"], "graph", "edges", "b", None), (prints["y"], "text", "lines", None, "s"), ("none", "text", "lines", None, None)], PROOF)
    found.recompute("cycles", first, proof)
    found.recompute("hotspots", rows(("hot", "h", "3")))
    FindingsStore(store, 5).recompute("cycles", rows(("cycle", "other run", "1")))
    ids = [r["id"] for r in found.list().collect()]
    assert ids == [f"fnd_r4_{prints['x']}", f"fnd_r4_{prints['x']}-2", f"fnd_r4_{prints['y']}", *ids[3:]] and len(ids) == 4
    assert [r["locator"] for r in found.evidence(ids[1]).collect()] == ["a", "b"] and store.read("evidence", 4).count() == 5

    found.recompute("cycles", rows(("deep", "y", "2")), proof)
    assert [(r["category"], r["title"]) for r in found.list().collect()] == [("cycles", "y"), ("hotspots", "h")]
    assert store.read("evidence", 4).count() == 1 and found.list("cycles", "deep").count() == 1
    found.recompute("cycles", first.limit(0), proof)
    assert [r["title"] for r in found.list().collect()] == ["h"] and store.read("evidence", 4).count() == 0
    assert FindingsStore(store, 5).list().count() == 1
    found.purge("hotspots")
    assert found.list().count() == 0


def test_purging_by_a_condition(spark, store):
    found = FindingsStore(store, 1)
    first = spark.createDataFrame([("a", "x", "1", None, None), ("b", "y", "1", None, None), (None, "z", "1", None, None)], FOUND)
    proof = found.identified(first).select("fingerprint", F.lit("k").alias("kind"), F.lit("s").alias("source"), "title").withColumnRenamed("title", "locator")
    found.recompute("cycles", first, proof)
    found.purge("cycles", keep=F.col("rule_id") == "a")
    assert [r["title"] for r in found.list().collect()] == ["x"] and [r["locator"] for r in store.read("evidence").collect()] == ["x"]


def test_a_failed_pass_leaves_the_old_rows(spark, store):
    found = FindingsStore(store, 1)
    good = spark.createDataFrame([("a", "x", "1", None, None)], FOUND)
    found.recompute("cycles", good)
    broken = good.withColumn("title", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        found.recompute("cycles", broken)
    bad = good.select("*", F.raise_error(F.lit("late")).cast("string").alias("snippet")).select(F.lit("f").alias("fingerprint"), F.lit("k").alias("kind"), F.lit("s").alias("source"), F.lit("l").alias("locator"), "snippet")
    with pytest.raises(Exception, match="late"):
        found.recompute("cycles", good.withColumn("title", F.lit("new")), bad.join(found.identified(good).select(F.col("fingerprint").alias("g"))).select(F.col("g").alias("fingerprint"), "kind", "source", "locator", "snippet"))
    assert [r["title"] for r in found.list().collect()] == ["x"]


def test_pruning_deletes_what_nothing_needs(spark, store):
    for n in range(1, 9):
        run(store, n, None if n == 8 else "t")
        store.write("nodes", spark.createDataFrame([("unit", f"k{n}")], "kind string, key string"), n)
    run(store, 20, repo="other")
    store.write("symbols", spark.createDataFrame([("a",)], "name string"), 2)
    store.write("symbols", spark.createDataFrame([("a",)], "name string"), 3)
    store.write("embeddings", spark.createDataFrame([("a", [1.0])], "path string, vector array<float>"), 4)
    FindingsStore(store, 1).recompute("cycles", spark.createDataFrame([("a", "x", "1", None, None)], FOUND))
    investigations = spark.createDataFrame([(5,), (None,)], "run_id long")
    assert store.protected("r", 2, investigations) == {3, 4, 5, 6, 7}
    assert store.prune("r", 2, investigations, dry_run=True) == [1, 2, 8] and store.read("nodes").count() == 8
    assert store.prune("r", 2, investigations) == [1, 2, 8]
    assert {r["run_id"] for r in store.read("nodes").collect()} == {3, 4, 5, 6, 7} and {r["run_id"] for r in store.read("symbols").collect()} == {3}
    assert store.read("findings").count() == 0 and store.read("runs").count() == 6 and store.latest_run("other") == 20 and store.latest_run("r") == 7
    assert store.resolve("symbols", "r") == (3, 7) and store.prune("r", 0, investigations) == [6]
