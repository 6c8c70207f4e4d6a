"""Graph analyzers: cycles, reachability, layers, forbidden edges, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import glob_to_regex
from quarry.plans.graphs import strong_components, widest_paths
from quarry.plans.registry import Registry
from quarry.plans.views import EDGES, STATS, file_stats, import_edges, table

REGISTRY = Registry()
query = REGISTRY.query

LAYERS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
ROOTS = "p_partkey % 100 = 0 OR p_size = 1"

SCC = """walk AS (SELECT src AS a, dst AS b FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON e.src = w.b),
scc AS (SELECT x.a AS node, min(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query(f"""WITH RECURSIVE {STATS}, {EDGES}, {SCC}
SELECT component, count(*) AS scc_size, sum(churn)::BIGINT AS total_churn, string_agg(node::VARCHAR, ',' ORDER BY node) AS members
FROM scc JOIN stats ON file = node GROUP BY component HAVING count(*) > 1""")
def scc_cycles(spark: SparkSession, d: str) -> DataFrame:
    found = strong_components(import_edges(spark, d))
    s = file_stats(spark, d).select(F.col("file").alias("node"), "churn")
    return found.join(s, "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("scc_size"), F.sum("churn").alias("total_churn"),
        F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"),
    )


@query(f"""WITH RECURSIVE base AS (WITH {EDGES} SELECT * FROM edges WHERE confidence = 1),
edges AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM base JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand),
{SCC} SELECT component, count(*) AS scc_size, string_agg(node, ',' ORDER BY node) AS members FROM scc GROUP BY component HAVING count(*) > 1""")
def zone_cycles(spark: SparkSession, d: str) -> DataFrame:
    e = import_edges(spark, d).where("confidence = 1")
    part = table(spark, d, "part")
    a, b = (part.select(F.col("p_partkey").alias(c), F.col("p_brand").alias(f"{c}_zone")) for c in ("src", "dst"))
    zones = e.join(a, "src").join(b, "dst").where("src_zone <> dst_zone").select(F.col("src_zone").alias("src"), F.col("dst_zone").alias("dst")).distinct()
    return strong_components(zones).groupBy("component").agg(
        F.count(F.lit(1)).alias("scc_size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")
    )


def roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(ROOTS).select(F.col("p_partkey").alias("node"))


REACH = f"""roots AS (SELECT p_partkey AS node FROM part WHERE {ROOTS}),
strong AS (SELECT node FROM roots UNION SELECT e.dst FROM strong s JOIN edges e ON e.src = s.node WHERE e.confidence >= 1),
weak AS (SELECT node FROM roots UNION SELECT e.dst FROM weak s JOIN edges e ON e.src = s.node),
reach AS (SELECT w.node, CASE WHEN s.node IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS reach FROM weak w LEFT JOIN strong s ON s.node = w.node)"""


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT node, reach FROM reach")
def reachability_maxmin(spark: SparkSession, d: str) -> DataFrame:
    return widest_paths(import_edges(spark, d), roots(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, {REACH} SELECT p_partkey AS file, CASE WHEN reach IS NULL THEN 'warning' ELSE 'info' END AS severity,
CASE WHEN reach IS NULL THEN 'high' ELSE 'low' END AS confidence FROM part LEFT JOIN reach ON node = p_partkey
WHERE coalesce(reach, 0) < 1 AND NOT starts_with(p_name, 'blue') AND (SELECT count(*) FROM roots) > 0""")
def unused_units(spark: SparkSession, d: str) -> DataFrame:
    """Files that no root reaches, or only over weak edges. Names that begin with blue stand for exempt paths. Without a root, none."""
    r = roots(spark, d)
    reach = widest_paths(import_edges(spark, d), r).withColumnRenamed("node", "file")
    files = table(spark, d, "part").where(~F.startswith("p_name", F.lit("blue"))).select(F.col("p_partkey").alias("file"))
    some = r.agg((F.count(F.lit(1)) > 0).alias("some"))
    left = files.join(reach, "file", "left").where(F.coalesce("reach", F.lit(0)) < 1).join(F.broadcast(some)).where("some")
    return left.select(
        "file", F.when(F.col("reach").isNull(), "warning").otherwise("info").alias("severity"), F.when(F.col("reach").isNull(), "high").otherwise("low").alias("confidence")
    )


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a, b = (part.select(F.col("p_partkey").alias(c), F.col("p_brand").alias(f"{c}_zone")) for c in ("src", "dst"))
    return import_edges(spark, d).join(a, "src").join(b, "dst")


_LAYER = lambda c: "CASE " + " ".join(f"WHEN starts_with({c}, '{x}') THEN {i}" for i, x in enumerate(LAYERS)) + " END"


@query(f"""WITH {EDGES}, z AS (SELECT src, dst, {_LAYER("a.p_brand")} AS src_layer, {_LAYER("b.p_brand")} AS dst_layer
FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst) SELECT * FROM z WHERE src_layer > dst_layer""")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    layer = lambda c: F.coalesce(*(F.when(F.startswith(c, F.lit(x)), i) for i, x in enumerate(LAYERS)))
    z = _zoned(spark, d).select("src", "dst", layer(F.col("src_zone")).alias("src_layer"), layer(F.col("dst_zone")).alias("dst_layer"))
    return z.where("src_layer > dst_layer")


RULES = (("Brand#1*", "Brand#5"), ("Brand#{2,3}", "Brand#2?"))


@query(f"""WITH {EDGES}, r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{glob_to_regex(a)}', '{glob_to_regex(b)}')" for a, b in RULES)}) v(from_glob, to_glob, fr, tr))
SELECT src, dst, from_glob, to_glob FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst JOIN r ON regexp_matches(a.p_brand, fr) AND regexp_matches(b.p_brand, tr)""")
def forbidden_dependency(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the edges for all rules: each edge gets the list of the rules that it breaks."""
    broken = F.array_compact(F.array(*(
        F.when(F.col("src_zone").rlike(glob_to_regex(a)) & F.col("dst_zone").rlike(glob_to_regex(b)), F.struct(F.lit(a).alias("from_glob"), F.lit(b).alias("to_glob")))
        for a, b in RULES
    )))
    return _zoned(spark, d).select("src", "dst", F.explode(broken).alias("r")).select("src", "dst", "r.*")


TESTED = f"""{EDGES}, f AS (SELECT p_partkey AS file, p_name AS name, p_type = 'PROMO' AS test FROM part),
t AS (SELECT src AS test, dst AS subject, 1.0::DOUBLE AS confidence FROM edges JOIN f a ON a.file = src AND a.test JOIN f b ON b.file = dst AND NOT b.test
  UNION ALL SELECT a.file, a.file + 1, 0.8::DOUBLE FROM f a JOIN f b ON b.file = a.file + 1 AND b.name = a.name WHERE a.test AND NOT b.test),
tested AS (SELECT test, subject, max(confidence) AS confidence FROM t GROUP BY ALL)"""


@query(f"WITH {TESTED} SELECT * FROM tested")
def tested_by(spark: SparkSession, d: str) -> DataFrame:
    """Tests (files of type PROMO) and their subjects: imported by them, or the sibling of their name."""
    f = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), (F.col("p_type") == "PROMO").alias("is_test"))
    tests, others = f.where("is_test").select(F.col("file").alias("test"), "name"), f.where("not is_test").select(F.col("file").alias("subject"), F.col("name").alias("n"))
    e = import_edges(spark, d).select(F.col("src").alias("test"), F.col("dst").alias("subject"))
    imported = e.join(tests, "test", "left_semi").join(others, "subject", "left_semi").select("test", "subject", F.lit(1.0).alias("confidence"))
    sibling = tests.withColumn("subject", F.col("test") + 1).join(others, "subject").where("name = n").select("test", "subject", F.lit(0.8).alias("confidence"))
    return imported.unionByName(sibling).groupBy("test", "subject").agg(F.max("confidence").alias("confidence"))


@query(f"WITH {TESTED} SELECT file FROM f WHERE test AND file NOT IN (SELECT test FROM tested)")
def orphan_test(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("file"))
    return tests.join(tested_by(spark, d).select(F.col("test").alias("file")), "file", "left_anti")
