"""Findings: hotspots, outliers, fingerprints, suppressions, dependencies, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import fingerprint, glob_to_regex
from quarry.operators.graph import SCC, layer_violations
from quarry.operators.navigator import degree_centrality
from quarry.plans.graphs import strong_components
from quarry.plans.registry import Registry
from quarry.plans.shared import shared_dir
from quarry.plans.store import FindingsStore, GraphStore
from quarry.plans.views import EDGES, STATS, file_stats, import_edges, table

REGISTRY = Registry()
query = REGISTRY.query

WEIGHTS = {"churn": 0.3, "complexity": 0.2, "centrality": 0.2, "cycles": 0.15, "duplication": 0.15}
DEGREE = "degree AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)"
DUPES = "dupes AS (SELECT file, n - 1 AS n FROM (SELECT p_partkey AS file, count(*) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS n FROM part) WHERE n > 1)"


@query(f"""WITH RECURSIVE {STATS}, {EDGES}, {SCC}, {DEGREE}, {DUPES},
cyc AS (SELECT node FROM scc WHERE component IN (SELECT component FROM scc GROUP BY component HAVING count(*) > 1)),
u AS (SELECT file, churn, loc, coalesce(degree, 0) AS degree, coalesce(n, 0) AS dup, cyc.node IS NOT NULL AS in_cycle FROM stats LEFT JOIN degree ON degree.node = file LEFT JOIN dupes USING (file) LEFT JOIN cyc ON cyc.node = file),
m AS (SELECT greatest(max(churn), 1) AS c, greatest(max(loc), 1) AS l, greatest(max(degree), 1) AS g, greatest(max(dup), 1) AS p FROM u),
s AS (SELECT file, churn::DOUBLE / c AS churn, loc::DOUBLE / l AS complexity, degree::DOUBLE / g AS centrality, CASE WHEN in_cycle THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cycles, dup::DOUBLE / p AS duplication FROM u, m)
SELECT file, round(churn * 0.3::DOUBLE + complexity * 0.2::DOUBLE + centrality * 0.2::DOUBLE + cycles * 0.15::DOUBLE + duplication * 0.15::DOUBLE, 4) AS composite,
array_to_string(list_filter([CASE WHEN churn >= 0.5 THEN 'churn' END, CASE WHEN complexity >= 0.5 THEN 'complexity' END, CASE WHEN centrality >= 0.5 THEN 'centrality' END, CASE WHEN cycles >= 0.5 THEN 'cycles' END, CASE WHEN duplication >= 0.5 THEN 'duplication' END], lambda x: x IS NOT NULL), ',') AS drivers
FROM s WHERE churn * 0.3::DOUBLE + complexity * 0.2::DOUBLE + centrality * 0.2::DOUBLE + cycles * 0.15::DOUBLE + duplication * 0.15::DOUBLE >= 0.5""")
def hotspot_findings(spark: SparkSession, d: str) -> DataFrame:
    """Files whose weighted mean of normalised signals is 0.5 or more. A part's duplicates are those of its name, brand, type and size."""
    s = file_stats(spark, d)
    same = ["p_name", "p_brand", "p_type", "p_size"]
    part = table(spark, d, "part").select(F.col("p_partkey").alias("file"), *same)
    groups = part.groupBy(*same).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    dupes = part.join(groups, same).select("file", "n")
    deg = degree_centrality(spark, d).select(F.col("node").alias("file"), "degree")
    cyc = strong_components(import_edges(spark, d)).select(F.col("node").alias("file"), F.lit(1.0).alias("cycles"))
    u = s.join(deg, "file", "left").join(cyc, "file", "left").join(dupes, "file", "left").select(
        "file", F.col("churn").cast("double"), F.col("loc").cast("double").alias("complexity"), F.coalesce("degree", F.lit(0)).cast("double").alias("centrality"),
        F.coalesce("cycles", F.lit(0.0)).alias("cycles"), F.coalesce("n", F.lit(0)).cast("double").alias("duplication"),
    )
    top = u.agg(*(F.greatest(F.max(c), F.lit(1.0)).alias(f"m_{c}") for c in WEIGHTS if c != "cycles"))
    n = u.join(F.broadcast(top)).select("file", *((F.col(c) / F.col(f"m_{c}")).alias(c) if c != "cycles" else F.col(c) for c in WEIGHTS))
    composite = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    drivers = F.concat_ws(",", *(F.when(F.col(c) >= 0.5, F.lit(c)) for c in WEIGHTS))
    return n.select("file", composite.alias("x"), drivers.alias("drivers")).where("x >= 0.5").select("file", F.round("x", 4).alias("composite"), "drivers")


@query(f"""WITH {STATS}, {EDGES}, {DEGREE}, a AS (SELECT avg(loc) AS ml FROM stats), b AS (SELECT avg(coalesce(degree, 0)) AS md FROM stats LEFT JOIN degree ON node = file)
SELECT 'complexity-outlier' AS rule_id, file, loc AS value FROM stats, a WHERE loc >= 40 AND loc >= 1.5::DOUBLE * ml
UNION ALL SELECT 'high-centrality-risk', file, degree FROM stats JOIN degree ON node = file, b WHERE degree >= 5 AND degree >= 2 * md""")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    """``outlying`` with the bounds on lines scaled to parts, of which none has 200 lines."""
    return outlying(spark, d, min_loc=40, loc_factor=1.5)


def outlying(spark: SparkSession, d: str, min_loc: int = 200, loc_factor: float = 2.0, min_degree: int = 5, degree_factor: float = 2.0) -> DataFrame:
    """Files of many lines, and files with many edges, both in number and against the mean."""
    s = file_stats(spark, d)
    deg = degree_centrality(spark, d).select(F.col("node").alias("file"), "degree")
    u = s.join(deg, "file", "left").select("file", "loc", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    m = u.join(F.broadcast(u.agg(F.avg("loc").alias("ml"), F.avg("degree").alias("md"))))
    complex_ = m.where((F.col("loc") >= min_loc) & (F.col("loc") >= loc_factor * F.col("ml"))).select(F.lit("complexity-outlier").alias("rule_id"), "file", F.col("loc").alias("value"))
    central = m.where((F.col("degree") >= min_degree) & (F.col("degree") >= degree_factor * F.col("md"))).select(F.lit("high-centrality-risk").alias("rule_id"), "file", F.col("degree").alias("value"))
    return complex_.unionByName(central)


FOUND = """raw AS (SELECT 'layering-violation' AS rule_id, 'Brand/' || src || '.ts' AS path, (dst % 5)::VARCHAR AS anchor, src, dst FROM viol),
found AS (SELECT *, substr(sha256(rule_id || chr(0) || path || chr(0) || anchor), 1, 16) AS fp FROM raw)"""


def _layer_sql() -> str:
    from quarry.operators.graph import _LAYER

    return f"""{EDGES}, viol AS (SELECT * FROM (SELECT src, dst, {_LAYER("a.p_brand")} AS sl, {_LAYER("b.p_brand")} AS dl FROM edges
JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst) WHERE sl > dl)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Layering violations as findings with fingerprints; the run's nth of one fingerprint has the ending -n."""
    raw = layer_violations(spark, d).select(
        F.lit("layering-violation").alias("rule_id"), F.concat(F.lit("Brand/"), F.col("src").cast("string"), F.lit(".ts")).alias("path"),
        (F.col("dst") % 5).cast("string").alias("anchor"), "src", "dst",
    )
    fp = raw.withColumn("fp", fingerprint(F.col("rule_id"), F.col("path"), F.col("anchor")))
    n = F.row_number().over(Window.partitionBy("fp").orderBy("src", "dst"))
    return fp.withColumn("n", n).withColumn("id", F.concat(F.lit("fnd_r1_"), "fp", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")))


@query(f"""WITH {_layer_sql()}, {FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY src, dst) AS k FROM found)
SELECT 'fnd_r1_' || fp || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, rule_id, path, anchor, src, dst FROM n""")
def finding_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", "rule_id", "path", "anchor", "src", "dst")


@query(f"""WITH {_layer_sql()}, {FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY src, dst) AS k FROM found WHERE src % 2 = 0 OR dst % 3 = 0)
SELECT 'architecture' AS category, 'fnd_r7_' || fp || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, rule_id, src || ' > ' || dst AS title, (SELECT count(*) FROM n x WHERE x.fp = n.fp) AS evidence FROM n
UNION ALL SELECT 'duplication', 'fnd_r7_' || substr(sha256('exact-clone' || chr(0) || p_name || chr(0) || 'names'), 1, 16), 'exact-clone', p_name, 0 FROM part GROUP BY p_name HAVING count(*) > 1""")
def stored_findings(spark: SparkSession, d: str) -> DataFrame:
    """A run's findings after its analyzers ran twice: what the second pass of a category doesn't find is gone, with its evidence."""
    store = FindingsStore(GraphStore(spark, f"{shared_dir(spark)}/quarry-store-{uuid.uuid4().hex}"), 7)
    pair = lambda a, b: F.concat(F.lpad(F.col(a).cast("string"), 20, "0"), F.lit(" "), F.lpad(F.col(b).cast("string"), 20, "0"))
    cols = lambda title, summary, path: (F.lit("warning").alias("severity"), F.lit("medium").alias("confidence"), title.alias("title"), summary.alias("summary"), F.array(F.struct(path.alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))).alias("locations"))
    every = findings(spark, d)
    found = every.select("rule_id", "anchor", *cols(pair("src", "dst"), F.lit(""), F.col("path")), "src", "dst", "fp")
    proof = found.select(F.col("fp").alias("fingerprint"), F.lit("graph").alias("kind"), F.lit("imports").alias("source"), F.col("title").alias("locator"))
    again = (F.col("src") % 2 == 0) | (F.col("dst") % 3 == 0)
    store.recompute("architecture", found.drop("src", "dst", "fp"), proof)
    clones = table(spark, d, "part").groupBy("p_name").count().where("count > 1")
    store.recompute("duplication", clones.select(F.lit("exact-clone").alias("rule_id"), F.lit("names").alias("anchor"), *cols(F.col("p_name"), F.lit(""), F.col("p_name"))))
    store.recompute("architecture", found.where(again).drop("src", "dst", "fp"), proof.join(found.where(again).select(F.col("title").alias("locator")), "locator", "left_semi"))
    n = store.store.read("evidence", 7).groupBy(F.col("finding_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    whole = lambda i: F.split("title", " ")[i].cast("long").cast("string")
    title = F.when(F.col("category") == "architecture", F.concat(whole(0), F.lit(" > "), whole(1))).otherwise(F.col("title"))
    return store.list().join(n, "id", "left").select("category", "id", "rule_id", title.alias("title"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


# rule, path glob, expires (null: never), owner
SUPPRESSIONS = (("layering-violation", "Brand/1*.ts", None, "a"), ("layering-violation", "Brand/2*.ts", "2001-01-01", "b"), ("hotspot", "**", None, "c"))
TODAY = "2024-06-01"
_SUPP_SQL = "supp AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{g}', '{glob_to_regex(g)}', {f"'{e}'" if e else 'NULL'}, '{o}')" for r, g, e, o in SUPPRESSIONS
) + ") v(rule, pattern, re, expires, owner))"


def _suppressed(entry: tuple):
    rule, glob, expires, _ = entry
    return (F.col("rule_id") == rule) & F.col("path").rlike(glob_to_regex(glob)) & F.lit(expires is None or expires >= TODAY)


@query(f"""WITH {_layer_sql()}, {FOUND}, {_SUPP_SQL} SELECT rule_id, path, anchor, src, dst FROM found f WHERE NOT EXISTS (
SELECT 1 FROM supp s WHERE s.rule = f.rule_id AND regexp_matches(f.path, s.re) AND (s.expires IS NULL OR s.expires >= '{TODAY}'))""")
def suppressions(spark: SparkSession, d: str) -> DataFrame:
    """Findings that no entry in force covers: a filter of all entries, evaluated in one pass."""
    covered = F.lit(False)
    for s in SUPPRESSIONS:
        covered = covered | _suppressed(s)
    return findings(spark, d).where(~covered).select("rule_id", "path", "anchor", "src", "dst")


@query(f"""WITH {_layer_sql()}, {FOUND}, {_SUPP_SQL} SELECT rule, pattern, owner, CASE WHEN expires < '{TODAY}' THEN 'expired' ELSE 'unmatched' END AS reason FROM supp s
WHERE expires < '{TODAY}' OR NOT EXISTS (SELECT 1 FROM found f WHERE s.rule = f.rule_id AND regexp_matches(f.path, s.re))""")
def stale_suppressions(spark: SparkSession, d: str) -> DataFrame:
    hits = findings(spark, d).agg(*(F.count_if((F.col("rule_id") == r) & F.col("path").rlike(glob_to_regex(g))).alias(f"n{i}") for i, (r, g, _, _) in enumerate(SUPPRESSIONS)))
    rows = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(g).alias("pattern"), F.lit(o).alias("owner"), F.lit(e).cast("string").alias("expires"), F.col(f"n{i}").alias("n"))
        for i, (r, g, e, o) in enumerate(SUPPRESSIONS)
    ))
    r = hits.select(F.explode(rows).alias("r")).select("r.*")
    gone = F.coalesce(F.col("expires") < TODAY, F.lit(False))
    return r.where(gone | (F.col("n") == 0)).select("rule", "pattern", "owner", F.when(gone, "expired").otherwise("unmatched").alias("reason"))


@query("""WITH declared AS (SELECT DISTINCT 'pkg' || (p_partkey % 97) AS dep, CASE WHEN p_partkey % 97 < 50 THEN 'dependency' ELSE 'dev' END AS kind FROM part),
used AS (SELECT DISTINCT 'pkg' || (l_partkey % 97) AS dep FROM lineitem WHERE l_partkey % 97 NOT IN (3, 60, 61)),
script AS (SELECT 'run pkg60 && test' AS t)
SELECT dep, CASE kind WHEN 'dependency' THEN 'medium' ELSE 'low' END AS confidence FROM declared, script WHERE dep NOT IN (SELECT dep FROM used) AND NOT contains(t, dep) AND NOT starts_with(dep, '@types/')""")
def unused_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Declared packages that nothing imports and no script names."""
    k = F.col("p_partkey") % 97
    declared = table(spark, d, "part").select(F.concat(F.lit("pkg"), k.cast("string")).alias("dep"), F.when(k < 50, "medium").otherwise("low").alias("confidence")).distinct()
    used = table(spark, d, "lineitem").where("l_partkey % 97 not in (3, 60, 61)").select(F.concat(F.lit("pkg"), (F.col("l_partkey") % 97).cast("string")).alias("dep")).distinct()
    named = F.contains(F.lit("run pkg60 && test"), F.col("dep")) | F.startswith("dep", F.lit("@types/"))
    return declared.where(~named).join(used, "dep", "left_anti").select("dep", "confidence")


LEVELS = {"info": "note", "warning": "warning", "error": "error"}
_IDS = "ids AS (SELECT *, 'fnd_r1_' || fp || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY src, dst) AS k FROM found))"


def sarif_result(rule, severity, text, path, line, fp):
    """A SARIF 2.1.0 result as a struct: severities as levels, a region only where there is a line."""
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[severity]
    region = F.when(line.isNotNull(), F.struct(line.alias("startLine")))
    location = F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.struct(fp.alias("quarry/v1")).alias("partialFingerprints"), F.array(location).alias("locations"))


@query(f"""WITH {_layer_sql()}, {FOUND}, {_IDS} SELECT id, '{{"ruleId":"' || rule_id || '","level":"warning","message":{{"text":"Layering violation in ' || path || '"}},"partialFingerprints":{{"quarry/v1":"' || fp
|| '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}}' || CASE WHEN anchor <> '0' THEN ',"region":{{"startLine":' || anchor || '}}' ELSE '' END || '}}}}]}}' AS result FROM ids""")
def sarif_render(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF 2.1.0 result, as JSON, for each finding; a log's fixed parts are added by ``sources.filesystem.sarif_log``.

    The anchor stands for the line; a finding with anchor 0 has none.
    """
    f = findings(spark, d)
    line = F.when(F.col("anchor") != "0", F.col("anchor").cast("int"))
    text = F.concat(F.lit("Layering violation in "), "path")
    return f.select("id", F.to_json(sarif_result(F.col("rule_id"), F.lit("warning"), text, F.col("path"), line, F.col("fp"))).alias("result"))


@query(f"""WITH {_layer_sql()}, {FOUND}, {_IDS} SELECT rule_id, path, count(*) AS n,
string_agg('- `' || id || '` ' || path || ' (' || anchor || ')', chr(10) ORDER BY '- `' || id || '` ' || path || ' (' || anchor || ')') AS body FROM ids GROUP BY rule_id, path""")
def md_report(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown report's sections: one row for each rule and file with its findings as a list."""
    f = findings(spark, d)
    item = F.concat(F.lit("- `"), "id", F.lit("` "), "path", F.lit(" ("), "anchor", F.lit(")"))
    return f.groupBy("rule_id", "path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("body"))
