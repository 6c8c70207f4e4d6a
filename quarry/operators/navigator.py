"""Navigation and history queries: summaries, rankings, churn, co-change, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import hotspot_score, package_name, risk_level
from quarry.plans.registry import Registry
from quarry.plans.views import EDGES, STATS, TOUCHES, UNITS, file_stats, import_edges, table, touches, units

REGISTRY = Registry()
query = REGISTRY.query


@query(f"WITH {UNITS} SELECT language, count(*) AS files, sum(loc)::BIGINT AS loc FROM units GROUP BY language ORDER BY loc DESC, language")
def language_summary(spark: SparkSession, d: str) -> DataFrame:
    out = units(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    return out.orderBy(F.desc("loc"), "language")


@query(f"""WITH {UNITS}, l AS (SELECT zone, language, count(*) AS n FROM units GROUP BY ALL),
top AS (SELECT zone, first(language ORDER BY n DESC, language) AS top_language FROM l GROUP BY zone),
r AS (SELECT zone, count(*) AS files, sum(loc)::BIGINT AS loc, max(bytes) AS max_bytes, sum(tokens)::BIGINT AS tokens FROM units GROUP BY ROLLUP (zone))
SELECT coalesce('zone:' || r.zone, 'repo:.') AS key, files, loc, max_bytes, tokens, top_language FROM r LEFT JOIN top USING (zone) WHERE files >= 3""")
def zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    langs = u.groupBy("zone", "language").agg(F.count(F.lit(1)).alias("n"))
    top = langs.groupBy("zone").agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("top_language"))
    sums = u.rollup("zone").agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.max("bytes").alias("max_bytes"), F.sum("tokens").alias("tokens")
    )
    return sums.where("files >= 3").join(top, "zone", "left").select(
        F.coalesce(F.concat(F.lit("zone:"), "zone"), F.lit("repo:.")).alias("key"), "files", "loc", "max_bytes", "tokens", "top_language"
    )


@query(f"""WITH {STATS}, m AS (SELECT greatest(max(churn), 1) AS mc, greatest(max(loc), 1) AS ml FROM stats)
SELECT file, round(0.6::DOUBLE * churn / mc + 0.4::DOUBLE * loc / ml, 6) AS score FROM stats, m ORDER BY 0.6::DOUBLE * churn / mc + 0.4::DOUBLE * loc / ml DESC, file LIMIT 10""")
def hotspot_score_topk(spark: SparkSession, d: str) -> DataFrame:
    s = file_stats(spark, d)
    m = s.agg(F.max("churn").alias("mc"), F.max("loc").alias("ml"))
    scored = s.join(F.broadcast(m)).select("file", hotspot_score(F.col("churn"), F.col("loc"), F.col("mc"), F.col("ml")).alias("score"))
    return scored.orderBy(F.desc("score"), "file").limit(10).withColumn("score", F.round("score", 6))


@query(f"""WITH {STATS} SELECT file, loc, churn, recency FROM stats WHERE starts_with(zone || '/', 'Brand#1/') OR starts_with(zone, 'Brand#1')
ORDER BY churn DESC, recency, file LIMIT 50""")
def children_by_metric(spark: SparkSession, d: str) -> DataFrame:
    s = file_stats(spark, d).where(F.startswith("zone", F.lit("Brand#1")))
    return s.select("file", "loc", "churn", "recency").orderBy(F.desc("churn"), "recency", "file").limit(50)


@query(f"""WITH {STATS}, eav AS (SELECT file, 'loc' AS metric, loc AS v FROM stats UNION ALL SELECT file, 'churn', churn FROM stats UNION ALL SELECT file, 'recency', recency FROM stats)
SELECT file, max(v) FILTER (WHERE metric = 'loc') AS loc, max(v) FILTER (WHERE metric = 'churn') AS churn, max(v) FILTER (WHERE metric = 'recency') AS recency FROM eav GROUP BY file""")
def stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    long = file_stats(spark, d).unpivot("file", ["loc", "churn", "recency"], "metric", "v")
    return long.groupBy("file").pivot("metric", ["loc", "churn", "recency"]).agg(F.max("v"))


@query(f"WITH {STATS} SELECT file, churn, recency FROM stats")
def churn_recency(spark: SparkSession, d: str) -> DataFrame:
    return file_stats(spark, d).select("file", "churn", "recency")


@query(f"""WITH {TOUCHES}, r AS (SELECT file, hash, ts, row_number() OVER (PARTITION BY file ORDER BY ts DESC, hash) AS pos FROM touches)
SELECT file, hash, strftime(ts, '%Y-%m-%d') AS day, pos, round(greatest(0.6::DOUBLE, 1 - 0.1::DOUBLE * (pos - 1)), 6) AS score FROM r WHERE pos <= 3""")
def recent_commits_top3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy(F.desc("ts"), "hash")
    r = touches(spark, d).withColumn("pos", F.row_number().over(w)).where("pos <= 3")
    return r.select(
        "file", "hash", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("pos").cast("long").alias("pos"),
        F.round(F.greatest(F.lit(0.6), 1 - 0.1 * (F.col("pos") - 1)), 6).alias("score"),
    )


LINES = 200_000  # lines that a task gathers to commits


def baskets(spark: SparkSession, d: str, low: int = 2, high: int = 8, of: Column | None = None) -> DataFrame:
    """Commits of ``low`` to ``high`` files, or those with a file ``of`` some kind: (hash, ts, fs), the files in order; a null file counts, but is not listed.

    Commits are dealt to tasks whose number grows with the lines, as tasks of
    a size in bytes would hold more of them the larger the table is. Of a
    larger commit only its first files are gathered, so ``fs`` is bounded.
    """
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file"))
    order = table(spark, d, "orders").where(~F.startswith("o_orderpriority", F.lit("Merge ")))
    order = order.select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // LINES))
    first = F.dense_rank().over(Window.partitionBy("hash").orderBy("file"))
    if of is not None:
        line = line.join(line.where(of).select("hash"), "hash", "left_semi")
    line = line.repartition(tasks, "hash").withColumn("k", first).where(F.col("k") <= high + 1)
    sets = line.join(order.repartition(tasks, "hash"), "hash").groupBy("hash", "ts").agg(
        F.array_sort(F.collect_set("file")).alias("fs"), F.max(F.col("file").isNull().cast("int")).alias("unknown")
    )
    return sets.where((F.size("fs") + F.col("unknown")).between(low, high)).select("hash", "ts", "fs")


def cochange(sets: DataFrame) -> DataFrame:
    """Pairs of files touched together by commits of ``baskets``, with the count and the latest commit. A commit of eight files gives 28 pairs."""
    pairs = sets.select("hash", "ts", F.posexplode("fs").alias("i", "a"), "fs").select(
        "hash", "ts", "a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b")
    )
    latest = F.max_by("hash", F.struct(F.col("ts").isNull(), "ts", "hash"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), latest.alias("sample"))


@query(f"""WITH {TOUCHES}, s AS (SELECT hash FROM touches GROUP BY hash HAVING count(*) BETWEEN 2 AND 8)
SELECT x.file AS a, y.file AS b, count(*) AS n, last(x.hash ORDER BY x.ts, x.hash) AS sample FROM touches x JOIN touches y USING (hash) JOIN s USING (hash)
WHERE x.file < y.file GROUP BY ALL ORDER BY n DESC, a, b LIMIT 500""")
def cochange_top500(spark: SparkSession, d: str) -> DataFrame:
    return cochange(baskets(spark, d)).orderBy(F.desc("n"), "a", "b").limit(500)


@query(f"""WITH {EDGES} SELECT e.src, e.dst, e.confidence, a.p_brand AS src_zone, b.p_brand AS dst_zone FROM edges e
JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst""")
def import_edges_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    side = lambda c: part.select(F.col("p_partkey").alias(c), F.col("p_brand").alias(f"{c}_zone"))
    return import_edges(spark, d).join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "confidence", "src_zone", "dst_zone")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages)
SELECT regexp_extract(ltrim(href, '/'), '^(@[^/]+/[^/]+|[^/]+)', 1) AS target, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def import_scan_regex(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy(package_name(F.ltrim("href", F.lit("/"))).alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages")
    )


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    ends = import_edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"""WITH {STATS}, {EDGES}, m AS (SELECT greatest(max(churn), 1) AS mc, greatest(max(loc), 1) AS ml FROM stats),
deg AS (SELECT node, count(*) AS edges FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node),
s AS (SELECT file, churn, 0.6::DOUBLE * churn / mc + 0.4::DOUBLE * loc / ml AS score, coalesce(edges, 0) AS edges, CASE WHEN file % 50 = 0 THEN 1 ELSE 0 END AS diags
  FROM stats LEFT JOIN deg ON node = file, m),
r AS (SELECT *, CASE WHEN score >= 0.75 THEN 2 WHEN score >= 0.5 THEN 1 ELSE 0 END + (churn >= 5)::INT + (edges >= 5)::INT + (diags > 0)::INT AS n FROM s)
SELECT file, edges, CASE WHEN n >= 2 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS risk FROM r""")
def risk_assessment(spark: SparkSession, d: str) -> DataFrame:
    s = file_stats(spark, d)
    m = s.agg(F.max("churn").alias("mc"), F.max("loc").alias("ml"))
    deg = degree_centrality(spark, d).select(F.col("node").alias("file"), F.col("degree").alias("edges"))
    s = s.join(F.broadcast(m)).join(deg, "file", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    score = hotspot_score(F.col("churn"), F.col("loc"), F.col("mc"), F.col("ml"))
    diags = F.when(F.col("file") % 50 == 0, 1).otherwise(0)
    return s.select("file", "edges", risk_level(score, F.col("churn"), F.col("edges"), diags).alias("risk"))
