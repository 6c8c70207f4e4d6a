"""Composed answers: node reports, explanations, document and issue graphs, degradation ladders, the analyzer pipeline."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import slugify
from quarry.operators import clones, findings, graph, lifecycle, related, symbols
from quarry.operators.findings import FOUND, _layer_sql
from quarry.plans.registry import Registry
from quarry.plans.views import EDGES, STATS, file_stats, import_edges, table

REGISTRY = Registry()
query = REGISTRY.query
log = logging.getLogger(__name__)


@query(f"""WITH {_layer_sql()}, {FOUND} SELECT path, 'architecture' AS category, count(*) AS n FROM found GROUP BY path""")
def path_involvement(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each category by the paths of their locations."""
    located = findings.findings(spark, d).select(F.explode(F.array("path")).alias("path"), F.lit("architecture").alias("category"))
    return located.groupBy("path", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_layer_sql()}, {FOUND}, top AS (SELECT src, dst FROM found ORDER BY src, dst LIMIT 1) SELECT f.rule_id, f.path, f.anchor, s.p_name AS source_name, t.p_name AS target_name
FROM found f JOIN top USING (src, dst) JOIN part s ON s.p_partkey = f.src JOIN part t ON t.p_partkey = f.dst""")
def explain_finding(spark: SparkSession, d: str) -> DataFrame:
    """A finding with the edge that is its evidence."""
    f = findings.findings(spark, d)
    one = f.orderBy("src", "dst").limit(1).select("rule_id", "path", "anchor", "src", "dst")
    part = table(spark, d, "part")
    name = lambda c, to: part.select(F.col("p_partkey").alias(c), F.col("p_name").alias(to))
    return one.join(name("src", "source_name"), "src").join(name("dst", "target_name"), "dst").select("rule_id", "path", "anchor", "source_name", "target_name")


@query(f"""WITH {STATS}, {EDGES}, o AS (SELECT src AS file, count(*) AS out_edges, min(dst) AS first_out FROM edges GROUP BY 1), i AS (SELECT dst AS file, count(*) AS in_edges FROM edges GROUP BY 1)
SELECT file, name, zone, loc, churn, recency, CASE WHEN recency > 900 THEN 'unknown' WHEN recency <= 7 THEN 'fresh' WHEN recency <= 90 THEN 'recent' ELSE 'stale' END AS freshness,
coalesce(out_edges, 0) AS out_edges, coalesce(in_edges, 0) AS in_edges, first_out FROM stats LEFT JOIN o USING (file) LEFT JOIN i USING (file) WHERE zone = 'Brand#11'""")
def node_report(spark: SparkSession, d: str, zone: str = "Brand#11") -> DataFrame:
    """What a report of a node shows, for all nodes of a zone."""
    e = import_edges(spark, d)
    out = e.groupBy(F.col("src").alias("file")).agg(F.count(F.lit(1)).alias("out_edges"), F.min("dst").alias("first_out"))
    into = e.groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("in_edges"))
    s = file_stats(spark, d).where(F.col("zone") == zone)
    fresh = F.when(F.col("recency") > 900, "unknown").when(F.col("recency") <= 7, "fresh").when(F.col("recency") <= 90, "recent").otherwise("stale")
    return s.join(out, "file", "left").join(into, "file", "left").select(
        "file", "name", "zone", "loc", "churn", "recency", fresh.alias("freshness"), F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("in_edges", F.lit(0)).alias("in_edges"), "first_out"
    )


@query(f"""WITH docs AS (SELECT doc_id, 'doc:' || source || '/' || doc_id || '.md' AS doc, text FROM documents),
l AS (SELECT doc_id, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
s AS (SELECT doc_id, doc, regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM l WHERE regexp_matches(line, '^[A-Z]')),
sec AS (SELECT DISTINCT doc, 'doc_section:' || doc || '#' || slug AS section FROM s)
SELECT doc AS src, section AS dst, 'contains' AS kind, 0.7::DOUBLE AS confidence FROM sec UNION ALL SELECT 'repo:.', doc, 'documents', 0.8::DOUBLE FROM docs
UNION ALL SELECT DISTINCT 'doc:' || source || '/' || doc_id || '.md', 'unit:' || item_id, 'mentions', 0.7::DOUBLE FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 3""")
def markdown_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of documents as Markdown files: the repository documents them, they contain sections and mention units. Sections of one slug are one."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc:"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc"), "text")
    lines = docs.select("doc", F.explode(F.filter(F.split("text", "\n", -1), lambda x: x.rlike("^[A-Z]"))).alias("line"))
    sections = lines.select("doc", F.concat(F.lit("doc_section:"), "doc", F.lit("#"), slugify(F.col("line"))).alias("section")).distinct()
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name"))
    m = related.mention_pairs(docs.select(F.col("doc").alias("id"), "text"), names)
    contains = sections.select(F.col("doc").alias("src"), F.col("section").alias("dst"), F.lit("contains").alias("kind"), F.lit(0.7).alias("confidence"))
    documents = docs.select(F.lit("repo:.").alias("src"), F.col("doc").alias("dst"), F.lit("documents").alias("kind"), F.lit(0.8).alias("confidence"))
    mentions = m.select(F.col("id").alias("src"), F.concat(F.lit("unit:"), F.col("name_id").cast("string")).alias("dst"), F.lit("mentions").alias("kind"), F.lit(0.7).alias("confidence"))
    return contains.unionByName(documents).unionByName(mentions)


@query("""WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS active, o_custkey FROM orders),
dep AS (SELECT 'issue:' || a.id AS src, 'issue:' || b.id AS dst, 'depends-on' AS kind, 1.0::DOUBLE AS weight FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.id > b.id),
tr AS (SELECT DISTINCT 'issue:' || id AS src, 'unit:' || l_partkey AS dst, 'tracked-by' AS kind, (1 + active)::DOUBLE AS weight FROM i JOIN lineitem ON l_orderkey = id)
SELECT * FROM dep UNION ALL SELECT * FROM tr""")
def issue_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of issues (orders): on issues of the same customer before them, and the files that they name; active ones weigh 2."""
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0).alias("active"), "o_custkey")
    key = lambda c: F.concat(F.lit("issue:"), F.col(c).cast("string"))
    b = i.select(F.col("id").alias("other"), "o_custkey")
    dep = i.join(b, "o_custkey").where("id > other").select(key("id").alias("src"), key("other").alias("dst"), F.lit("depends-on").alias("kind"), F.lit(1.0).alias("weight"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").distinct()
    tracked = i.join(files, "id").select(key("id").alias("src"), F.concat(F.lit("unit:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("tracked-by").alias("kind"), (1 + F.col("active")).alias("weight"))
    return dep.unionByName(tracked)


@query("""WITH i AS (SELECT o_orderkey AS id FROM orders), t AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS file FROM lineitem JOIN i ON l_orderkey = id)
SELECT b.file, count(*) AS issues FROM t a JOIN t b USING (id) WHERE a.file = (SELECT min(file) FROM t) AND b.file <> a.file GROUP BY b.file""")
def related_by_issue(spark: SparkSession, d: str) -> DataFrame:
    """Files that share issues with a seed."""
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("file")).distinct().join(i, "id", "left_semi")
    t = t.join(F.broadcast(t.agg(F.min("file").alias("seed"))))
    own = t.where("file = seed").select("id")
    return t.where("file <> seed").join(own, "id", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("issues"))


@query("""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS zone, page_id, regexp_matches(html, '<article') AS strong FROM pages),
f AS (SELECT zone, list_sort(list(page_id) FILTER (WHERE strong)) AS nodes FROM p GROUP BY zone), s AS (SELECT list(page_id) AS scope FROM p WHERE page_id % 3 = 0)
SELECT zone, array_to_string(CASE WHEN len(list_filter(nodes, lambda x: x % 3 = 0)) > 0 THEN list_filter(nodes, lambda x: x % 3 = 0) ELSE nodes END, ',') AS nodes FROM f WHERE len(nodes) > 0""")
def flow_scope(spark: SparkSession, d: str) -> DataFrame:
    """A flow's nodes within a scope (ids divisible by three); all of them if none is in it."""
    p = table(spark, d, "pages").where(F.contains("html", F.lit("<article"))).select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("zone"), "page_id")
    f = p.groupBy("zone").agg(F.array_sort(F.collect_list("page_id")).alias("nodes"))
    inside = F.filter("nodes", lambda x: x % 3 == 0)
    return f.select("zone", F.array_join(F.transform(F.when(F.size(inside) > 0, inside).otherwise(F.col("nodes")), lambda x: x.cast("string")), ",").alias("nodes"))


def references(edges: DataFrame | None, indexed: DataFrame, name: str, live: Callable[[str], DataFrame] | None = None) -> tuple[str, DataFrame]:
    """Where a name is referred to, from the best source that answers: (source, rows).

    A live source first, if one is given and does not fail; then the symbol
    edges (to_name, path), if there are any for the name; then the symbols of
    the name (name, path).
    """
    if live is not None:
        try:
            return "live", live(name)
        except Exception:
            log.warning("live references failed; the index answers", exc_info=True)
    if edges is not None:
        hits = edges.where(F.lower("to_name") == name.lower())
        if hits.limit(1).count():
            return "indexed-edges", hits.select("path")
    return "indexed-symbols", indexed.where(F.lower("name") == name.lower()).select("path")


@query("""SELECT conv_id, string_agg(turn || ' ' || role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS notes FROM conversations GROUP BY conv_id""")
def investigation_report(spark: SparkSession, d: str) -> DataFrame:
    """An investigation's notes in order."""
    c = table(spark, d, "conversations")
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), "text")
    notes = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(notes, lambda s: s["line"]), "\n").alias("body"), F.count(F.lit(1)).alias("notes"))


ANALYZERS: tuple[tuple[str, Callable[[SparkSession, str], DataFrame]], ...] = (
    ("cycles", graph.scc_cycles), ("reachability", graph.unused_units), ("architecture", graph.layer_violations), ("duplication", clones.duplicate_files),
    ("symbols", symbols.unused_symbols), ("manifest", findings.unused_dependency), ("tests", graph.orphan_test), ("hotspots", findings.hotspot_findings), ("coverage", lifecycle.coverage),
)


def run_analyzers(spark: SparkSession, d: str, only: tuple[str, ...] | None = None, analyzers=ANALYZERS) -> DataFrame:
    """Rows (analyzer, status, findings) in the fixed order. One that fails is reported, and the others run; hotspots need all of them."""
    chosen = [a for a in analyzers if only is None or "hotspots" in only or a[0] in only]
    rows = []
    for name, f in chosen:
        try:
            rows.append((name, "success", f(spark, d).count()))
        except Exception:
            log.exception("analyzer %s failed", name)
            rows.append((name, "failed", None))
    return spark.createDataFrame(rows, "analyzer string, status string, findings long")
