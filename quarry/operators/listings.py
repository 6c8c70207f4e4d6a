"""Listings: projections and lookups of nodes, scopes, orders with their ties, ladders, and rows as JSON."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import hotspot_score, on_line, parse_range
from quarry.operators.findings import DEGREE, FOUND, _layer_sql, findings, outliers
from quarry.operators.graph import REACH, unused_units
from quarry.operators.lifecycle import RUNS, analyzer_runs
from quarry.operators.related import mention_pairs, related_fusion
from quarry.plans.registry import Registry
from quarry.plans.views import STATS, TOUCHES, UNITS, file_stats, table, touches, units

REGISTRY = Registry()
query = REGISTRY.query
log = logging.getLogger(__name__)

_META = "CASE WHEN p_partkey % 100 = 0 THEN '{\"entrypoint\":true}' WHEN p_size = 1 THEN '{\"entrypoint\":\"inferred\"}' END"
NODES = f"nodes AS (SELECT 'unit:' || p_brand || '/' || p_partkey AS key, p_name AS label, p_brand || '/' || p_partkey AS path, p_brand AS zone, p_type AS language, {_META} AS metadata FROM part)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes, their metadata as JSON."""
    path = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    meta = F.when(F.col("p_partkey") % 100 == 0, '{"entrypoint":true}').when(F.col("p_size") == 1, '{"entrypoint":"inferred"}')
    return table(spark, d, "part").select(F.concat(F.lit("unit:"), path).alias("key"), F.col("p_name").alias("label"), path.alias("path"), F.col("p_brand").alias("zone"), F.col("p_type").alias("language"), meta.alias("metadata"))


@query(f"WITH {NODES} SELECT key, label, path, language, metadata->>'$.entrypoint' AS entrypoint FROM nodes")
def node_projection(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("key", "label", "path", "language", F.get_json_object("metadata", "$.entrypoint").alias("entrypoint"))


@query(f"WITH {NODES} SELECT key, label, path FROM nodes WHERE key = 'unit:Brand#11/' || (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#11')")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One node by its key: a filter that the scan can prune by. The key asked for is the first one's of a zone."""
    first = table(spark, d, "part").where("p_brand = 'Brand#11'").agg(F.min("p_partkey")).first()[0]
    return nodes(spark, d).where(F.col("key") == f"unit:Brand#11/{first}").select("key", "label", "path")


def in_scope(rows: DataFrame, ref: str) -> DataFrame:
    """The nodes that a reference means: all for ``repo:.``, those of a ``zone:``, else the one of that key."""
    if ref == "repo:.":
        return rows
    if ref.startswith("zone:"):
        return rows.where(F.startswith("path", F.lit(ref[5:] + "/")))
    return rows.where(F.col("key") == ref)


@query(f"WITH {NODES} SELECT 'repo:.' AS ref, count(*) AS n FROM nodes UNION ALL SELECT 'zone:Brand#11', count(*) FROM nodes WHERE starts_with(path, 'Brand#11/') UNION ALL SELECT 'unit:none', count(*) FROM nodes WHERE key = 'unit:none'")
def scope_router(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for ref in ("repo:.", "zone:Brand#11", "unit:none"):
        one = in_scope(nodes(spark, d), ref).agg(F.lit(ref).alias("ref"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


#: How children are ordered by each metric; ties by file.
ORDERS = {"score": "score DESC", "churn": "churn DESC", "loc": "loc DESC", "recent": "recency"}
_SORTED = f"""WITH {STATS}, m AS (SELECT greatest(max(churn), 1) AS mc, greatest(max(loc), 1) AS ml FROM stats),
s AS (SELECT file, zone, churn, loc, recency, 0.6::DOUBLE * churn / mc + 0.4::DOUBLE * loc / ml AS score FROM stats, m) """


@query(_SORTED + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS metric, row_number() OVER (ORDER BY {o}, file) AS pos, file FROM s WHERE zone = 'Brand#11') WHERE pos <= 20" for k, o in ORDERS.items()))
def children_sorted(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    """A zone's first children in each of the four orders. The limit comes before the numbers: only its rows meet in one task."""
    s = file_stats(spark, d)
    m = s.agg(F.max("churn").alias("mc"), F.max("loc").alias("ml"))
    s = s.join(F.broadcast(m)).where("zone = 'Brand#11'").withColumn("score", hotspot_score(F.col("churn"), F.col("loc"), F.col("mc"), F.col("ml")))
    out = None
    for metric, order in ORDERS.items():
        by = [F.expr(order.split()[0]).desc() if order.endswith("DESC") else F.expr(order), F.col("file")]
        one = s.orderBy(*by).limit(limit).select(F.lit(metric).alias("metric"), F.row_number().over(Window.orderBy(*by)).cast("long").alias("pos"), "file")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {UNITS} SELECT 'zone:' || zone AS key, count(*) AS files FROM units GROUP BY zone ORDER BY files DESC, key LIMIT 10")
def zones_order(spark: SparkSession, d: str) -> DataFrame:
    """Zones have no score of their own: they come by their number of files, ties by key."""
    z = units(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("files"))
    return z.select(F.concat(F.lit("zone:"), "zone").alias("key"), "files").orderBy(F.desc("files"), "key").limit(10)


@query(f"WITH {UNITS}, z AS (SELECT 'zone:' || zone AS key, count(*) AS files FROM units GROUP BY zone ORDER BY files DESC, key LIMIT 10) SELECT * FROM z WHERE key LIKE '%1%'")
def zones_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A filter after the limit, which may leave fewer rows than asked for."""
    return zones_order(spark, d).where("key like '%1%'")


@query(f"WITH {TOUCHES} SELECT hash, ts FROM touches WHERE file = (SELECT min(file) FROM touches) ORDER BY ts DESC, hash DESC LIMIT 20")
def evidence_order(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    """The newest commits of a file as its evidence, ties by falling id."""
    t = touches(spark, d)
    seed = t.agg(F.min("file").alias("file"))
    return t.join(F.broadcast(seed), "file", "left_semi").select("hash", "ts").orderBy(F.desc("ts"), F.desc("hash")).limit(limit)


@query(f"WITH {RUNS} SELECT run_id, count(*) AS rows FROM runs GROUP BY run_id ORDER BY run_id DESC LIMIT 10")
def run_list(spark: SparkSession, d: str) -> DataFrame:
    return analyzer_runs(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("run_id")).limit(10)


@query(f"""WITH RECURSIVE {_layer_sql()}, {FOUND}, {REACH}, {STATS}, {DEGREE},
a AS (SELECT avg(loc) AS ml FROM stats), b AS (SELECT avg(coalesce(degree, 0)) AS md FROM stats LEFT JOIN degree ON node = file),
u AS (SELECT 'architecture' AS category, rule_id, path || '#' || anchor || '#' || dst AS id FROM found
UNION ALL SELECT 'hotspots', 'complexity-outlier', file::VARCHAR FROM stats, a WHERE loc >= 40 AND loc >= 1.5::DOUBLE * ml
UNION ALL SELECT 'hotspots', 'high-centrality-risk', file::VARCHAR FROM stats JOIN degree ON node = file, b WHERE degree >= 5 AND degree >= 2 * md
UNION ALL SELECT 'reachability', 'unused-file', p_partkey::VARCHAR FROM part LEFT JOIN reach ON node = p_partkey WHERE coalesce(reach, 0) < 1 AND NOT starts_with(p_name, 'blue') AND (SELECT count(*) FROM roots) > 0)
SELECT category, rule_id, id FROM u ORDER BY category, rule_id, id""")
def findings_list(spark: SparkSession, d: str) -> DataFrame:
    """Findings of several analyzers in the order of a listing: category, rule, id."""
    a = findings(spark, d).select(F.lit("architecture").alias("category"), "rule_id", F.concat_ws("#", "path", "anchor", F.col("dst").cast("string")).alias("id"))
    b = outliers(spark, d).select(F.lit("hotspots").alias("category"), "rule_id", F.col("file").cast("string").alias("id"))
    c = unused_units(spark, d).select(F.lit("reachability").alias("category"), F.lit("unused-file").alias("rule_id"), F.col("file").cast("string").alias("id"))
    return a.union(b).union(c).orderBy("category", "rule_id", "id")


MAX_FLOWS, MAX_NODES, MAX_EVIDENCE = 20, 10, 120


@query(f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS zone, page_id, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY page_id) AS k FROM p)
SELECT zone, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS nodes, left(min_by(url, page_id), {MAX_EVIDENCE}) AS evidence FROM r WHERE k <= {MAX_NODES} GROUP BY zone ORDER BY zone LIMIT {MAX_FLOWS}""")
def flow_caps(spark: SparkSession, d: str) -> DataFrame:
    """What a listing of flows shows: the first flows, of each the first nodes, and the beginning of its evidence."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("zone"), "page_id", "url")
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("zone").orderBy("page_id"))).where(F.col("k") <= MAX_NODES)
    ids = F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string"))
    flows = first.groupBy("zone").agg(F.array_join(ids, ",").alias("nodes"), F.left(F.min_by("url", "page_id"), F.lit(MAX_EVIDENCE)).alias("evidence"))
    return flows.orderBy("zone").limit(MAX_FLOWS)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT 'unit:' || item_id AS unit, 'doc_section:' || l.doc_id || '#' || pos AS section, 'doc:' || source AS doc FROM l JOIN benchmark b ON contains(line, b.text) AND length(b.text) >= 3 JOIN documents d ON d.doc_id = l.doc_id""")
def markdown_context(spark: SparkSession, d: str) -> DataFrame:
    """From a unit over the sections (lines) that mention it, and what contains them, to the document."""
    docs = table(spark, d, "documents")
    sections = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    sections = sections.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), (F.col("at") + 1).cast("string")).alias("id"), "text")
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name"))
    mentions = mention_pairs(sections, names).withColumn("doc_id", F.substring_index("id", "#", 1).cast("long"))
    return mentions.join(docs.select("doc_id", "source"), "doc_id").select(
        F.concat(F.lit("unit:"), F.col("name_id").cast("string")).alias("unit"), F.concat(F.lit("doc_section:"), "id").alias("section"), F.concat(F.lit("doc:"), "source").alias("doc")
    )


LOCATION = ["path", "line", "col", "end_line", "end_col"]
_LOCATIONS = "SELECT user_id AS path, event_id % 50 AS line, event_id % 3 AS col, event_id % 50 AS end_line, event_id % 3 + 5 AS end_col FROM events"


@query(f"SELECT DISTINCT * FROM ({_LOCATIONS})")
def location_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Locations that several sources gave, each once by its five parts."""
    e = table(spark, d, "events")
    line, col = F.col("event_id") % 50, F.col("event_id") % 3
    return e.select(F.col("user_id").alias("path"), line.alias("line"), col.alias("col"), line.alias("end_line"), (col + 5).alias("end_col")).dropDuplicates(LOCATION)


_RANGE = "CASE event_id % 3 WHEN 0 THEN '{\"start\":{\"line\":' || event_id % 77 || ',\"character\":2}}' WHEN 1 THEN '{\"start\":' ELSE '{}' END"
_SELECTION = "CASE event_id % 5 WHEN 0 THEN '{\"start\":{\"line\":' || event_id % 33 || ',\"character\":1}}' END"


@query(f"""WITH r AS (SELECT event_id, {_RANGE} AS r, {_SELECTION} AS s FROM events),
p AS (SELECT event_id, CASE WHEN json_valid(r) THEN (r->>'$.start.line')::INT END AS a, CASE WHEN json_valid(s) THEN (s->>'$.start.line')::INT END AS b FROM r)
SELECT event_id, coalesce(b, a, 999999) AS line FROM p ORDER BY line, event_id LIMIT 200""")
def positions(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by where they stand: the selection's line, else the range's, else last. Malformed ranges are none."""
    e = table(spark, d, "events").select("event_id", F.expr(_RANGE).alias("r"), F.expr(_SELECTION).alias("s"))
    line = F.coalesce(parse_range(F.col("s"))["line"], parse_range(F.col("r"))["line"], F.lit(999999))
    return e.select("event_id", line.alias("line")).orderBy("line", "event_id").limit(200)


@query(f"""WITH {UNITS} SELECT path, coalesce(regexp_matches(string_split(text, chr(10))[id % 3 + 1], '\\bof\\b'), false) AS exported FROM units""")
def export_check(spark: SparkSession, d: str) -> DataFrame:
    """If the line of a declaration holds a word; the line is the id's remainder by three, the word ``of``."""
    return units(spark, d).select("path", on_line(F.col("text"), (F.col("id") % 3).cast("int"), "of").alias("exported"))


def ranked(related: DataFrame, limit: int = 20) -> DataFrame:
    """Related nodes (key, score, recency, path) by falling score, then recency (none is 999), then path."""
    return related.orderBy(F.desc("score"), F.coalesce("recency", F.lit(999)), "path").limit(limit)


def _related_sql() -> str:
    from quarry.operators.related import REGISTRY as own

    head, _, tail = own.sql["related_fusion"].rpartition("SELECT key, round(")
    return f"{head}, fused AS (SELECT key, round({tail}) SELECT key, fused.score, recency FROM fused JOIN stats ON file = key ORDER BY fused.score DESC, recency, key LIMIT 20"


@query(_related_sql())
def related_ranked(spark: SparkSession, d: str) -> DataFrame:
    fused = related_fusion(spark, d).join(file_stats(spark, d).select(F.col("file").alias("key"), "recency"), "key")
    return ranked(fused.withColumn("path", F.col("key"))).select("key", "score", "recency")


@query(f"WITH {UNITS}, s AS (SELECT language, count(*) AS files FROM units GROUP BY language) SELECT '{{\"language\":\"' || language || '\",\"files\":' || files || '}}' AS json FROM s")
def json_output(spark: SparkSession, d: str) -> DataFrame:
    """Any answer as rows of JSON."""
    return as_json(units(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files")))


def as_json(answer: DataFrame) -> DataFrame:
    return answer.select(F.to_json(F.struct("*")).alias("json"))


def definitions_ladder(indexed: DataFrame, name: str, live: Callable[[str], DataFrame] | None = None, indexed_only: bool = False) -> tuple[str, bool, DataFrame]:
    """Where a name is defined: (source, degraded, rows), from a live source if one answers, else from the index (name, path).

    Asking for the index only isn't a degraded answer; a live source that
    fails or finds nothing makes one.
    """
    if not indexed_only and live is not None:
        try:
            rows = live(name)
            if rows.limit(1).count():
                return "semantic", False, rows
        except Exception:
            log.warning("live definitions failed; the index answers", exc_info=True)
    return "indexed", not indexed_only, indexed.where(F.lower("name") == name.lower())


def abi_family(language: Column) -> Column:
    """The family of languages that link by C names, null for others."""
    low = F.lower(language)
    return F.when(low.isin("c", "cpp", "c++", "c/c++"), "c").when(low == "rust", "rust").when(low == "zig", "zig")
