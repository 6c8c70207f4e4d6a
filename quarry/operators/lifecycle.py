"""Runs, capabilities, carried rows, coverage, token savings, investigations, analyzer selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.plans.views import table
from quarry.sources.registry import detect_languages, load_registry, registry_rows, select_analyzers

REGISTRY = Registry()
query = REGISTRY.query


def analyzer_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as analyzer runs: run (day), capability (event type) and status by the number in the props."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 10, "failed").when(k < 25, "skipped").otherwise("success")
    return table(spark, d, "events").select(
        "event_id", F.dayofyear("ts").cast("long").alias("run_id"), F.col("event_type").alias("capability"), status.alias("status"), "value", "user_id"
    )


RUNS = """runs AS (SELECT event_id, dayofyear(ts)::BIGINT AS run_id, event_type AS capability, value, user_id,
CASE WHEN (props->>'$.k')::INT < 10 THEN 'failed' WHEN (props->>'$.k')::INT < 25 THEN 'skipped' ELSE 'success' END AS status FROM events)"""


@query(f"""WITH {RUNS}, c AS (SELECT capability, status, count(*) AS n FROM runs GROUP BY ALL)
SELECT capability, sum(n)::BIGINT AS attempted, coalesce(sum(n) FILTER (WHERE status = 'success'), 0)::BIGINT AS success, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM c GROUP BY capability""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = analyzer_runs(spark, d).groupBy("capability", "status").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("capability").agg(
        F.sum("n").alias("attempted"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("n"))), F.lit(0)).alias("success"),
        F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), ",").alias("statuses"),
    )


CAPABILITIES = ("click", "error", "purchase", "symbols", "view")


@query(f"""WITH {RUNS}, cap AS (SELECT unnest({list(CAPABILITIES)}) AS capability), r AS (SELECT capability, count(*) AS n, count(*) FILTER (WHERE status = 'success') AS ok FROM runs GROUP BY 1)
SELECT capability, CASE WHEN n IS NULL THEN 'warn' WHEN ok > 0 THEN 'pass' ELSE 'fail' END AS verdict FROM cap LEFT JOIN r USING (capability)""")
def fidelity(spark: SparkSession, d: str) -> DataFrame:
    """pass: exercised with success; fail: exercised without; warn: not exercised."""
    caps = spark.createDataFrame([(c,) for c in CAPABILITIES], "capability string")
    r = analyzer_runs(spark, d).groupBy("capability").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("ok"))
    verdict = F.when(F.col("n").isNull(), "warn").when(F.col("ok") > 0, "pass").otherwise("fail")
    return caps.join(r, "capability", "left").select("capability", verdict.alias("verdict"))


@query(f"""WITH {RUNS} SELECT run_id, count(*) AS events, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
count(*) FILTER (WHERE capability = 'view') AS views, count(DISTINCT user_id) AS users FROM runs GROUP BY run_id""")
def enricher_counts(spark: SparkSession, d: str) -> DataFrame:
    return analyzer_runs(spark, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("capability") == "view").alias("views"), F.count_distinct("user_id").alias("users"),
    )


_HAS = "value >= 150"


@query(f"""WITH {RUNS}, latest AS (SELECT max(run_id) AS latest FROM runs), c AS (SELECT capability, max(run_id) FILTER (WHERE {_HAS}) AS resolved FROM runs GROUP BY 1)
SELECT capability, latest, resolved, CASE WHEN resolved < latest THEN latest END AS fallback_from FROM c, latest""")
def capability_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run with rows of a capability, and the latest run if it had to fall back."""
    r = analyzer_runs(spark, d)
    c = r.groupBy("capability").agg(F.max(F.when(F.expr(_HAS), F.col("run_id"))).alias("resolved"))
    return c.join(F.broadcast(r.agg(F.max("run_id").alias("latest")))).select(
        "capability", "latest", "resolved", F.when(F.col("resolved") < F.col("latest"), F.col("latest")).alias("fallback_from")
    )


@query(f"""WITH {RUNS}, ids AS (SELECT DISTINCT run_id FROM runs), keep AS (SELECT run_id FROM (SELECT run_id FROM ids ORDER BY run_id DESC LIMIT 3)
UNION SELECT max(run_id) FROM runs WHERE {_HAS} GROUP BY capability UNION SELECT DISTINCT run_id FROM runs WHERE user_id = 42)
SELECT run_id FROM ids WHERE run_id NOT IN (SELECT run_id FROM keep)""")
def prune_plan(spark: SparkSession, d: str, keep: int = 3) -> DataFrame:
    """Runs that may go: not among the newest, none's capability run, and not in an investigation (user 42)."""
    r = analyzer_runs(spark, d)
    ids = r.select("run_id").distinct()
    newest = ids.orderBy(F.desc("run_id")).limit(max(keep, 1))
    capable = r.where(_HAS).groupBy("capability").agg(F.max("run_id").alias("run_id")).select("run_id")
    held = newest.union(capable).union(r.where("user_id = 42").select("run_id")).distinct()
    return ids.join(held, "run_id", "left_anti")


@query("""WITH p AS (SELECT l_partkey AS path, l_linenumber AS run, md5(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey, l_orderkey)) AS meta FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT c.path, c.meta = q.meta AS carried FROM p c JOIN p q ON q.path = c.path AND q.run = 1 WHERE c.run = 2""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Files of the new run and whether their rows are carried from the one before: only if the metadata are equal."""
    line = table(spark, d, "lineitem").where("l_linenumber <= 2")
    order = F.array_sort(F.collect_list(F.struct("l_suppkey", "l_orderkey")))
    p = line.groupBy("l_partkey", "l_linenumber").agg(F.md5(F.array_join(F.transform(order, lambda s: s["l_suppkey"].cast("string")), ",")).alias("meta"))
    old, new = (p.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("path"), F.col("meta").alias(f"m{n}")) for n in (1, 2))
    return new.join(old, "path").select("path", (F.col("m1") == F.col("m2")).alias("carried"))


@query("""WITH t AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'user' THEN round(length(text) / 4.0::DOUBLE) ELSE 0 END AS e FROM conversations WHERE role <> 'system')
SELECT conv_id, round(sum(i) / 4.0::DOUBLE)::BIGINT AS ingested, sum(e)::BIGINT AS emitted, greatest(0, round(sum(i) / 4.0::DOUBLE)::BIGINT - sum(e)::BIGINT) AS saved, count(*) AS events FROM t GROUP BY conv_id""")
def token_savings(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    t = table(spark, d, "conversations").where("role <> 'system'").select(
        "conv_id", F.when(F.col("role") == "assistant", n).otherwise(0).alias("i"), F.when(F.col("role") == "user", F.round(n / 4.0)).otherwise(0).cast("long").alias("e")
    )
    s = t.groupBy("conv_id").agg(F.round(F.sum("i") / 4.0).cast("long").alias("ingested"), F.sum("e").alias("emitted"), F.count(F.lit(1)).alias("events"))
    return s.select("conv_id", "ingested", "emitted", F.greatest(F.lit(0).cast("long"), F.col("ingested") - F.col("emitted")).alias("saved"), "events")


@query("""SELECT conv_id, first(text ORDER BY turn, text) AS question, count(*) FILTER (WHERE role = 'assistant') AS pins, count(*) AS notes, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def investigation_detail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by("text", F.struct("turn", "text")).alias("question"), F.count_if(F.col("role") == "assistant").alias("pins"), F.count(F.lit(1)).alias("notes"), F.max("turn").alias("last_turn")
    )


def _language(name: str, ending: str, *analyzers: tuple[str, int, str, str]) -> str:
    rows = "".join(
        f"      - id: {a}\n        kind: lsp\n        tool: {a}\n        command:\n          - {a}\n        capabilities:\n" + "".join(f"          - {c}\n" for c in able.split())
        + f"        priority: {p}\n" + (f"        required_files:\n          - {need}\n" if need else "") for a, p, able, need in analyzers
    )
    return f"  - id: {name}\n    display_name: {name}\n    detect:\n      extensions:\n        - {ending}\n" + (f"    analyzers:\n{rows}" if rows else "")


#: A registry of the test tables: documents' languages, and tools that are kinds of events.
REGISTRY_TEXT = "version: 1\nlanguages:\n" + "".join((
    _language("english", ".en", ("view", 90, "symbols defs", "src1/1.en"), ("click", 90, "symbols", ""), ("error", 10, "symbols refs", "src0/0.xx"), ("signup", 5, "refs", "")),
    _language("french", ".fr", ("purchase", 50, "symbols diagnostics", ""), ("absent", 70, "diagnostics refs", ""), ("view", 1, "diagnostics", "")),
    _language("german", ".de", ("click", 20, "symbols", "no/such.file")), _language("spanish", ".es"), _language("italian", ".it", ("view", 1, "symbols", "")),
))
PLUGINS = {"english-plugin": ("english",), "romance-plugin": ("french", "italian")}
_ROWS = registry_rows(REGISTRY_TEXT)
_REG_SQL = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', '{r[3][0]}', {r[5]}, '{r[6]}', {r[10]}, {r[11]}, {r[12] or '[]::VARCHAR[]'})" if r[6] else f"('{r[0]}', '{r[3][0]}', NULL, NULL, []::VARCHAR[], NULL, []::VARCHAR[])" for r in _ROWS
) + """) v(language, ending, nth, analyzer, able, priority, required)), paths AS (SELECT source || '/' || doc_id || '.' || lang AS path FROM documents),
met AS (SELECT language, analyzer, count(*) AS met FROM (SELECT language, analyzer, unnest(required) AS path FROM reg) JOIN (SELECT DISTINCT path FROM paths) USING (path) GROUP BY ALL),
ok AS (SELECT reg.* FROM reg LEFT JOIN met USING (language, analyzer) WHERE analyzer IS NOT NULL AND coalesce(met, 0) = len(required))"""  # fmt: skip


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"))


@query(f"""WITH {RUNS}, {_REG_SQL}, o AS (SELECT capability AS analyzer, last(status ORDER BY event_id) AS status FROM runs GROUP BY 1),
e AS (SELECT language, unnest(able) AS capability, analyzer, priority, nth, status FROM ok LEFT JOIN o USING (analyzer)),
t AS (SELECT *, row_number() OVER (PARTITION BY language, capability ORDER BY priority DESC, nth) AS attempt FROM e), w AS (SELECT *, min(attempt) FILTER (WHERE status = 'success') OVER (PARTITION BY language, capability) AS won FROM t)
SELECT language, capability, analyzer, attempt::INT AS attempt, coalesce(status, 'unavailable') AS status, coalesce(attempt = won, false) AS selected FROM w WHERE won IS NULL OR attempt <= won""")
def analyzer_selection(spark: SparkSession, d: str) -> DataFrame:
    """Attempts for each capability of a registry, by the files that there are and the last run of each tool."""
    last = analyzer_runs(spark, d).groupBy(F.col("capability").alias("analyzer")).agg(F.max_by("status", "event_id").alias("status"))
    return select_analyzers(load_registry(REGISTRY_TEXT).frame(spark), _paths(spark, d), last)


@query(f"""WITH {_REG_SQL}, f AS (SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS ending, count(*) AS n FROM paths GROUP BY 1)
SELECT language, CASE WHEN language = 'english' THEN 'english-plugin' WHEN language IN ('french', 'italian') THEN 'romance-plugin' ELSE 'registry' END AS plugin,
CASE WHEN language IN (SELECT language FROM ok) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence, sum(n)::BIGINT AS files FROM f JOIN (SELECT DISTINCT language, ending FROM reg) USING (ending) GROUP BY language""")
def plugin_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of all documents by a registry, with who answers for each and how surely."""
    return detect_languages(load_registry(REGISTRY_TEXT).frame(spark), _paths(spark, d), PLUGINS)
