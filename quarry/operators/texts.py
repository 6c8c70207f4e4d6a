"""Markdown sections, tool logs, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import slugify, summarize
from quarry.plans.registry import Registry
from quarry.plans.views import table

REGISTRY = Registry()
query = REGISTRY.query


def sections(texts: DataFrame, heading: str) -> DataFrame:
    """Rows (id, section, title, body) of rows (id, text): a line that matches begins a section; what comes before has number 0.

    The text is cut inside its row: the places of its heading lines are
    listed, and each section is a slice of the lines. The work is linear in
    the text, nothing is shuffled, and sections keep their order. A null
    text has none.
    """
    lines = texts.select("id", F.split("text", "\n", -1).alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(heading), i + 1)), lambda i: i.isNotNull())
    cut = lines.select("id", "lines", F.concat(F.array(F.lit(0)), heads).alias("heads"))

    def section(at, k):
        stop = F.coalesce(F.get("heads", k + 1), F.size("lines") + 1)
        return F.struct(F.get("lines", at - 1).alias("title"), F.array_join(F.slice("lines", at + 1, stop - at - 1), "\n").alias("body"))

    out = cut.select("id", F.posexplode(F.transform("heads", section)).alias("section", "s"))
    return out.select("id", "section", "s.title", "s.body")


@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_line FROM documents),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY at_line) AS section, regexp_matches(line, '^The ') AS is_head FROM l),
s AS (SELECT id, section, max(line) FILTER (WHERE is_head) AS title, list(trim(line) ORDER BY at_line) FILTER (WHERE NOT is_head AND trim(line) <> '') AS body FROM h GROUP BY id, section)
SELECT id, section::INT AS section, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
left(array_to_string(list_slice(coalesce(body, []), 1, 4), ' '), 500) AS summary FROM s WHERE title IS NOT NULL""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents, however long."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    s = sections(t, "^The ").where("title is not null")
    return s.select("id", "section", slugify(F.col("title")).alias("slug"), summarize(F.col("body")).alias("summary"))


LOG = (
    (1, "clang-tidy", "src/a.c:10:7: warning: unused variable x [misc-unused]"), (2, "clang-tidy", "src/a.c:9:1: note: declared here"),
    (3, "clang-tidy", "src/b.c:3:2: error: unknown type name foo [clang-diagnostic-error]"), (4, "clang-tidy", "2 warnings generated."),
    (5, "cppcheck", "src/c.c:7:5: error: Memory leak: p [memleak]"), (6, "cppcheck", "src/c.c:8:1: style: unused [unusedFunction]"),
    (7, "clang-tidy", "src/b.c:4:4: note: in expansion of macro"),
)
LINE = r"^([^:]+):([0-9]+):([0-9]+): (warning|error|note|style): (.*?)(?: \[([^\]]+)\])?$"
#: Kinds of events as lines of two tools' logs, a log for each user.
_SAID = {"view": "warning: value {v} [range-{v}]", "click": "note: declared here {v}", "error": "error: number {v} [bad-{v}]", "purchase": "style: spent {v}"}
_SAID_SQL = " ".join(f"WHEN '{k}' THEN '{a}' || v || '{b}'" if "]" in s else f"WHEN '{k}' THEN '{a}' || v" for k, s in _SAID.items() for a, b in [(s.replace("{v}", "' || v || '", s.count("{v}") - 1).split("{v}")[0], s.split("{v}")[-1])])
_LOG_SQL = f"""log AS (SELECT event_id AS n, CASE WHEN user_id % 2 = 0 THEN 'clang-tidy' ELSE 'cppcheck' END AS tool, user_id AS log,
CASE WHEN event_type = 'signup' THEN v || ' warnings generated.' ELSE 'src/' || user_id || '.c:' || (event_id % 900 + 1) || ':' || (v::INT % 70 + 1) || ': ' || CASE event_type {_SAID_SQL} END END AS line FROM (SELECT *, props->>'$.k' AS v FROM events))"""
_PARSED_SQL = f"""{_LOG_SQL}, p AS (SELECT n, tool, log, regexp_extract(line, '{LINE}', 1) AS path, regexp_extract(line, '{LINE}', 2)::INT AS line_no, regexp_extract(line, '{LINE}', 3)::INT AS col_no,
regexp_extract(line, '{LINE}', 4) AS severity, regexp_extract(line, '{LINE}', 5) AS message, regexp_extract(line, '{LINE}', 6) AS code FROM log WHERE regexp_matches(line, '{LINE}')),
g AS (SELECT *, sum(CASE WHEN severity <> 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY tool, log ORDER BY n) AS grp FROM p),
parsed AS (SELECT tool, log, min(n) AS n, first(path ORDER BY n) AS path, first(line_no ORDER BY n) AS line_no, first(col_no ORDER BY n) AS col_no, first(severity ORDER BY n) AS severity,
string_agg(message, chr(10) ORDER BY n) AS message, first(code ORDER BY n) AS code FROM g GROUP BY tool, log, grp)"""


def parse_log(log: DataFrame, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Diagnostics of rows (n, tool, line); a note is folded into the one before it of its log, which ``by`` tells from others: a window each."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    p = log.where(F.col("line").rlike(LINE)).select(
        "n", *by, part(1).alias("path"), part(2).cast("int").alias("line_no"), part(3).cast("int").alias("col_no"), part(4).alias("severity"), part(5).alias("message"), part(6).alias("code")
    )
    group = F.sum(F.when(F.col("severity") != "note", 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("n"))
    first = lambda c: F.min_by(c, "n").alias(c)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda s: s["message"]), "\n")
    return p.withColumn("grp", group).groupBy(*by, "grp").agg(
        F.min("n").alias("first_n"), first("path"), first("line_no"), first("col_no"), first("severity"), texts.alias("message"), first("code")
    ).select(*by, F.col("first_n").alias("n"), "path", "line_no", "col_no", "severity", "message", "code")


def _log(spark: SparkSession, d: str) -> DataFrame:
    text, v = lambda c: c.cast("string"), F.get_json_object("props", "$.k")
    kind, user = F.col("event_type"), F.col("user_id")
    said = F.coalesce(*(F.when(kind == k, F.replace(F.lit(s), F.lit("{v}"), v)) for k, s in _SAID.items()))
    place = F.concat(F.lit("src/"), text(user), F.lit(".c:"), text(F.col("event_id") % 900 + 1), F.lit(":"), text(v.cast("int") % 70 + 1), F.lit(": "))
    line = F.when(kind == "signup", F.concat(v, F.lit(" warnings generated."))).otherwise(F.concat(place, said))
    return table(spark, d, "events").select(F.col("event_id").alias("n"), F.when(user % 2 == 0, "clang-tidy").otherwise("cppcheck").alias("tool"), user.alias("log"), line.alias("line"))


@query(f"WITH {_PARSED_SQL} SELECT * FROM parsed")
def diagnostic_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_log(_log(spark, d), ("tool", "log"))


@query(f"""WITH {_PARSED_SQL} SELECT tool || ':' || code AS rule_id, path, line_no AS line, col_no AS col, severity, CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS confidence
FROM parsed WHERE severity IN ('error', 'warning')""")
def c_audit(spark: SparkSession, d: str) -> DataFrame:
    p = parse_log(_log(spark, d), ("tool", "log")).where("severity in ('error', 'warning')")
    return p.select(
        F.concat("tool", F.lit(":"), "code").alias("rule_id"), "path", F.col("line_no").alias("line"), F.col("col_no").alias("col"), "severity",
        F.when(F.col("severity") == "error", "high").otherwise("medium").alias("confidence"),
    )


STAGES = ("pars|lex|are", "load|import|the ", "build|compile|tion", "render|emit|www", "error|fail|zzz")
_STAGE_SQL = " + ".join(f"bool_or(regexp_matches(t, '{r}'))::INT" for r in STAGES)


@query(f"WITH s AS (SELECT source AS zone, lower(text) AS t FROM documents UNION ALL SELECT source, lang FROM documents) SELECT zone, {_STAGE_SQL} AS stages FROM s GROUP BY zone HAVING {_STAGE_SQL} >= 2")
def phase_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Zones whose names and paths show two stages of work or more."""
    docs = table(spark, d, "documents")
    s = docs.select(F.col("source").alias("zone"), F.lower("text").alias("t")).union(docs.select("source", "lang"))
    n = sum((F.bool_or(F.col("t").rlike(r)).cast("int") for r in STAGES), F.lit(0))
    return s.groupBy("zone").agg(n.alias("stages")).where("stages >= 2")
