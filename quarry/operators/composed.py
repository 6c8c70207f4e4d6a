"""Composed reports: what several tables say of a node or an investigation, cut to its best before it is brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import hotspot_score, risk_level
from quarry.operators import investigations as log
from quarry.operators.navigator import degree_centrality
from quarry.plans.registry import Registry
from quarry.plans.views import EDGES, STATS, file_stats, table, touches, units

REGISTRY = Registry()
query = REGISTRY.query

# How much of each a report shows.
EVIDENCE, CHILDREN, SYMBOLS, FLOWS, LOOK_AT, CONTEXT = 20, 20, 50, 3, 4, 3
TRACED_KINDS = ("Class", "Function", "Interface", "Method")
#: Stages between which a unit may pass things on, by patterns of its path and its symbols' names.
STAGES = (
    ("token stream", "token|lexer|lex"), ("AST nodes", "ast|parse|parser"), ("expanded forms", "expand|macro"), ("IR program", r"\bir\b|lower"), ("bytecode", "bytecode|opcode|emit"),
)


def best_of(rows: DataFrame, by: str, order: list[Column], k: int, name: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows (by, name): the first ``k`` of each in ``order``, as structs of ``columns``.

    Spark cuts each partition's groups to k rows before the shuffle, so a
    group of any size costs k rows a partition, and its array holds k at
    most. Rows without a key have no group.
    """
    pos = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = rows.where(F.col(by).isNotNull()).select(by, *columns, pos.alias("pos")).where(F.col("pos") <= k)
    listed = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return first.groupBy(by).agg(F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def hundredths(x: Column) -> Column:
    """A number that isn't negative with two digits after the point."""
    n = F.floor(x * 100 + 0.5).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def reports_of(nodes: DataFrame, evidence: DataFrame, symbols: DataFrame, degrees: DataFrame, diagnostics: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One row a node: its facts, level of risk with reasons, phases, and bounded arrays of evidence, symbols, children and guidance.

    ``nodes`` (key, kind, label, path, parent, score, loc, churn, recency,
    summary), each key once; ``evidence`` (key, kind, source, locator,
    snippet, at, seq), the newest first; ``symbols`` (key, name, kind), by
    name; ``degrees`` (key, degree); ``diagnostics`` (key), one row each;
    ``flows`` (key, label, kind, confidence), the surest first. Children are
    nodes whose ``parent`` is the key, by falling score.

    All are joined on the key by equality, a shuffle each. What a node has
    nothing of is an empty array; a null score or count is 0, a null recency
    unknown. Rows for keys that aren't nodes change nothing, and nodes with
    a null key are left out, as children too. Phases look at all symbols, not only at those
    shown, and need two stages. Guidance is the flows, or else names to look
    at.
    """
    nodes = nodes.where("key is not null")
    held = best_of(evidence.withColumnRenamed("kind", "what"), "key", [F.desc_nulls_last("at"), F.desc("seq")], EVIDENCE, "evidence", ("what", "source", "locator", "snippet"))
    named = best_of(symbols.where("name is not null"), "key", [F.col("name"), F.col("kind")], SYMBOLS, "symbols", ("name", "kind"))
    stage = lambda text, pattern: F.coalesce(F.lower(text).rlike(pattern), F.lit(False))
    passed = symbols.groupBy("key").agg(*(F.max(stage(F.col("name"), p)).alias(f"stage{i}") for i, (_, p) in enumerate(STAGES)))
    below = nodes.select(F.col("parent").alias("key"), F.col("key").alias("child"), F.coalesce("score", F.lit(0.0)).alias("score"))
    below = best_of(below, "key", [F.desc("score"), F.col("child")], CHILDREN, "children", ("child", "score"))
    wrong = diagnostics.groupBy("key").agg(F.count(F.lit(1)).alias("diagnostics"))
    out = nodes.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("score", "loc", "churn")})
    for part in (held, named, passed, below, wrong, degrees.groupBy("key").agg(F.max("degree").alias("degree"))):
        out = out.join(part, "key", "left")
    if flows is not None:
        out = out.join(best_of(flows.withColumnRenamed("kind", "what"), "key", [F.desc("confidence"), F.col("label")], FLOWS, "flows", ("label", "what", "confidence")), "key", "left")
    else:
        out = out.withColumn("flows", F.expr("cast(null as array<struct<label: string, what: string, confidence: double>>)"))
    out = out.withColumns({c: F.coalesce(c, F.array()) for c in ("evidence", "symbols", "children", "flows")} | {c: F.coalesce(c, F.lit(0)) for c in ("degree", "diagnostics")})
    counted = lambda c, before, after: F.when(F.col(c) > 0, F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after)))
    reasons = F.array_compact(F.array(
        F.when(F.col("score") >= 0.75, F.concat(F.lit("high hotspot score ("), hundredths(F.col("score")), F.lit(")")))
        .when(F.col("score") >= 0.5, F.concat(F.lit("elevated hotspot score ("), hundredths(F.col("score")), F.lit(")"))),
        F.when(F.col("churn") >= 5, counted("churn", "recently high churn (", ")")),
        F.when(F.col("degree") >= 5, counted("degree", "connected to ", " graph edges")),
        counted("diagnostics", "", " diagnostics recorded"),
    ))
    seen = F.array_compact(F.array(*(F.when(F.coalesce(f"stage{i}", F.lit(False)) | (F.col("kind") == "unit") & stage(F.col("path"), p), label) for i, (label, p) in enumerate(STAGES))))
    traced = F.filter("symbols", lambda s: s["kind"].isin(*TRACED_KINDS) & s["name"].rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))
    looked = F.transform(F.slice(traced, 1, LOOK_AT), lambda s: F.concat(F.lit("references of "), s["name"]))
    guidance = (
        F.when(F.size("flows") > 0, F.transform("flows", lambda f: F.concat(F.lit("flow heuristic: "), f["label"], F.lit(" ("), f["what"], F.lit(", confidence "), hundredths(f["confidence"]), F.lit(")"))))
        .when(F.size(traced) > 0, F.concat(F.array(F.lit("no flow edges detected; names to trace instead:")), looked))
        .otherwise(F.array(F.lit("no flow edges detected; look at the related nodes")))
    )
    return out.select(
        "key", "kind", "label", "score", "loc", "churn", "recency", "summary", risk_level(F.col("score"), F.col("churn"), F.col("degree"), F.col("diagnostics")).alias("level"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("no elevated risk signals detected"))).alias("reasons"),
        F.when(F.size(seen) > 1, seen).otherwise(F.array().cast("array<string>")).alias("phases"), "evidence", "symbols", "children", guidance.alias("guidance"),
    )


def _section(head: str, lines: Column, always: bool = False) -> Column:
    """A head and its lines, with an empty line after them; nothing without lines."""
    text = F.concat(F.lit(f"{head}\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    return text if always else F.when(F.size(lines) > 0, text).otherwise("")


def markdown(reports: DataFrame) -> DataFrame:
    """Rows (key, body): each report as Markdown."""
    some = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(" → "), c)).otherwise("")
    known = F.when(F.coalesce("recency", F.lit(999)) > 900, "unknown").otherwise(F.concat(F.col("recency").cast("string"), F.lit(" days")))
    facts = (F.size("evidence") > 0) | (F.size("symbols") > 0) | (F.size("children") > 0)
    body = F.concat(
        F.lit("# "), F.coalesce("label", "key"), F.lit("  ["), "kind", F.lit("]\n\n**Score:** "), hundredths(F.col("score")), F.lit("  **LOC:** "), F.col("loc").cast("string"),
        F.lit("  **Churn:** "), F.col("churn").cast("string"), F.lit("  **Recency:** "), known, F.lit("\n\n## Risk\nLevel: "), "level", F.lit("\n"),
        F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit("\n\n## Inferred Summary\n"), F.coalesce("summary", F.lit("No summary available")), F.lit("\n\n"),
        F.when(F.size("phases") > 0, F.concat(F.lit("## Phase Boundaries\nArtifacts crossing phases: "), F.array_join("phases", " -> "), F.lit("\n\n"))).otherwise(""),
        F.when(facts, "## Observed Facts\n\n").otherwise(""),
        _section("### Evidence", F.transform("evidence", lambda e: F.concat(F.lit("- "), e["what"], F.lit(": "), F.coalesce(e["source"], F.lit("")), some(e["locator"]), some(e["snippet"])))),
        _section("### Symbols", F.transform("symbols", lambda s: F.concat(F.lit("- "), s["name"], F.lit(" ("), F.coalesce(s["kind"], F.lit("")), F.lit(")")))),
        _section("### Children", F.transform("children", lambda c: F.concat(F.lit("- "), c["child"], F.lit("  score: "), hundredths(c["score"])))),
        _section("## Guidance", F.transform("guidance", lambda g: F.concat(F.lit("- "), g)), always=True),
    )
    return reports.select("key", body.alias("body"))


def as_json(reports: DataFrame) -> DataFrame:
    """Rows (key, body): each report as JSON, with nulls written."""
    return reports.select("key", F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("body"))


def node_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as units and brands as zones: commits are evidence, words of names symbols, and returned lines of one piece diagnostics."""
    s, text = file_stats(spark, d), lambda c: F.col(c).cast("string")
    m = s.agg(F.max("churn").alias("mc"), F.max("loc").alias("ml"))
    unit = lambda c: F.concat(F.lit("unit:"), text(c))
    parts = s.join(F.broadcast(m)).select(  # one row
        unit("file").alias("key"), F.lit("unit").alias("kind"), F.col("name").alias("label"), F.col("name").alias("path"), F.concat(F.lit("zone:"), "zone").alias("parent"),
        hotspot_score(F.col("churn"), F.col("loc"), F.col("mc"), F.col("ml")).alias("score"), "loc", "churn", "recency", F.col("language").alias("summary"),
    )
    zones = s.groupBy("zone").agg(F.sum("loc").alias("loc"), F.sum("churn").alias("churn"), F.min("recency").alias("recency"))
    zones = zones.select(F.concat(F.lit("zone:"), "zone").alias("key"), F.lit("zone").alias("kind"), F.col("zone").alias("label"), F.lit(0.0).alias("score"), "loc", "churn", "recency")
    word = F.explode(F.array_distinct(F.split("name", " "))).alias("name")
    kind = F.when(F.length("name") % 3 == 0, "Variable").otherwise("Function")
    return {
        "nodes": parts.unionByName(zones, allowMissingColumns=True),
        "evidence": touches(spark, d).select(
            unit("file").alias("key"), F.lit("git").alias("kind"), text("hash").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("locator"), F.lit(None).cast("string").alias("snippet"),
            F.col("ts").alias("at"), F.col("hash").alias("seq"),
        ),
        "symbols": s.select(unit("file").alias("key"), word).select("key", "name", kind.alias("kind")),
        "degrees": degree_centrality(spark, d).select(unit("node").alias("key"), "degree"),
        "diagnostics": table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity = 1").select(unit("l_partkey").alias("key")),
    }


_CENTS = "(floor({0} * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor({0} * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0')"
_NODES_SQL = f"""{STATS}, {EDGES}, m AS (SELECT greatest(max(churn), 1) AS mc, greatest(max(loc), 1) AS ml FROM stats),
n AS (SELECT 'unit:' || file AS key, 'unit' AS kind, name AS label, 'zone:' || zone AS parent, 0.6::DOUBLE * churn / mc + 0.4::DOUBLE * loc / ml AS score, loc, churn, recency, language AS summary FROM stats, m
  UNION ALL SELECT 'zone:' || zone, 'zone', zone, NULL, 0, sum(loc)::BIGINT, sum(churn)::BIGINT, min(recency), NULL FROM stats GROUP BY zone),
ev AS (SELECT 'unit:' || file AS key, string_agg('- git: ' || hash || ' → ' || strftime(ts, '%Y-%m-%d'), chr(10) ORDER BY pos) AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, hash DESC) AS pos FROM touches) WHERE pos <= {EVIDENCE} GROUP BY file),
sy AS (SELECT DISTINCT 'unit:' || file AS key, unnest(string_split(name, ' ')) AS name FROM stats), sk AS (SELECT key, name, CASE WHEN length(name) % 3 = 0 THEN 'Variable' ELSE 'Function' END AS kind FROM sy),
sa AS (SELECT key, string_agg('- ' || name || ' (' || kind || ')', chr(10) ORDER BY name) AS symbols, (list('- references of ' || name ORDER BY name) FILTER (WHERE kind = 'Function'))[:{LOOK_AT}] AS looked FROM sk GROUP BY key),
ch AS (SELECT parent AS key, string_agg('- ' || key || '  score: ' || {_CENTS.format("score")}, chr(10) ORDER BY pos) AS children
  FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, key) AS pos FROM n WHERE parent IS NOT NULL) WHERE pos <= {CHILDREN} GROUP BY parent),
dg AS (SELECT 'unit:' || node AS key, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node),
di AS (SELECT 'unit:' || l_partkey AS key, count(*) AS diagnostics FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1 GROUP BY 1),
j AS (SELECT n.*, evidence, symbols, looked, children, coalesce(degree, 0) AS degree, coalesce(diagnostics, 0) AS diagnostics
  FROM n LEFT JOIN ev USING (key) LEFT JOIN sa USING (key) LEFT JOIN ch USING (key) LEFT JOIN dg USING (key) LEFT JOIN di USING (key)),
r AS (SELECT *, CASE WHEN score >= 0.75 THEN 2 WHEN score >= 0.5 THEN 1 ELSE 0 END + (churn >= 5)::INT + (degree >= 5)::INT + (diagnostics > 0)::INT AS severity,
  concat_ws(chr(10), CASE WHEN score >= 0.75 THEN '- high hotspot score (' || {_CENTS.format("score")} || ')' WHEN score >= 0.5 THEN '- elevated hotspot score (' || {_CENTS.format("score")} || ')' END,
    CASE WHEN churn >= 5 THEN '- recently high churn (' || churn || ')' END, CASE WHEN degree >= 5 THEN '- connected to ' || degree || ' graph edges' END,
    CASE WHEN diagnostics > 0 THEN '- ' || diagnostics || ' diagnostics recorded' END) AS reasons FROM j)"""


@query(f"""WITH {_NODES_SQL} SELECT key, '# ' || label || '  [' || kind || ']' || chr(10) || chr(10) || '**Score:** ' || {_CENTS.format("score")} || '  **LOC:** ' || loc || '  **Churn:** ' || churn || '  **Recency:** '
|| CASE WHEN recency > 900 THEN 'unknown' ELSE recency || ' days' END || chr(10) || chr(10) || '## Risk' || chr(10) || 'Level: ' || CASE WHEN severity >= 2 THEN 'high' WHEN severity = 1 THEN 'medium' ELSE 'low' END || chr(10)
|| CASE WHEN reasons = '' THEN '- no elevated risk signals detected' ELSE reasons END || chr(10) || chr(10) || '## Inferred Summary' || chr(10) || coalesce(summary, 'No summary available') || chr(10) || chr(10)
|| CASE WHEN coalesce(evidence, symbols, children) IS NULL THEN '' ELSE '## Observed Facts' || chr(10) || chr(10) END
|| coalesce('### Evidence' || chr(10) || evidence || chr(10) || chr(10), '') || coalesce('### Symbols' || chr(10) || symbols || chr(10) || chr(10), '') || coalesce('### Children' || chr(10) || children || chr(10) || chr(10), '')
|| '## Guidance' || chr(10) || CASE WHEN looked IS NULL THEN '- no flow edges detected; look at the related nodes' ELSE '- no flow edges detected; names to trace instead:' || chr(10) || array_to_string(looked, chr(10)) END || chr(10) || chr(10) AS body FROM r""")
def node_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports of all units and zones as Markdown."""
    return markdown(reports_of(**node_tables(spark, d)))


def investigation_lines(rows: DataFrame, nodes: DataFrame, evidence: DataFrame, commands: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (investigation, section, n, line): the report of each investigation of a log, a row a line, ``n`` from 1 within a section.

    Sections are head, notes, pinned, nodes and savings. As each line is a
    row, an investigation of any size is shown whole and no list grows in a
    row. Nodes come in the order in which they were added, with their facts
    and their newest evidence; one that isn't among ``nodes`` shows its key
    only. An investigation without nodes says so. See ``investigations`` for
    the log, and ``reports_of`` for ``nodes`` and ``evidence``.
    """
    state = log.investigations_of(rows)
    lines = lambda frame, section, line, *order: frame.select("investigation", F.lit(section).alias("section"), F.array(*order).alias("at"), line.alias("line"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = lambda c: F.date_format(c, log.MICROS)
    heads = F.array(
        F.concat(F.lit("# Investigation #"), text("investigation")), F.concat(F.lit("**Question:** "), text("question")), F.concat(F.lit("**Status:** "), "status"),
        F.concat(F.lit("**Created:** "), F.date_format("created_at", "yyyy-MM-dd")),
    )
    head = lines(state.select("investigation", F.posexplode(heads).alias("i", "line")), "head", F.col("line"), text("i"))
    said = lines(log.notes_of(rows), "notes", F.col("note"), F.lpad(text("n"), 12, "0"))
    quoted = F.when(F.col("note").isNotNull(), F.concat(F.lit("  > "), "note"))
    pins = log.members_of(rows, "pin").select("*", F.posexplode(F.array_compact(F.array(F.concat(F.lit("- "), "target"), quoted))).alias("i", "line"))
    pins = lines(pins, "pinned", F.col("line"), when("added_at"), F.col("target"), text("i"))
    newest = best_of(evidence.withColumnRenamed("kind", "what"), "key", [F.desc_nulls_last("at"), F.desc("seq")], CONTEXT, "context", ("what", "source", "locator"))
    held = log.members_of(rows, "add").withColumnRenamed("target", "key").join(nodes.select("key", "kind", "label", "score", "loc", "churn", "summary"), "key", "left").join(newest, "key", "left")
    facts = F.when(F.col("kind").isNotNull(), F.concat(F.lit("  score: "), hundredths(F.coalesce("score", F.lit(0.0))), F.lit("  loc: "), text("loc"), F.lit("  churn: "), text("churn"))).otherwise("")
    shown = F.concat(
        F.array(F.concat(F.lit("### "), F.coalesce("label", "key"), F.lit("  ["), F.coalesce("kind", F.lit("unknown")), F.lit("]")), F.concat(F.lit("Key: `"), "key", F.lit("`"), facts)),
        F.array_compact(F.array(F.col("summary"), F.when(F.col("note").isNotNull(), F.concat(F.lit("> "), "note")))),
        F.coalesce(F.transform("context", lambda e: F.concat(F.lit("- "), e["what"], F.lit(": "), e["source"], F.lit(" ("), e["locator"], F.lit(")"))), F.array().cast("array<string>")),
    )
    visited = lines(held.select("*", F.posexplode(shown).alias("i", "line")), "nodes", F.col("line"), when("added_at"), F.col("key"), F.lpad(text("i"), 2, "0"))
    none = lines(state.where("nodes = 0"), "nodes", F.lit("*No nodes added yet.*"), F.lit("0"))
    spent = log.ledger_of(rows, commands, sizes).groupBy("investigation").agg(F.count(F.lit(1)).alias("commands"), F.sum("ingested").alias("ingested"), F.sum("emitted").alias("emitted"))
    saved = F.concat(
        text("commands"), F.lit(" commands: "), text("ingested"), F.lit(" tokens read, "), text("emitted"), F.lit(" said, "), F.greatest(F.lit(0), F.col("ingested") - F.col("emitted")).cast("string"), F.lit(" saved")
    )
    savings = lines(spent, "savings", saved, F.lit("0"))
    out = head
    for part in (said, pins, visited, none, savings):
        out = out.unionByName(part)
    n = F.row_number().over(Window.partitionBy("investigation", "section").orderBy("at"))
    return out.select("investigation", "section", n.cast("long").alias("n"), "line")


_NODE_LINES = f"""mem AS (SELECT inv, kind, target, last(note ORDER BY ts, seq) FILTER (WHERE note IS NOT NULL) AS note, min(ts) AS tm FROM x WHERE kind IN ('click', 'purchase') GROUP BY ALL),
ctx AS (SELECT 'unit:' || file AS target, '- git: ' || hash || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS line, row_number() OVER (PARTITION BY file ORDER BY ts DESC, hash DESC) AS pos FROM touches),
st AS (SELECT inv, max(note) FILTER (WHERE kind = 'signup') AS question, min(ts) FILTER (WHERE kind = 'signup') AS tm, count(*) FILTER (WHERE kind = 'click') AS clicks FROM x GROUP BY inv),
v AS (SELECT * FROM x WHERE kind = 'view' AND k % 5 NOT IN (0, 1)), us AS (SELECT doc_id AS id, round(length(coalesce(text, '')) / 4.0::DOUBLE)::BIGINT AS tokens FROM documents),
rd AS (SELECT seq, sum(tokens) AS n FROM (SELECT DISTINCT seq, (seq + i) % 1500 AS id FROM v, (VALUES (0), (7)) t(i) WHERE k % 5 <> 2) JOIN us USING (id) GROUP BY seq),
led AS (SELECT inv, count(*) AS c, sum(CASE WHEN k % 5 = 2 THEN (SELECT sum(tokens) FROM us) ELSE coalesce(n, 0) END)::BIGINT AS i, sum(round(floor(value * 100) / 4.0::DOUBLE))::BIGINT AS e FROM v LEFT JOIN rd USING (seq) GROUP BY inv),
nd AS (SELECT mem.*, n.kind AS nk, label, score, loc, churn, summary FROM mem LEFT JOIN n ON n.key = target WHERE mem.kind = 'click'),
ls AS (SELECT inv, 'head' AS section, 0::BIGINT AS seq, TIMESTAMP '2000-01-01' AS tm, '' AS target, 0 AS i, '# Investigation #' || inv AS line FROM st UNION ALL SELECT inv, 'head', 0, TIMESTAMP '2000-01-01', '', 1, '**Question:** ' || coalesce(question, '') FROM st
UNION ALL SELECT inv, 'head', 0, TIMESTAMP '2000-01-01', '', 2, '**Status:** open' FROM st UNION ALL SELECT inv, 'head', 0, TIMESTAMP '2000-01-01', '', 3, '**Created:** ' || strftime(tm, '%Y-%m-%d') FROM st
UNION ALL SELECT inv, 'notes', seq, ts, '', 0, note FROM x WHERE kind = 'error'
UNION ALL SELECT inv, 'pinned', 0, tm, target, 0, '- ' || target FROM mem WHERE kind = 'purchase' UNION ALL SELECT inv, 'pinned', 0, tm, target, 1, '  > ' || note FROM mem WHERE kind = 'purchase' AND note IS NOT NULL
UNION ALL SELECT inv, 'nodes', 0, tm, target, 0, '### ' || coalesce(label, target) || '  [' || coalesce(nk, 'unknown') || ']' FROM nd
UNION ALL SELECT inv, 'nodes', 0, tm, target, 1, 'Key: `' || target || '`' || coalesce('  score: ' || {_CENTS.format("score")} || '  loc: ' || loc || '  churn: ' || churn, '') FROM nd
UNION ALL SELECT inv, 'nodes', 0, tm, target, 2, summary FROM nd WHERE summary IS NOT NULL UNION ALL SELECT inv, 'nodes', 0, tm, target, 3, '> ' || note FROM nd WHERE note IS NOT NULL
UNION ALL SELECT inv, 'nodes', 0, tm, target, 3 + pos, line FROM nd JOIN ctx USING (target) WHERE pos <= {CONTEXT}
UNION ALL SELECT inv, 'nodes', 0, TIMESTAMP '2000-01-01', '', 0, '*No nodes added yet.*' FROM st WHERE clicks = 0
UNION ALL SELECT inv, 'savings', 0, TIMESTAMP '2000-01-01', '', 0, c || ' commands: ' || i || ' tokens read, ' || e || ' said, ' || greatest(0, i - e) || ' saved' FROM led)"""


@query(f"""WITH {_NODES_SQL}, {log._LOG_SQL}, {_NODE_LINES}
SELECT inv AS investigation, section, row_number() OVER (PARTITION BY inv, section ORDER BY tm, seq, target, i) AS n, line FROM ls""")
def investigation_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports of all investigations, a row a line."""
    rows, commands = log.log_of_events(spark, d)
    t = node_tables(spark, d)
    sizes = units(spark, d).select(F.concat(F.lit("unit:"), F.col("id").cast("string")).alias("key"), "tokens")
    return investigation_lines(rows, t["nodes"], t["evidence"], commands, sizes)
