"""Flows of repositories: routes, queue workers, event buses and commands, by evidence that is gathered in one pass.

A flow stands on strong evidence: a dependency, a call, a file convention, a
declared binary, or a pattern that the user gives. Each kind counts once,
however often it occurs, and their number sets the confidence. Weak evidence,
such as symbols with telling names, adds nodes to a flow that stands, and
never makes one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import confidence_from_strong, is_test_path
from quarry.plans.registry import Registry
from quarry.plans.shared import stored
from quarry.plans.views import table
from quarry.sources.registry import section

REGISTRY = Registry()
query = REGISTRY.query

# The most nodes and pieces of evidence of a flow, flows of a repository, and characters of a piece.
MOST_NODES, MOST_EVIDENCE, MOST_FLOWS, SNIPPET = 10, 10, 20, 120


@dataclass(frozen=True)
class Detector:
    """What one flow is known by. ``calls`` are searched in lines, ``files`` in paths, both whatever the case."""

    label: str
    kind: str
    calls: str
    library: str = ""
    packages: tuple[str, ...] = ()
    files: str | None = None
    file_word: str = "file"
    binary: bool = False
    once: bool = False  # a file's first call only
    entries: tuple[str, ...] = ()  # weak
    names: tuple[str, ...] = ()  # weak


# Packages, calls, file conventions and names of each flow.
DETECTORS = (
    Detector(
        "http-routes", "request", r"(router|app|fastify|server)\.(get|post|put|delete|patch)\(", "web framework",
        ("express", "fastify", "hono", "koa", "@hapi/hapi", "@nestjs/core", "next", "@sveltejs/kit", "@remix-run/node", "restify", "polka"),
        r"/(route\.ts|routes\.ts|route\.tsx|page\.tsx|routes\.js)$", names=("route", "handler", "controller", "endpoint"),
    ),
    Detector(
        "queue-workers", "worker", r"new\s+(Worker|Queue|Consumer|Producer)\(", "queue/job library",
        ("bullmq", "bull", "bee-queue", "amqplib", "amqp-connection-manager", "kafkajs", "agenda", "kue", "rsmq", "@aws-sdk/client-sqs", "sqs-consumer"),
        r"(\.worker\.ts|/worker\.ts|/worker\.js)$",
    ),
    Detector("event-bus", "event", r"(new\s+EventEmitter|extends\s+EventEmitter)", "event library", ("eventemitter3", "eventemitter2", "mitt", "nanoevents", "rxjs")),
    Detector(
        "cli-commands", "command", r"process\.argv|parseArgs|commander|yargs", files=r"^src/commands/", file_word="command file", binary=True, once=True,
        entries=("src/index.ts", "src/cli.ts", "src/main.ts", "index.ts"),
    ),
)
SYMBOL_KINDS = ("Class", "Interface", "Function", "Method")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: The kinds of evidence in their order; the strong ones.
RANKS = ("dependency", "call", "binary", "file", "entry", "pattern", "symbol")
STRONG = ("dependency", "call", "binary", "file", "pattern")


@dataclass(frozen=True)
class UserSignals:
    """More packages and patterns by a flow's label. They widen what is found, and count as one kind each."""

    packages: dict[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)


def signals_of(config: str) -> UserSignals:
    """The signals in the section `flows` of a configuration: lists of dependencies and patterns by the first words of the labels."""
    given = section(config, "flows")
    names = {"route": "http-routes", "queue": "queue-workers", "event": "event-bus", "cli": "cli-commands"}
    take = lambda what: {label: tuple(given[f"{n}_{what}"]) for n, label in names.items() if given.get(f"{n}_{what}")}
    return UserSignals(take("deps"), take("patterns"))


def no_example(path: Column) -> Column:
    """Not a test, specification or fixture, whose code is no application's."""
    return ~(is_test_path(path) | path.rlike(r"(^|/)fixtures/"))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _piece(label: str, rank: str, item: Column, key: Column, path: Column, at: int = 0, line: Column | None = None) -> Column:
    return F.struct(
        F.lit(label).alias("label"), F.lit(RANKS.index(rank)).alias("rank"), F.lit(at).alias("nth"), path.alias("path"),
        (F.lit(0) if line is None else line).cast("int").alias("line"), item.alias("item"), key.alias("key"),
    )


def evidence(units: DataFrame, symbols: DataFrame | None = None, user: UserSignals | None = None, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Rows (repo, label, rank, nth, path, line, item, key): all evidence, strong and weak.

    ``units`` are (repo, key, path, text), ``symbols`` (repo, key, path, name,
    kind). Texts are read once for all patterns: one expression of all of
    them leaves out whole texts and then lines, and only lines that match
    are asked for each. Manifests (package.json of the root) that don't
    parse have no packages. Null texts and paths have no evidence.
    """
    user = user or UserSignals()
    key, path, line = F.col("key"), F.col("path"), F.col("line")
    patterns = [(d.label, "call", 0, d.calls) for d in detectors]
    patterns += [(d.label, "pattern", i, p) for d in detectors for i, p in enumerate(user.patterns.get(d.label, ()))]
    any_of = "|".join(f"(?:{p})" for *_, p in patterns)
    text = units.where(no_example(path) & F.col("text").rlike(f"(?im){any_of}"))
    lines = text.select("repo", "key", "path", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(line.rlike(f"(?i){any_of}"))

    def hit(label: str, rank: str, at: int, pattern: str) -> Column:
        lead = F.lit("config-pattern: " if rank == "pattern" else "")
        item = F.left(F.concat(lead, path, F.lit(": "), trimmed(line)), F.lit(SNIPPET))
        return F.when(line.rlike(f"(?i){pattern}"), _piece(label, rank, item, key, path, at, F.col("no")))

    hits = lines.select("repo", F.explode(F.array_compact(F.array(*(hit(*p) for p in patterns)))).alias("e")).select("repo", "e.*")
    once = F.col("label").isin(*(d.label for d in detectors if d.once)) & (F.col("rank") == RANKS.index("call"))
    first = hits.where(once).groupBy("repo", "label", "rank", "nth", "path", "key").agg(F.min_by("item", "line").alias("item"), F.min("line").alias("line"))
    found = hits.where(~once).unionByName(first)

    by_path = [F.when(no_example(path) & path.rlike(f"(?i){d.files}"), _piece(d.label, "file", F.concat(F.lit(f"{d.file_word}: "), path), key, path)) for d in detectors if d.files]
    by_path += [F.when(path.isin(*d.entries), _piece(d.label, "entry", F.concat(F.lit("file: "), path), key, path)) for d in detectors if d.entries]
    found = found.unionByName(units.select("repo", F.explode(F.array_compact(F.array(*by_path))).alias("e")).select("repo", "e.*"))

    parsed = F.from_json("text", ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    manifest = units.where("path = 'package.json'").select("repo", parsed.alias("j"), F.get_json_object("text", "$.bin").alias("bin"))
    names = F.flatten(F.array(*(F.coalesce(F.map_keys(f"j.{s}"), F.array().cast("array<string>")) for s in SECTIONS)))
    manifest = manifest.select("repo", "bin", F.transform(names, F.lower).alias("names"))
    declared, none, root = [], F.lit(None).cast("string"), F.lit("package.json")
    for d in detectors:
        known = [p.lower() for p in (*d.packages, *user.packages.get(d.label, ()))]
        if known:
            held = F.filter(F.array(*map(F.lit, known)), lambda p: F.array_contains("names", p))
            item = F.concat(F.lit(f"dependency: {d.library} ("), F.get(held, 0), F.lit(")"))
            declared.append(F.when(F.size(held) > 0, _piece(d.label, "dependency", item, none, root)))
        if d.binary:
            declared.append(F.when(F.col("bin").isNotNull(), _piece(d.label, "binary", F.lit("package.json: bin entry"), none, root)))
    found = found.unionByName(manifest.select("repo", F.explode(F.array_compact(F.array(*declared))).alias("e")).select("repo", "e.*"))

    if symbols is not None:
        item = F.concat(F.lit("symbol: "), "name", F.lit(" ("), "kind", F.lit(") in "), path)
        telling = [F.when(F.lower("name").rlike("|".join(d.names)), _piece(d.label, "symbol", item, key, path)) for d in detectors if d.names]
        some = symbols.where(no_example(path) & F.col("kind").isin(*SYMBOL_KINDS))
        found = found.unionByName(some.select("repo", F.explode(F.array_compact(F.array(*telling))).alias("e")).select("repo", "e.*"))
    return found


def flows_of(found: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Rows (repo, key, label, kind, confidence, nodes, evidence) of ``evidence``; none without a strong kind.

    A flow's kinds are a partial "or" of bits. Its first ten pieces and its
    first ten nodes, each at its first piece, are ranked with a limit that
    Spark applies before the shuffle, so no list of a row is longer, and no
    flow's evidence meets in one task.
    """
    found = stored(found, "evidence")
    strong = sum(1 << RANKS.index(r) for r in STRONG)
    counted = found.groupBy("repo", "label").agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rank"))).bitwiseAND(strong)).alias("strong")).where("strong > 0")
    order = ["rank", "nth", "path", "line", "item"]

    def firsts(rows: DataFrame, most: int, col: str) -> DataFrame:
        top = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo", "label").orderBy(*order))).where(F.col("n") <= most)
        return top.groupBy("repo", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", col))), lambda s: s[col]).alias(f"{col}s"))

    at_first = F.min(F.struct(*order)).alias("o")
    nodes = firsts(found.where("key is not null").groupBy("repo", "label", "key").agg(at_first).select("repo", "label", "key", "o.*"), MOST_NODES, "key")
    pieces = firsts(found, MOST_EVIDENCE, "item")
    kind = F.create_map(*(F.lit(x) for d in detectors for x in (d.label, d.kind)))[F.col("label")]
    return counted.join(pieces, ["repo", "label"]).join(nodes, ["repo", "label"], "left").select(
        "repo", F.concat(F.lit("flow:"), "label").alias("key"), "label", kind.alias("kind"), confidence_from_strong(F.col("strong")).alias("confidence"),
        F.coalesce("keys", F.array().cast("array<string>")).alias("nodes"), F.col("items").alias("evidence"),
    )


def detect_flows(units: DataFrame, symbols: DataFrame | None = None, user: UserSignals | None = None, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """The flows of all repositories, each label once with its highest confidence, twenty of a repository at most in the order of the detectors."""
    flows = flows_of(evidence(units, symbols, user, detectors), detectors)
    best = flows.groupBy("repo", "label").agg(F.max_by(F.struct("key", "kind", "confidence", "nodes", "evidence"), "confidence").alias("f")).select("repo", "label", "f.*")
    place = F.array_position(F.array(*(F.lit(d.label) for d in detectors)), F.col("label"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy(place, "label"))
    return best.withColumn("n", n).where(F.col("n") <= MOST_FLOWS).select("repo", "key", "label", "kind", "confidence", "nodes", "evidence")


def within_scope(flows: DataFrame, ref: str) -> DataFrame:
    """Flows with a node in a scope (repo:., zone:name, unit:path), with the nodes in it, and its evidence, or all where none is of it."""
    if ref == "repo:.":
        return flows
    kind, _, name = ref.partition(":")
    inside = (lambda k: F.startswith(k, F.lit(f"unit:{name}/"))) if kind == "zone" else (lambda k: k == F.lit(ref))
    said = f"{name}/" if kind == "zone" else name if kind == "unit" else ref
    nodes, own = F.filter("nodes", inside), F.filter("evidence", lambda e: F.contains(e, F.lit(said)))
    return flows.withColumns({"nodes": nodes, "evidence": F.when(F.size(own) > 0, own).otherwise(F.col("evidence"))}).where(F.size("nodes") > 0)


#: What the test tables' texts and manifests hold in place of a project's own signals.
SIGNALS = UserSignals(
    {"http-routes": ("France", "KENYA"), "queue-workers": ("japan",), "event-bus": ("peru", "china")},
    {"http-routes": (r"token = ", r"[a-z]+@[a-z]+\.[a-z]+"), "queue-workers": (r"released under",), "event-bus": (r"###\s",), "cli-commands": (r"with by the",)},
)


def repositories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units and symbols of a repository for each source of documents.

    Documents are its files, by paths that follow conventions; the nations of
    suppliers are the packages of its manifest; parts are its symbols.
    """
    i = F.col("doc_id")
    path = (
        F.when(i < 20, "src/cli.ts").when(i % 40 == 21, F.concat(F.lit("app/"), i.cast("string"), F.lit("/route.ts")))
        .when(i % 40 == 2, F.concat(F.lit("tests/"), i.cast("string"), F.lit("/route.ts"))).when(i % 40 == 23, F.concat(F.lit("jobs/"), i.cast("string"), F.lit(".worker.ts")))
        .when(i % 40 == 4, F.concat(F.lit("src/commands/"), i.cast("string"), F.lit(".ts"))).otherwise(F.concat(F.lit("src/"), i.cast("string"), F.lit("."), F.col("lang")))
    )
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), path.alias("path"), "text")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.upper("n_name").alias("name"))
    owned = table(spark, d, "supplier").join(nation, "s_nationkey").select(F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("repo"), "name", "s_acctbal")
    packages = F.map_from_entries(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.struct(n, F.lit("1.0.0"))))
    manifest = owned.groupBy("repo").agg(F.to_json(F.struct(packages.alias("dependencies"), F.when(F.min("s_acctbal") < -500, "cli.js").alias("bin"))).alias("text"))
    units = files.unionByName(manifest.withColumn("path", F.lit("package.json"))).withColumn("key", F.concat(F.lit("unit:"), "path"))
    p = F.col("p_partkey")
    symbols = table(spark, d, "part").select(
        F.concat(F.lit("src"), (p % 20).cast("string")).alias("repo"), F.concat(F.lit("src/parts/"), p.cast("string"), F.lit(".ts")).alias("path"),
        F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " Handler").otherwise("")).alias("name"), F.when(F.col("p_size") % 2 == 0, "Function").otherwise("Variable").alias("kind"),
    )
    return units, symbols.withColumn("key", F.concat(F.lit("unit:"), "path"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _flow_sql() -> str:
    parts, strong = [], ", ".join(str(RANKS.index(r)) for r in STRONG)
    good = "NOT regexp_matches(path, '(\\.test\\.|\\.spec\\.)|(^|/)(test|tests|__tests__|fixtures)/')"
    piece = lambda label, rank, at, item, key, src, line="0": f"SELECT repo, {_q(label)} AS label, {RANKS.index(rank)} AS rank, {at} AS nth, path, {line} AS line, {item} AS item, {key} AS key FROM {src}"
    for d in DETECTORS:
        calls = f"lines WHERE regexp_matches(line, {_q(d.calls)}, 'i')" + (" QUALIFY row_number() OVER (PARTITION BY repo, path, key ORDER BY no) = 1" if d.once else "")
        parts.append(piece(d.label, "call", 0, f"left(path || ': ' || trimmed, {SNIPPET})", "key", calls, "no"))
        for i, p in enumerate(SIGNALS.patterns.get(d.label, ())):
            parts.append(piece(d.label, "pattern", i, f"left('config-pattern: ' || path || ': ' || trimmed, {SNIPPET})", "key", f"lines WHERE regexp_matches(line, {_q(p)}, 'i')", "no"))
        if d.files:
            parts.append(piece(d.label, "file", 0, f"'{d.file_word}: ' || path", "key", f"u WHERE {good} AND regexp_matches(path, {_q(d.files)}, 'i')"))
        if d.entries:
            parts.append(piece(d.label, "entry", 0, "'file: ' || path", "key", f"u WHERE path IN {d.entries}"))
        known = [p.lower() for p in (*d.packages, *SIGNALS.packages.get(d.label, ()))]
        if known:
            first = f"list_filter({known}, lambda x: list_contains(names, x))[1]"
            parts.append(piece(d.label, "dependency", 0, f"'dependency: {d.library} (' || {first} || ')'", "NULL", f"pkg WHERE {first} IS NOT NULL"))
        if d.binary:
            parts.append(piece(d.label, "binary", 0, "'package.json: bin entry'", "NULL", "pkg WHERE bin"))
        if d.names:
            parts.append(piece(d.label, "symbol", 0, "'symbol: ' || name || ' (' || kind || ') in ' || path", "'unit:' || path", f"s WHERE kind IN {SYMBOL_KINDS} AND regexp_matches(lower(name), '{'|'.join(d.names)}')"))
    kinds = "CASE label " + " ".join(f"WHEN '{d.label}' THEN '{d.kind}'" for d in DETECTORS) + " END"
    return f"""u AS (SELECT *, 'unit:' || path AS key FROM (SELECT source AS repo, text, CASE WHEN doc_id < 20 THEN 'src/cli.ts' WHEN doc_id % 40 = 21 THEN 'app/' || doc_id || '/route.ts'
  WHEN doc_id % 40 = 2 THEN 'tests/' || doc_id || '/route.ts' WHEN doc_id % 40 = 23 THEN 'jobs/' || doc_id || '.worker.ts' WHEN doc_id % 40 = 4 THEN 'src/commands/' || doc_id || '.ts' ELSE 'src/' || doc_id || '.' || lang END AS path FROM documents)),
raw AS (SELECT repo, path, key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM u WHERE {good}),
lines AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS trimmed FROM raw),
pkg AS (SELECT 'src' || (s_suppkey % 20) AS repo, 'package.json' AS path, list(DISTINCT lower(n_name)) AS names, min(s_acctbal) < -500 AS bin FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
s AS (SELECT 'src' || (p_partkey % 20) AS repo, 'src/parts/' || p_partkey || '.ts' AS path, p_name || CASE WHEN p_size % 7 = 0 THEN ' Handler' ELSE '' END AS name, CASE WHEN p_size % 2 = 0 THEN 'Function' ELSE 'Variable' END AS kind FROM part),
e AS ({" UNION ALL ".join(parts)}),
strong AS (SELECT repo, label, count(DISTINCT rank) AS n FROM e WHERE rank IN ({strong}) GROUP BY ALL),
pieces AS (SELECT repo, label, list(item ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, label ORDER BY rank, nth, path, line, item) AS k FROM e) WHERE k <= {MOST_EVIDENCE} GROUP BY ALL),
firsts AS (SELECT repo, label, key, min(row(rank, nth, path, line, item)) AS o FROM e WHERE key IS NOT NULL GROUP BY ALL),
nodes AS (SELECT repo, label, list(key ORDER BY k) AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY repo, label ORDER BY o) AS k FROM firsts) WHERE k <= {MOST_NODES} GROUP BY ALL),
flows AS (SELECT repo, 'flow:' || label AS key, {kinds} AS kind, CASE n WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence, coalesce(nodes, []) AS nodes, evidence
  FROM strong JOIN pieces USING (repo, label) LEFT JOIN nodes USING (repo, label))"""


_LISTS = "array_to_string(nodes, ';') AS nodes, array_to_string(evidence, ';') AS evidence"


@query(f"WITH {_flow_sql()} SELECT repo, key, kind, confidence, {_LISTS} FROM flows")
def flows(spark: SparkSession, d: str) -> DataFrame:
    """The flows of all repositories."""
    found = detect_flows(*repositories(spark, d), SIGNALS)
    return found.select("repo", "key", "kind", "confidence", F.array_join("nodes", ";").alias("nodes"), F.array_join("evidence", ";").alias("evidence"))


@query(f"""WITH {_flow_sql()}, i AS (SELECT repo, key, list_filter(nodes, lambda x: starts_with(x, 'unit:jobs/')) AS nodes, list_filter(evidence, lambda x: contains(x, 'jobs/')) AS own, evidence AS every FROM flows)
SELECT repo, key, {_LISTS.replace("evidence,", "CASE WHEN len(own) > 0 THEN own ELSE every END,", 1)} FROM i WHERE len(nodes) > 0""")
def flows_of_zone(spark: SparkSession, d: str, zone: str = "jobs") -> DataFrame:
    """What of the flows lies in a zone."""
    found = within_scope(detect_flows(*repositories(spark, d), SIGNALS), f"zone:{zone}")
    return found.select("repo", "key", F.array_join("nodes", ";").alias("nodes"), F.array_join("evidence", ";").alias("evidence"))
