"""Doctor: the state of tools, runs, analyzers and enrichers as checks in rows, with what to do about them."""

from __future__ import annotations

import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lifecycle import _REG_SQL, REGISTRY_TEXT, RUNS, _paths, analyzer_runs
from quarry.plans.registry import Registry
from quarry.plans.views import table
from quarry.sources.registry import detect_languages, eligible, load_registry

REGISTRY = Registry()
query = REGISTRY.query

# Files from which on a repository is large, capabilities asked for rather than swept, and what each kind of navigation rests on.
LARGE, ON_DEMAND = 50_000, ("refs",)
SEMANTIC = {"symbolNavigation": ("symbols", "defs"), "semanticRefs": ("refs",), "diagnostics": ("diagnostics",)}
SCOPES = {"repo": ("git", "rg", "database", "embedder"), "perf": ("repo-size", "database")}
NO_INDEX, UNVERIFIED, DEGRADED = "no readable index: run one", "semantic capabilities are available but unverified: run the analyzers", "semantic capabilities are degraded: definitions and references may be limited to indexed symbols"
ROW = ("part", "name", "status", "message", "remedy")


def tools_here(spark: SparkSession, wanted: dict[str, tuple[bool, str]]) -> DataFrame:
    """Rows (tool, required, found, remedy) of the commands that this machine has; ``wanted`` is {tool: (required, remedy)}."""
    return spark.createDataFrame([(t, need, shutil.which(t) is not None, remedy) for t, (need, remedy) in wanted.items()], "tool string, required boolean, found boolean, remedy string")


def coverage_of(runs: DataFrame, run_id: Column | None = None) -> DataFrame:
    """Rows (capability, mode, succeeded, success, attempted) of analyzer runs (capability, status)."""
    return runs.groupBy("capability").agg(F.count_if(F.col("status") == "success").alias("success"), F.count(F.lit(1)).alias("attempted")).select(
        "capability", F.when(F.col("capability").isin(*ON_DEMAND), "on-demand").otherwise("sweep").alias("mode"), (F.col("success") > 0).alias("succeeded"), "success", "attempted"
    )


def doctor_of(
    tools: DataFrame, runs: DataFrame, files: DataFrame, analyzers: DataFrame, analyzer_runs: DataFrame, enrichers: DataFrame, registry_error: str | None = None, scope: str | None = None
) -> DataFrame:
    """Rows (part, name, status, message, remedy); part is check, coverage, fidelity, enricher or recommendation.

    ``tools`` (tool, required, found, remedy); ``runs`` (run_id, completed);
    ``files`` (run_id, path); ``analyzers`` (language, analyzer, tool,
    available, capabilities), a null analyzer where a language has none that
    is eligible; ``analyzer_runs`` (run_id, capability, status); ``enrichers``
    (run_id, enricher, available, n), what a run has of each.

    Checks: a tool that isn't found fails if it is required, else warns; so
    does `git`, which changes rest on. `database` warns without a completed
    run, and the newest completed one is what the rest looks at; `repo-size`
    warns above 50,000 files; each analyzer warns if its tool isn't there.
    Fidelity: pass if a capability was exercised with success, fail if
    without; never exercised, it is warn where an available analyzer has it,
    else fail. Recommendations are what checks and fidelity ask for. With a
    ``scope``, `repo`, `perf` or `semantic`, only its checks are listed; the
    recommendations rest on all.

    Every table is reduced to counts first, so that what is joined without a
    key is one row. Null names, tools and capabilities are left out, and null
    flags are false. With all tables empty there are checks of the database,
    its size and the registry, and the fidelity of nothing.
    """
    one = runs.where("completed").agg(F.max("run_id").alias("last"), F.count(F.lit(1)).alias("completed"))
    of_last = lambda frame: frame.join(F.broadcast(one.select("last")), F.col("run_id") == F.col("last"), "left_semi")
    n = of_last(files).agg(F.count_distinct("path").alias("files"))
    able = analyzers.where("available").agg(F.array_distinct(F.flatten(F.collect_set("capabilities"))).alias("able"))
    run = coverage_of(of_last(analyzer_runs).where("capability is not null"))
    ran = run.agg(F.collect_set("capability").alias("ran"), F.collect_set(F.when(F.col("succeeded"), F.col("capability"))).alias("won"))
    found = tools.agg(*(F.coalesce(F.bool_or(F.col("found") & (F.col("tool") == t)), F.lit(False)).alias(t) for t in ("git", "rg")))
    facts = one.join(F.broadcast(n)).join(F.broadcast(able)).join(F.broadcast(ran)).join(F.broadcast(found))  # one row each

    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    row = lambda part, name, status, message, remedy=None: F.struct(*(text(v).alias(c) for c, v in zip(ROW, (part, name, status, message, remedy), strict=True)))
    count = F.concat(F.col("files").cast("string"), F.lit(" files indexed"))
    index = F.col("last").isNotNull()
    large = index & (F.col("files") > LARGE)
    state = {}
    for name, needs in SEMANTIC.items():
        hits = lambda c, needs=needs: F.arrays_overlap(c, F.array(*map(F.lit, needs)))
        state[name] = F.when(hits("ran"), F.when(hits("won"), "pass").otherwise("fail")).when(hits("able"), "warn").otherwise("fail")
    yes = lambda c: F.when(c, "pass").otherwise("fail")
    state |= {"structural": yes(index), "hotspot": yes(F.col("git")), "flowHeuristics": yes(F.col("rg") & index)}
    fixed = [
        row("check", "database", F.when(index, "pass").otherwise("warn"), F.when(index, F.concat(F.lit("run "), F.col("last").cast("string"), F.lit(", "), count)).otherwise("no completed run yet")),
        row("check", "analyzer-registry", "pass" if registry_error is None else "warn", "usable" if registry_error is None else f"unusable, the built-in one answers ({registry_error})", None if registry_error is None else "mend the registry's file"),
        row("check", "repo-size", F.when(large, "warn").otherwise("pass"), F.when(~index, "skipped").when(large, F.concat(count, F.lit(": large, analysis may be slow"))).otherwise(count), F.when(large, "ignore caches and generated folders")),
        *(row("fidelity", k, v, None) for k, v in state.items()),
    ]
    semantic = F.array(*(state[k] for k in SEMANTIC))
    asked = [
        F.when(~index, row("recommendation", "structural", "fail", NO_INDEX)),
        F.when(F.array_contains(semantic, "warn"), row("recommendation", "semantic", "warn", UNVERIFIED)).when(F.array_contains(semantic, "fail"), row("recommendation", "semantic", "fail", DEGRADED)),
    ]
    flat = lambda frame, *structs: frame.select(F.explode(F.array_compact(F.array(*structs))).alias("r")).select("r.*")
    base = flat(facts, *fixed, *asked)
    missing = ~F.coalesce("found", F.lit(False))
    own = flat(tools.where("tool is not null"), row("check", F.col("tool"), F.when(~missing, "pass").when(F.coalesce("required", F.lit(False)), "fail").otherwise("warn"), F.when(missing, "not found").otherwise("found"), F.when(missing, F.col("remedy"))))
    there = F.coalesce("available", F.lit(False))
    by_language = flat(
        analyzers.where("language is not null"),
        F.when(F.col("analyzer").isNull(), row("check", F.concat("language", F.lit(":registry")), "warn", "no eligible analyzers"))
        .otherwise(row("check", F.concat_ws(":", "language", "analyzer"), F.when(there, "pass").otherwise("warn"), F.concat(F.coalesce("tool", "analyzer"), F.when(there, " available").otherwise(" not found")))),
    )
    covered = flat(run, row("coverage", F.col("capability"), F.when(F.col("succeeded"), "pass").otherwise("fail"), F.concat("mode", F.lit(": "), F.col("success").cast("string"), F.lit(" of "), F.col("attempted").cast("string"))))
    # Availability is of the enricher, counts are of the last completed run.
    seen = enrichers.where("enricher is not null").join(F.broadcast(one.select("last"))).groupBy("enricher").agg(
        F.coalesce(F.bool_or("available"), F.lit(False)).alias("available"), F.coalesce(F.sum(F.when(F.col("run_id") == F.col("last"), F.col("n"))), F.lit(0)).alias("n"), F.max("last").alias("last")
    )
    seen = flat(seen, row("enricher", F.col("enricher"), F.when(~F.col("available"), "fail").when(F.col("n") > 0, "pass").otherwise("warn"),
        F.when(F.col("last").isNull(), F.when(F.col("available"), "no completed run yet").otherwise("unavailable")).otherwise(F.concat(F.lit("rows: "), F.col("n").cast("string")))))
    checks = base.where("part = 'check'").unionByName(own).unionByName(by_language)
    remedies = checks.where("status <> 'pass' and remedy is not null").select(F.lit("recommendation").alias("part"), "name", "status", F.concat_ws(": ", "name", "remedy").alias("message"), F.lit(None).cast("string").alias("remedy"))
    if scope == "semantic":
        checks = checks.where(F.contains("name", F.lit(":")) | (F.col("name") == "analyzer-registry"))
    elif scope is not None:
        checks = checks.where(F.col("name").isin(*SCOPES[scope]))
    out = checks
    for part in (base.where("part <> 'check'"), remedies, covered, seen):
        out = out.unionByName(part)
    return out


def doctor_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Days of events as runs, completed where a purchase was made; kinds of events as tools, documents as the last run's files."""
    r = analyzer_runs(spark, d)
    runs = r.groupBy("run_id").agg(F.bool_or(F.col("capability") == "purchase").alias("completed"))
    last = runs.where("completed").agg(F.max("run_id").alias("run_id"))
    ever = r.groupBy(F.col("capability").alias("tool")).agg(F.bool_or(F.col("status") == "success").alias("found"))
    wanted = spark.createDataFrame([("git", "view", True, "install git"), ("rg", "click", False, "install it"), ("embedder", "absent", False, "start one")], "name string, tool string, required boolean, remedy string")
    tools = wanted.join(ever, "tool", "left").select(F.col("name").alias("tool"), "required", F.coalesce("found", F.lit(False)).alias("found"), "remedy")
    rows = load_registry(REGISTRY_TEXT).frame(spark)
    here = detect_languages(rows, _paths(spark, d), {}).select("language")
    mine = here.join(eligible(rows, _paths(spark, d)), "language", "left").select("language", "analyzer", F.col("analyzer").alias("tool"), "capabilities")
    mine = mine.join(ever, "tool", "left").select("language", "analyzer", "tool", F.coalesce("found", F.lit(False)).alias("available"), "capabilities")
    doing = F.when(F.col("capability") == "view", "symbols").when(F.col("capability") == "error", "refs").otherwise(F.col("capability"))
    enrichers = r.groupBy("run_id").agg(F.count_if(F.col("capability") == "click").alias("git"), F.count_if(F.col("value") > 1e9).alias("markdown")).unpivot("run_id", ["git", "markdown"], "enricher", "n")
    return {
        "tools": tools, "runs": runs, "files": _paths(spark, d).join(F.broadcast(last)), "analyzers": mine,
        "analyzer_runs": r.select("run_id", doing.alias("capability"), "status"), "enrichers": enrichers.withColumn("available", F.lit(True)),
    }


def _state_sql(needs: tuple[str, ...]) -> str:
    some = "(" + ", ".join(f"'{x}'" for x in needs) + ")"
    return f"""CASE WHEN EXISTS (SELECT 1 FROM cov WHERE capability IN {some}) THEN CASE WHEN EXISTS (SELECT 1 FROM cov WHERE capability IN {some} AND ok > 0) THEN 'pass' ELSE 'fail' END
WHEN EXISTS (SELECT 1 FROM (SELECT unnest(able) AS c FROM mine WHERE available) WHERE c IN {some}) THEN 'warn' ELSE 'fail' END"""


@query(f"""WITH {RUNS}, {_REG_SQL}, last AS (SELECT max(run_id) AS last FROM runs WHERE capability = 'purchase'), ever AS (SELECT capability AS tool, bool_or(status = 'success') AS found FROM runs GROUP BY 1),
tl AS (SELECT name, required, coalesce(found, false) AS found, remedy FROM (VALUES ('git', 'view', true, 'install git'), ('rg', 'click', false, 'install it'), ('embedder', 'absent', false, 'start one')) w(name, tool, required, remedy) LEFT JOIN ever USING (tool)),
there AS (SELECT DISTINCT '.' || lang AS ending FROM documents), mine AS (SELECT h.language, analyzer, able, coalesce(found, false) AS available FROM (SELECT DISTINCT language FROM reg WHERE ending IN (SELECT ending FROM there)) h LEFT JOIN ok USING (language) LEFT JOIN ever ON tool = analyzer),
cov AS (SELECT CASE capability WHEN 'view' THEN 'symbols' WHEN 'error' THEN 'refs' ELSE capability END AS capability, count(*) AS n, count(*) FILTER (WHERE status = 'success') AS ok FROM runs, last WHERE run_id = last GROUP BY 1),
f AS (SELECT CASE WHEN last IS NULL THEN 0 ELSE (SELECT count(DISTINCT path) FROM paths) END AS files, last FROM last),
fid AS (SELECT 'structural' AS name, CASE WHEN last IS NULL THEN 'fail' ELSE 'pass' END AS status FROM f UNION ALL SELECT 'hotspot', CASE WHEN found THEN 'pass' ELSE 'fail' END FROM tl WHERE name = 'git'
  UNION ALL SELECT 'flowHeuristics', CASE WHEN found AND (SELECT last FROM f) IS NOT NULL THEN 'pass' ELSE 'fail' END FROM tl WHERE name = 'rg' {"".join(f" UNION ALL SELECT '{k}', {_state_sql(v)}" for k, v in SEMANTIC.items())}),
ck AS (SELECT 'database' AS name, CASE WHEN last IS NULL THEN 'warn' ELSE 'pass' END AS status, CASE WHEN last IS NULL THEN 'no completed run yet' ELSE 'run ' || last || ', ' || files || ' files indexed' END AS message, NULL::VARCHAR AS remedy FROM f
  UNION ALL SELECT 'analyzer-registry', 'pass', 'usable', NULL
  UNION ALL SELECT 'repo-size', CASE WHEN files > {LARGE} THEN 'warn' ELSE 'pass' END, CASE WHEN last IS NULL THEN 'skipped' WHEN files > {LARGE} THEN files || ' files indexed: large, analysis may be slow' ELSE files || ' files indexed' END,
    CASE WHEN files > {LARGE} THEN 'ignore caches and generated folders' END FROM f
  UNION ALL SELECT name, CASE WHEN found THEN 'pass' WHEN required THEN 'fail' ELSE 'warn' END, CASE WHEN found THEN 'found' ELSE 'not found' END, CASE WHEN NOT found THEN remedy END FROM tl
  UNION ALL SELECT CASE WHEN analyzer IS NULL THEN language || ':registry' ELSE language || ':' || analyzer END, CASE WHEN analyzer IS NOT NULL AND available THEN 'pass' ELSE 'warn' END,
    CASE WHEN analyzer IS NULL THEN 'no eligible analyzers' WHEN available THEN analyzer || ' available' ELSE analyzer || ' not found' END, NULL FROM mine),
sem AS (SELECT bool_or(status = 'warn') AS w, bool_or(status = 'fail') AS x FROM fid WHERE name IN ('symbolNavigation', 'semanticRefs', 'diagnostics')),
en AS (SELECT 'git' AS name, count(*) FILTER (WHERE capability = 'click' AND run_id = last) AS n FROM runs, last UNION ALL SELECT 'markdown', count(*) FILTER (WHERE value > 1e9 AND run_id = last) FROM runs, last)
SELECT 'check' AS part, * FROM ck UNION ALL SELECT 'fidelity', name, status, NULL, NULL FROM fid
UNION ALL SELECT 'recommendation', 'structural', 'fail', '{NO_INDEX}', NULL FROM f WHERE last IS NULL
UNION ALL SELECT 'recommendation', 'semantic', CASE WHEN w THEN 'warn' ELSE 'fail' END, CASE WHEN w THEN '{UNVERIFIED}' ELSE '{DEGRADED}' END, NULL FROM sem WHERE w OR x
UNION ALL SELECT 'recommendation', name, status, name || ': ' || remedy, NULL FROM ck WHERE status <> 'pass' AND remedy IS NOT NULL
UNION ALL SELECT 'coverage', capability, CASE WHEN ok > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN capability = 'refs' THEN 'on-demand' ELSE 'sweep' END || ': ' || ok || ' of ' || n, NULL FROM cov
UNION ALL SELECT 'enricher', name, CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END, CASE WHEN last IS NULL THEN 'no completed run yet' ELSE 'rows: ' || n END, NULL FROM en, last""")
def doctor(spark: SparkSession, d: str) -> DataFrame:
    """The doctor's rows for the tables."""
    return doctor_of(**doctor_tables(spark, d))
