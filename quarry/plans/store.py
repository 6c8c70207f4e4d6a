"""The run-versioned graph as Parquet tables partitioned by run: typed, read at any version, replaced as a whole, pruned."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions.scalars import fingerprint

#: The columns of each table besides run_id. New ones are added at the end, with what older rows have in ``DEFAULTS``.
SCHEMAS = {
    "runs": "started_at string, completed_at string, repo_root string, repo_commit string, tool_version string",
    "nodes": "kind string, key string, label string, path string, language string, summary string, score double, confidence double, metadata string",
    "edges": "src string, dst string, kind string, weight double, confidence double, metadata string",
    "evidence": "evidence_id string, node_key string, finding_id string, kind string, source string, locator string, snippet string, score double",
    "stats": "key string, metric string, value double",
    "analyzers": "analyzer string, language string, tool_kind string, version string, available boolean, metadata string",
    "analyzer_runs": "analyzer string, key string, language string, capability string, status string, target string, duration_ms long, error_message string, metadata string",
    "symbols": "symbol_id string, path string, name string, kind string, container string, signature string, range string, selection string, external_refs long, metadata string",
    "symbol_edges": "src string, dst string, kind string, metadata string",
    "diagnostics": "path string, symbol_id string, analyzer string, severity string, code string, message string, range string, metadata string",
    "embeddings": "path string, fingerprint string, model string, chunk_key string, vector array<float>",
    "findings": (
        "id string, rule_id string, severity string, confidence string, title string, summary string, fingerprint string, node_key string, "
        "locations array<struct<path:string,line:int,column:int>>, metrics map<string,double>, tags array<string>"
    ),
    "token_events": "seq long, ts timestamp, investigation long, command string, ingested long, emitted long",
}
DEFAULTS = {
    "nodes": {"score": 0.0, "confidence": 0.0}, "edges": {"weight": 1.0, "confidence": 1.0}, "evidence": {"score": 0.0}, "analyzers": {"available": True},
}
#: Tables whose partitions are a run's category, so that an analyzer's rows are replaced without the others'.
BY_CATEGORY = ("findings", "evidence")
FINDING = "rule_id string, severity string, confidence string, title string, summary string, anchor string, node_key string, locations array<struct<path:string,line:int,column:int>>, metrics map<string,double>, tags array<string>"


class GraphStore:
    """Tables under a folder, each partitioned by run_id, so a run is read by pruning and dropped as folders.

    A table is read by its schema here: files of an older version lack the
    columns that came later, and have their defaults; columns that are no
    longer known are not read. A table that was never written is empty.
    Tables of other names are taken as they are.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _at(self, path: str):
        """The file system and path of a folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _remove(self, path: str) -> None:
        store, at = self._at(path)
        store.delete(at, True)

    def parts(self, table: str) -> list[str]:
        return ["run_id", "category"] if table in BY_CATEGORY else ["run_id"]

    def schema(self, table: str) -> T.StructType | None:
        """The columns of a table with those of its partitions, or None if it has no fixed ones."""
        if table not in SCHEMAS:
            return None
        parts = {"run_id": "run_id long", "category": "category string"}
        return T.StructType.fromDDL(", ".join([SCHEMAS[table], *(parts[p] for p in self.parts(table))]))

    def conformed(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of a table in their types: missing ones have defaults, unknown ones are an error."""
        if table not in SCHEMAS:
            return rows
        known = T.StructType.fromDDL(SCHEMAS[table])
        extra = set(rows.columns) - set(known.names) - set(self.parts(table))
        if extra:
            raise ValueError(f"{table} has no column {', '.join(sorted(extra))}")
        default = DEFAULTS.get(table, {})
        given = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        filled = lambda f: F.coalesce(given(f), F.lit(default[f.name])) if f.name in default else given(f)
        return rows.select(*(filled(f).alias(f.name) for f in known))

    def write(self, table: str, rows: DataFrame, run_id: int, key: list[str] | None = None, category: str | None = None) -> None:
        """Replace a run's rows, or those of its category; of rows with one key the first in the frame's order stays."""
        if key:
            rest = [c for c in rows.columns if c not in key]
            nth = rows.withColumn("_nth", F.monotonically_increasing_id())
            rows = nth.groupBy(*key).agg(F.min_by(F.struct(*rest), "_nth").alias("r")).select(*key, "r.*") if rest else rows.distinct()
        self.replace({table: rows}, run_id, category)

    def replace(self, tables: dict[str, DataFrame], run_id: int, category: str | None = None) -> None:
        """Replace a run's rows of several tables, or those of its category.

        All rows are computed and written aside before anything is replaced:
        if that fails, all tables stay as they were. Then each table's
        partition is overwritten from there; one that has no rows any more
        goes, so that none of before is left.
        """
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        try:
            for table, rows in tables.items():
                if (table in BY_CATEGORY) != (category is not None):
                    raise ValueError(f"{table} is {'written by category' if category is None else 'not written by category'}")
                self.conformed(table, rows).write.parquet(f"{aside}/{table}")
            for table in tables:
                rows = self.spark.read.parquet(f"{aside}/{table}")
                named = rows.withColumn("run_id", F.lit(run_id)) if category is None else rows.withColumns({"run_id": F.lit(run_id), "category": F.lit(category)})
                if rows.limit(1).count():
                    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts(table)).parquet(self.path(table))
                else:
                    self._remove(f"{self.path(table)}/run_id={run_id}" + (f"/category={category}" if category is not None else ""))
        finally:
            self._remove(aside)

    def read(self, table: str, run_id: int | None = None) -> DataFrame:
        schema = self.schema(table)
        store, at = self._at(self.path(table))
        if schema is None:
            df = self.spark.read.parquet(self.path(table))
        elif not store.exists(at):
            df = self.spark.createDataFrame([], schema)
        else:
            default = DEFAULTS.get(table, {})
            try:
                df = self.spark.read.schema(schema).parquet(self.path(table))
            except AnalysisException:  # all of its partitions are gone
                df = self.spark.createDataFrame([], schema)
            df = df.select(*(F.coalesce(c, F.lit(default[c])).alias(c) if c in default else F.col(c) for c in schema.names))
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def views(self, run_id: int | None = None, prefix: str = "") -> list[str]:
        """Make each table a temporary view for SQL, of one run or of all; returns their names."""
        for table in SCHEMAS:
            self.read(table, run_id).createOrReplaceTempView(f"{prefix}{table}")
        return [f"{prefix}{table}" for table in SCHEMAS]

    def completed(self, repo: str) -> DataFrame:
        return self.read("runs").where((F.col("repo_root") == repo) & F.col("completed_at").isNotNull())

    def latest_run(self, repo: str) -> int | None:
        """The newest completed run of a repository."""
        return self.completed(repo).agg(F.max("run_id")).first()[0]

    def resolve(self, table: str, repo: str) -> tuple[int | None, int | None]:
        """The newest completed run with rows in a table, and the latest run if that is another."""
        latest = self.latest_run(repo)
        held = self.completed(repo).join(self.read(table).select("run_id").distinct(), "run_id", "left_semi").agg(F.max("run_id")).first()[0]
        return held, latest if held != latest else None

    def carry(self, table: str, old: int, new: int) -> DataFrame:
        """Rows of the old run whose unit has equal metadata in the new one."""
        units = self.read("nodes").where("kind = 'unit'").select("run_id", "path", "metadata")
        a, b = (units.where(F.col("run_id") == r).select("path", F.col("metadata").alias(f"m{i}")) for i, r in enumerate((old, new)))
        same = a.join(b, "path").where("m0 = m1").select("path")
        return self.read(table, old).join(same, "path", "left_semi").drop("run_id")

    def prunable(self, keep: int, protected: DataFrame | None = None) -> list[int]:
        """Runs that are neither among the newest nor in ``protected`` (run_id)."""
        runs = self.read("runs").select("run_id").distinct()
        held = runs.orderBy(F.desc("run_id")).limit(max(keep, 1))
        if protected is not None:
            held = held.union(protected.select("run_id"))
        return sorted(r[0] for r in runs.join(held.distinct(), "run_id", "left_anti").collect())  # runs are few

    def protected(self, repo: str, keep: int, investigations: DataFrame | None = None) -> set[int]:
        """Runs of a repository that stay: the ``keep`` newest completed ones, the newest with symbols, the newest with vectors, and those of investigations (run_id)."""
        newest = self.completed(repo).select("run_id").distinct().orderBy(F.desc("run_id")).limit(max(keep, 1))
        held = {r[0] for r in newest.collect()}
        held |= {r for r in (self.resolve(table, repo)[0] for table in ("symbols", "embeddings")) if r is not None}
        if investigations is not None:
            held |= {r[0] for r in investigations.where("run_id is not null").select("run_id").distinct().collect()}
        return held

    def prune(self, repo: str, keep: int, investigations: DataFrame | None = None, dry_run: bool = False) -> list[int]:
        """Delete the other runs of a repository from all tables, and return them; ``dry_run`` only returns them.

        Runs go from the tables of their rows first, and from ``runs`` last,
        so one that is half deleted is known and goes the next time.
        """
        held = self.protected(repo, keep, investigations)
        gone = sorted({r[0] for r in self.read("runs").where(F.col("repo_root") == repo).select("run_id").distinct().collect()} - held)
        for run_id in [] if dry_run else gone:
            for table in [*(t for t in SCHEMAS if t != "runs"), "runs"]:
                self._remove(f"{self.path(table)}/run_id={run_id}")
        return gone


class FindingsStore:
    """A run's findings with their evidence, replaced by category as analyzers recompute them."""

    def __init__(self, store: GraphStore, run_id: int) -> None:
        self.store, self.run_id = store, run_id

    def identified(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of the columns of ``FINDING``, those that are missing null) with fingerprint and id.

        A fingerprint is of the rule, the first location's path or else the
        node's key, and the anchor. Findings of one fingerprint are numbered
        in the order of their title, summary and locations.
        """
        given = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        place = F.coalesce(F.get("locations", 0)["path"], "node_key", F.lit(""))
        marked = rows.select(*(given(f).alias(f.name) for f in T.StructType.fromDDL(FINDING))).withColumn("fingerprint", fingerprint(F.col("rule_id"), place, F.col("anchor")))
        n = F.row_number().over(Window.partitionBy("fingerprint").orderBy("title", "summary", "locations"))
        ending = F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")
        return marked.withColumn("_n", n).withColumn("id", F.concat(F.lit(f"fnd_r{self.run_id}_"), "fingerprint", ending)).drop("_n", "anchor")

    def recompute(self, category: str, rows: DataFrame, evidence: DataFrame | None = None) -> None:
        """Put ``rows`` and their ``evidence`` (fingerprint, kind, source, locator, snippet) in place of all of the category before.

        Evidence belongs to all findings of its fingerprint; without one it is left out.
        """
        found = self.identified(rows)
        if evidence is None:
            linked = self.store.spark.createDataFrame([], SCHEMAS["evidence"])
        else:
            linked = evidence.join(found.select("fingerprint", F.col("id").alias("finding_id"), "node_key"), "fingerprint").drop("fingerprint")
        self.store.replace({"findings": found, "evidence": linked}, self.run_id, category)

    def purge(self, category: str, keep: Column | None = None) -> None:
        """Delete a category's findings with their evidence; those for which ``keep`` is true stay."""
        old = self.store.read("findings", self.run_id).where(F.col("category") == category)
        stay = old.where(F.lit(False) if keep is None else F.coalesce(keep, F.lit(False)))
        evidence = self.store.read("evidence", self.run_id).where(F.col("category") == category)
        linked = evidence.join(stay.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")
        self.store.replace({"findings": stay.drop("run_id", "category"), "evidence": linked.drop("run_id", "category")}, self.run_id, category)

    def list(self, category: str | None = None, rule_id: str | None = None) -> DataFrame:
        """Findings by category, rule and id."""
        df = self.store.read("findings", self.run_id)
        df = df if category is None else df.where(F.col("category") == category)
        df = df if rule_id is None else df.where(F.col("rule_id") == rule_id)
        return df.orderBy("category", "rule_id", "id")

    def evidence(self, finding_id: str) -> DataFrame:
        """A finding's evidence by kind, source, locator and snippet."""
        rows = self.store.read("evidence", self.run_id).where(F.col("finding_id") == finding_id)
        return rows.select("kind", "source", "locator", "snippet").orderBy("kind", "source", "locator", "snippet")
