"""Sources: file trees, history, issues, manifests, imports, heuristic symbols."""

from __future__ import annotations

import json
import logging
import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import EXEMPT_PATH, glob_to_regex, is_test_path, line_count, normalize_path, symbol_signal, tokens

log = logging.getLogger(__name__)

# Folders that are never read, languages by file ending, manifests of a root folder, and files that a framework routes to.
IGNORED_DIRS = (
    ".git", "node_modules", "dist", "build", ".cache", "coverage", "__pycache__", ".venv", "venv", "vendor", "target", ".next", "out", ".turbo",
    ".quarry", ".beads", ".claude", ".nardo", ".omc", ".zig-cache", "zig-out",
)
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "zig": "Zig",
    "java": "Java", "rb": "Ruby", "php": "PHP", "cs": "C#", "cpp": "C/C++", "cc": "C/C++", "cxx": "C/C++", "c": "C/C++", "h": "C/C++", "hpp": "C/C++", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "md": "Markdown", "mdx": "Markdown", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "sql": "SQL",
}
MANIFESTS = (
    "package.json", "pyproject.toml", "requirements.txt", "setup.py", "go.mod", "Cargo.toml", "build.zig", "build.zig.zon", "pom.xml", "build.gradle", "Gemfile", "composer.json",
)
ROUTE_GLOBS = ("**/route.ts", "**/routes.ts", "**/route.tsx", "**/page.tsx", "**/routes.js")
SCRIPT = r"\.(ts|tsx|js|jsx)$"
SHELL = r"\.(sh|bash|zsh)$"


def ignore_glob(glob: str) -> str:
    """An ignore rule's regular expression, in which * crosses folders and ? is any character."""
    return "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def ignored(path: Column, dirs: Iterable[str] = IGNORED_DIRS, globs: Iterable[str] = ()) -> Column:
    """In an ignored folder, or matching a glob by path or by name."""
    parts = F.split(path, "/")
    dirs = tuple(dirs)
    out = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*(F.lit(x) for x in dirs))) if dirs else F.lit(False)
    for g in globs:
        out = out | path.rlike(ignore_glob(g)) | F.element_at(parts, -1).rlike(ignore_glob(g))
    return out


def language_of(path: Column, more: dict[str, str] | None = None) -> Column:
    table = LANGUAGES | (more or {})
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(known, ending), F.lit("Other"))


def _store(root: str):
    """The file system of a folder's URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://")) if re.match(r"^[a-z0-9]+:", root) else (fs.LocalFileSystem(), os.path.abspath(root))


def walk(root: str, dirs: Iterable[str] = IGNORED_DIRS) -> Iterator[tuple[str, int, float]]:
    """(path under the root, bytes, mtime) of all files, empty ones too; ignored folders are not entered, unreadable ones skipped."""
    from pyarrow import fs

    store, base = _store(root)
    skipped, todo = frozenset(dirs), [base]
    while todo:
        try:
            found = store.get_file_info(fs.FileSelector(todo.pop()))
        except OSError:
            log.warning("a folder cannot be listed", exc_info=True)
            continue
        for info in found:
            if info.type == fs.FileType.Directory and info.base_name not in skipped:
                todo.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path[len(base) :].lstrip("/"), info.size or 0, info.mtime.timestamp() if info.mtime else 0.0


def read_tree(spark: SparkSession, root: str, globs: Iterable[str] = (), dirs: Iterable[str] = ()) -> DataFrame:
    """Files under a root as units: path, language, bytes, mtime, text, loc, tokens, is_manifest.

    The driver lists the tree, as it would for any source; the files are read
    by the tasks, ignored ones never. Files that aren't UTF-8 have what can be
    read, those that are gone or can't be read an empty text.
    """
    listed = list(walk(root, (*IGNORED_DIRS, *dirs)))
    files = spark.createDataFrame(listed, "path string, bytes long, mtime double").where(~ignored(F.col("path"), (), globs))
    files = files.repartition(max(1, min(len(listed) // 500, 1000))).select("path", "bytes", F.timestamp_seconds("mtime").alias("mtime"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part, texts = batch.slice(i, 100), []
                for path in part.column(0).to_pylist():
                    try:
                        with store.open_input_file(f"{base}/{path}") as f:
                            texts.append(f.read().decode("utf-8", "replace"))
                    except OSError:
                        texts.append("")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["path", "bytes", "mtime", "text"])

    named = files.mapInArrow(read, "path string, bytes long, mtime timestamp, text string")
    language = language_of(F.col("path"))
    return named.select(
        "path", language.alias("language"), "bytes", "mtime", "text", line_count(F.col("text")).alias("loc"),
        tokens(F.char_length("text"), 3.5).alias("tokens"), is_manifest(F.col("path")).alias("is_manifest"),
    )


def is_manifest(path: Column) -> Column:
    """A known manifest or a project file in the root folder."""
    return path.isin(*MANIFESTS) | path.rlike(r"^[^/]+\.csproj$")


def entrypoints(units: DataFrame, globs: Iterable[str]) -> DataFrame:
    """``units`` with entrypoint ('true' if configured, 'inferred', or null) and the reason.

    Inferred are the targets of the root's package.json (bin, then main, then
    module), files that a framework routes to, and scripts of TypeScript or
    JavaScript that begin with #!. The configured come first.
    """
    path = F.col("path")
    configured = F.lit(False)
    for g in globs:
        configured = configured | path.rlike(glob_to_regex(g))
    route = F.lit(False)
    for g in ROUTE_GLOBS:
        route = route | path.rlike(glob_to_regex(g))
    manifest = units.where("path = 'package.json'").select("text")
    bin_one, bin_many = F.get_json_object("text", "$.bin"), F.map_values(F.from_json(F.get_json_object("text", "$.bin"), "map<string,string>"))
    bins = F.when(F.startswith(bin_one, F.lit("{")), bin_many).when(bin_one.isNotNull(), F.array(bin_one)).otherwise(F.array().cast("array<string>"))
    listed = F.concat(
        F.transform(bins, lambda x: F.struct(F.lit(0).alias("rank"), F.lit("package.json bin").alias("why"), x.alias("target"))),
        *(F.array(F.struct(F.lit(i).alias("rank"), F.lit(f"package.json {f}").alias("why"), F.get_json_object("text", f"$.{f}").alias("target"))) for i, f in enumerate(("main", "module"), 1)),
    )
    targets = manifest.select(F.explode(listed).alias("t")).where("t.target is not null").select(F.regexp_replace("t.target", r"^\./", "").alias("path"), "t.rank", "t.why")
    targets = targets.groupBy("path").agg(F.min_by("why", "rank").alias("why"))
    script = path.rlike(SCRIPT) & F.startswith("text", F.lit("#!"))
    inferred = F.when(F.col("why").isNotNull(), F.col("why")).when(route, "route convention").when(script, "shebang CLI")
    return units.join(F.broadcast(targets), "path", "left").withColumns({
        "entrypoint": F.when(configured, "true").when(inferred.isNotNull(), "inferred"),
        "entrypoint_reason": F.when(configured, "config").otherwise(inferred),
    }).drop("why")


def _with(name: str, **fixed) -> Callable[[Column], Column]:
    """What makes a struct of an element and fixed values."""
    return lambda x: F.struct(x.alias(name), *(F.lit(v).alias(k) for k, v in fixed.items()))


def imports(units: DataFrame) -> DataFrame:
    """Rows (path, specifier, confidence): static, type-only and dynamic (0.5) imports of scripts, ``source`` and ``.`` of shell files."""
    script = (
        (r"""(?m)^\s*(?:import|export)\b[^'";]*?\bfrom\s*['"]([^'"]+)['"]""", 1.0), (r"""(?m)^\s*import\s*['"]([^'"]+)['"]""", 1.0),
        (r"""(?:import|export)\s+type\s[^'"]*?from\s*['"]([^'"]+)['"]""", 1.0), (r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", 1.0), (r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""", 0.5),
    )
    shell = ((r"""(?m)^\s*(?:source|\.)\s+['"]?([^\s'"#]+)""", 1.0),)
    found = lambda ps: F.concat(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _with("specifier", confidence=c)) for p, c in ps))
    each = F.when(F.col("path").rlike(SHELL), found(shell)).when(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"), found(script))
    rows = units.select("path", F.explode(each).alias("i")).select("path", "i.*")
    return rows.groupBy("path", "specifier").agg(F.max("confidence").alias("confidence"))


ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def resolve_imports(found: DataFrame, units: DataFrame) -> DataFrame:
    """Edges (src, dst, confidence) of relative specifiers: the first of the endings that is a unit."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rel = found.where(F.startswith("specifier", F.lit("."))).select("path", "specifier", "confidence", normalize_path(F.concat(folder, "specifier")).alias("base"))
    tries = rel.where("base is not null").select("path", "specifier", "confidence", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in ENDINGS))).alias("pos", "dst"))
    hits = tries.join(units.select(F.col("path").alias("dst")).distinct(), "dst")
    best = hits.groupBy("path", "specifier").agg(F.min_by("dst", "pos").alias("dst"), F.max("confidence").alias("confidence"))
    return best.where("path <> dst").groupBy(F.col("path").alias("src"), "dst").agg(F.max("confidence").alias("confidence"))


# What declares a symbol in each family of languages, and the words that only look like one.
C_PATTERNS = (
    ("Constant", r"(?m)^\s*#\s*define\s+(\w+)"), ("Typedef", r"(?m)^\s*typedef\b.*?\b(\w+)\s*;"), ("Struct", r"(?m)^\s*struct\s+(\w+)"), ("Union", r"(?m)^\s*union\s+(\w+)"),
    ("Enum", r"(?m)^\s*enum\s+(\w+)"), ("Class", r"(?m)^\s*class\s+(\w+)"), ("Function", r"(?m)^[A-Za-z_][\w\s*]*?\s+\*?(\w+)\s*\([^;{]*\)\s*\{"),
)
C_WORDS = ("if", "for", "while", "switch", "return", "sizeof", "else", "do", "goto")
SHELL_PATTERNS = (("Function", r"(?m)^function\s+(\w+)"), ("Function", r"(?m)^\s*(\w+)\s*\(\s*\)"))
SHELL_WORDS = ("if", "for", "while", "until", "case", "select", "return", "do", "done", "fi", "esac", "then", "else")
GENERIC_PATTERNS = (
    ("Class", r"(?m)^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("Interface", r"(?m)^(?:export\s+)?interface\s+(\w+)"), ("Function", r"(?m)^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("TypeParameter", r"(?m)^(?:export\s+)?type\s+(\w+)\s*="), ("Variable", r"(?m)^(?:export\s+)?(?:const|let)\s+(\w+)"),
    ("Method", r"(?m)^\s{2,}(?:async\s+)?(?:(?:public|private|protected|static|override)\s+)*(\w+)\s*\("),
)
METHOD_WORDS = ("if", "for", "while", "switch", "catch", "constructor", "return")


def heuristic_symbols(units: DataFrame) -> DataFrame:
    """Rows (path, kind, name, signal), each once, by the patterns of the file's language."""

    def found(patterns, words, only: str | None = None):
        each = F.concat(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _with("name", kind=k)) for k, p in patterns))
        return F.filter(each, lambda s: ~(s["name"].isin(*words) & (s["kind"] == only if only else F.lit(True))))

    symbols = (
        F.when(F.col("path").rlike(r"\.(c|h|cc|cpp|cxx|hpp)$"), found(C_PATTERNS, C_WORDS)).when(F.col("path").rlike(SHELL), found(SHELL_PATTERNS, SHELL_WORDS))
        .otherwise(found(GENERIC_PATTERNS, METHOD_WORDS, "Method"))
    )
    rows = units.select("path", F.explode(F.array_distinct(symbols)).alias("s")).select("path", "s.kind", "s.name")
    return rows.withColumn("signal", symbol_signal(F.col("kind"), F.col("name")))


def scan(units: DataFrame, pattern: str) -> DataFrame:
    """Rows (path, line_no, line) of trimmed lines that match, whatever the case; tests and fixtures are left out."""
    lines = units.where(~is_test_path(F.col("path")) & ~F.col("path").rlike(EXEMPT_PATH)).select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.where(F.col("line").rlike(f"(?i){pattern}")).select("path", (F.col("at") + 1).alias("line_no"), F.trim("line").alias("line"))


def read_history(spark: SparkSession, repo: str, since: str = "6 months ago", limit: int = 200) -> DataFrame:
    """Commits (hash, ts, subject, files) of a git work tree; empty if there is none. ``limit`` is a feature of the source."""
    schema = "hash string, ts timestamp, subject string, files array<string>"
    run = subprocess.run(
        ["git", "-C", repo, "log", f"--since={since}", f"--max-count={limit}", "--name-only", "--format=%x01%H%x02%ct%x02%s"], capture_output=True, text=True, check=False
    )
    if run.returncode:
        return spark.createDataFrame([], schema)
    rows = []
    for record in run.stdout.split("\x01")[1:]:
        head, _, rest = record.partition("\n")
        commit, at, subject = head.split("\x02", 2)
        rows.append((commit, int(at), subject, [x for x in rest.split("\n") if x]))
    return spark.createDataFrame(rows, "hash string, at long, subject string, files array<string>").select("hash", F.timestamp_seconds("at").alias("ts"), "subject", "files")


def read_head(repo: str) -> tuple[str | None, bool | None]:
    """The commit at HEAD of a git work tree, and if files differ from it; nulls where there is none."""
    head, status = (subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=False) for args in (("rev-parse", "HEAD"), ("status", "--porcelain")))
    return (head.stdout.strip() if head.returncode == 0 else None), (bool(status.stdout.strip()) if status.returncode == 0 else None)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues (id, title, status, priority, depends_on) of a JSON list; entries without a text id and title are left out."""
    raw = spark.read.schema("id string, title string, status string, priority int, dependencies array<struct<depends_on_id:string>>").json(path, multiLine=True)
    return raw.where("id is not null and title is not null").select(
        "id", "title", "status", "priority", F.coalesce(F.col("dependencies.depends_on_id"), F.array().cast("array<string>")).alias("depends_on")
    )


def manifest_packages(units: DataFrame) -> DataFrame:
    """Rows (path, name, section) of the packages that package.json files declare, in lower case."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = units.where("path = 'package.json' or path like '%/package.json'").select("path", F.from_json("text", ", ".join(f"{s} map<string,string>" for s in sections)).alias("j"))
    rows = F.flatten(F.array(*(F.transform(F.coalesce(F.map_keys(f"j.{s}"), F.array().cast("array<string>")), _with("name", section=s)) for s in sections)))
    return parsed.select("path", F.explode(rows).alias("p")).select("path", F.lower("p.name").alias("name"), "p.section")


def sarif_log(results: DataFrame, tool: str = "quarry") -> str:
    """A SARIF 2.1.0 log of the rows of ``sarif_render``. The log is one document: its results are collected."""
    rows = [json.loads(r["result"]) for r in results.orderBy("id").toLocalIterator()]
    rules = sorted({r["ruleId"] for r in rows})
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": rows}]})
