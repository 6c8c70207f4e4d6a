"""Scalar functions of the engine as Column expressions: all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which paths are tests, and which are exempt from reachability.
TEST_PATH = r"(\.test\.|\.spec\.)|(^|/)(test|tests|__tests__)/"
TEST_SUFFIX = r"\.(test|spec)\.(ts|tsx|js|jsx)$"
EXEMPT_PATH = r"\.d\.ts$|(^|/)fixtures/"
# Names that say little about what shares them.
LOW_SIGNAL_NAMES = (
    "args", "child", "children", "detail", "details", "edge", "edges", "entry", "evidence", "file", "files", "flow", "flows", "issue", "issueid", "item", "items", "key", "kind", "label", "line",
    "locator", "message", "name", "node", "nodes", "path", "reason", "result", "results", "row", "rows", "section", "sections", "signal", "signals", "snippet", "stats", "status", "symbol", "symbols", "value",
)
LOW_SIGNAL_WORDS = ("arg", "args", "ctx", "data", "detail", "entry", "item", "node", "options", "opts", "param", "params", "result", "results", "row", "rows", "value", "values")
LOW_SIGNAL_KINDS = ("Constant", "Field", "Property", "Variable")
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unterminated last line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def tokens(length: Column, per_token: float = 4.0) -> Column:
    """An estimate from a length in characters: prose and diffs have 4 a token, code 3.5."""
    return F.round(length / F.lit(per_token)).cast("long")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def classify_doc(path: Column) -> Column:
    """The kind of a Markdown file by its base name."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(base.isin("readme.md", "readme.mdx"), "readme")
        .when(base.contains("adr"), "adr")
        .when(base.contains("runbook"), "runbook")
        .when(base.contains("spec") | base.contains("prd"), "spec")
        .when(base.contains("architecture"), "architecture-note")
        .otherwise("markdown")
    )


def summarize(body: Column) -> Column:
    """The first four lines that aren't blank, trimmed, in 500 characters."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(F.array_join(F.slice(lines, 1, 4), " "), F.lit(500))


def node_refs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b((?:repo|zone|unit|flow):[A-Za-z0-9_./-]+)"), F.lit(1))


def zone_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def package_name(specifier: Column) -> Column:
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def normalize_path(path: Column) -> Column:
    """Resolves . and ..; null if it leaves the root."""
    def step(acc: Column, part: Column) -> Column:
        gone = F.transform(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), lambda x: x)
        return (
            F.when(acc.isNull(), acc)
            .when((part == ".") | (part == ""), acc)
            .when(part == "..", F.when(F.size(acc) > 0, gone))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def fingerprint(rule: Column, path: Column, anchor: Column) -> Column:
    """The first 16 hex digits of the sha-256 of rule, path and anchor, a zero character between them."""
    return F.substring(F.sha2(F.concat_ws("\0", rule, F.replace(path, F.lit("\\"), F.lit("/")), anchor), 256), 1, 16)


def freshness_boost(days: Column) -> Column:
    return (
        F.when(days.isNull() | (days > 900), 0.0).when(days <= 1, 0.35).when(days <= 3, 0.25).when(days <= 7, 0.15).when(days <= 14, 0.05).otherwise(0.0)
    )


def hotspot_score(churn: Column, loc: Column, max_churn: Column, max_loc: Column) -> Column:
    return 0.6 * churn / F.greatest(max_churn, F.lit(1)) + 0.4 * loc / F.greatest(max_loc, F.lit(1))


def symbol_signal(kind: Column, name: Column) -> Column:
    """low for a name that is no plain word, and for a kind and a name that both say little."""
    return F.when(name.rlike(r"[().\[\]\s]") | kind.isin(*LOW_SIGNAL_KINDS) & name.isin(*LOW_SIGNAL_WORDS), "low").otherwise("high")


def confidence_from_strong(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, 0.5).when(n == 2, 0.7).otherwise(0.9)


def layer_of(path: Column, layers: Sequence[str]) -> Column:
    """The number of the first layer that the path lies in, directly or under src/."""
    return F.coalesce(*(F.when(F.startswith(path, F.lit(f"{x}/")) | F.startswith(path, F.lit(f"src/{x}/")), i) for i, x in enumerate(layers)), F.lit(None).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ, or if a vector is empty or zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    scale = norm(x) * norm(y)
    return F.when((F.size(x) == F.size(y)) & (scale > 0), dot / scale).otherwise(0.0)


def risk_level(score: Column, churn: Column, edges: Column, diagnostics: Column) -> Column:
    n = (
        F.when(score >= 0.75, 2).when(score >= 0.5, 1).otherwise(0)
        + F.when(churn >= 5, 1).otherwise(0)
        + F.when(edges >= 5, 1).otherwise(0)
        + F.when(diagnostics > 0, 1).otherwise(0)
    )
    return F.when(n >= 2, "high").when(n >= 1, "medium").otherwise("low")


def glob_to_regex(glob: str, braces: bool = True) -> str:
    """An anchored regular expression: ** crosses folders, * and ? don't, {a,b} are alternatives."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{" and braces and "}" in glob[i:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


#: Comments, strings (whatever is left open runs to the end), words, line feeds and single marks.
CODE = r"""(?s)(//[^\n]*|/\*.*?(?:\*/|\z)|'(?:[^'\\]|\\.)*(?:'|\z)|"(?:[^"\\]|\\.)*(?:"|\z)|`(?:[^`\\]|\\.)*(?:`|\z)|[A-Za-z0-9_$]+|[^ \t\r\n])"""


def code_tokens(text: Column) -> Column:
    """Strings, words and single marks, without comments."""
    java = CODE.replace("\\\\.)*", "\\\\.)*+")  # a loop that keeps what it has read needs no stack
    return F.filter(F.regexp_extract_all(text, F.lit(java), F.lit(1)), lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))


def normalize_literals(toks: Column) -> Column:
    """Strings and numbers as placeholders."""
    return F.transform(toks, lambda t: F.when(t.rlike("^[\"'`]"), "\x01str").when(t.rlike("^[0-9]"), "\x01num").otherwise(t))


def parse_range(json: Column) -> Column:
    """(line, character) of a range's start; null where the JSON is malformed or has none."""
    start = F.from_json(json, "start struct<line:int,character:int>")["start"]
    return F.when(start["line"].isNotNull(), start)


def on_line(text: Column, line: Column, word: str = "export") -> Column:
    """If a declaration's line (from 0) holds a word; false beyond the text."""
    return F.coalesce(F.get(F.split(text, "\n", -1), line).rlike(rf"\b{word}\b"), F.lit(False))
