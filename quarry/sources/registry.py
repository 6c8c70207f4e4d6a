"""The registry of languages and analyzers: a subset of YAML as typed, validated rows, and what a repository selects from them."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

log = logging.getLogger(__name__)

# The version, what analyzers can do and what kinds there are.
VERSION, CAPABILITIES, KINDS = 1, ("symbols", "defs", "refs", "diagnostics"), ("lsp", "quality", "heuristic")
ANALYZERS = (
    "language string, display_name string, aliases array<string>, extensions array<string>, manifests array<string>, nth int, analyzer string, kind string, tool string, "
    "command array<string>, capabilities array<string>, priority int, required_files array<string>, notes string"
)


class RegistryError(ValueError):
    """A text that is no registry, with what is wrong and where."""


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _lines(text: str) -> list[tuple[int, int, str]]:
    """(line number, indentation, content) without comments and blank lines."""
    out = []
    for number, line in enumerate(re.split(r"\r?\n", text), 1):
        said = "" if line.lstrip().startswith("#") else line.split(" #")[0].rstrip()
        if said.strip():
            out.append((number, len(said) - len(said.lstrip(" ")), said.strip()))
    return out


def parse_yaml(text: str) -> dict | list | str:
    """Maps, lists and scalars by indentation: block style only, all scalars as text, of a repeated key the last."""
    lines = _lines(text)

    def block(at: int, indent: int) -> tuple[dict | list, int]:
        found: dict | list = [] if lines[at][2].startswith("- ") or lines[at][2] == "-" else {}
        while at < len(lines) and lines[at][1] >= indent:
            number, own, said = lines[at]
            if own > indent:
                raise RegistryError(f"line {number}: unexpected indentation: {said}")
            if isinstance(found, list):
                if not (said.startswith("- ") or said == "-"):
                    break
                item = said[1:].strip()
                if re.match(r"^[\w-]+:(\s|$)", item):  # a map whose first key stands behind the dash
                    lines[at] = (number, own + len(said) - len(item), item)
                    value, at = block(at, lines[at][1])
                else:
                    value, at = _scalar(item), at + 1
                found.append(value)
                continue
            m = re.match(r"^([\w-]+):(?:\s+(.*))?$", said)
            if not m:
                raise RegistryError(f"line {number}: neither a key nor a list: {said}")
            at += 1
            if m[2] is not None:
                found[m[1]] = _scalar(m[2])
            elif at < len(lines) and (lines[at][1] > indent or lines[at][1] == indent and lines[at][2].startswith("- ")):
                found[m[1]], at = block(at, lines[at][1])
            else:
                found[m[1]] = ""
        return found, at

    if not lines:
        return ""
    found, at = block(0, lines[0][1])
    if at < len(lines):
        raise RegistryError(f"line {lines[at][0]}: unexpected indentation: {lines[at][2]}")
    return found


def section(text: str, name: str) -> dict[str, list[str]]:
    """The named lists of a section of a flat configuration; empty where the text or the section doesn't have that form."""
    try:
        found = parse_yaml(text)
    except RegistryError:
        log.warning("a configuration cannot be read", exc_info=True)
        return {}
    held = found.get(name) if isinstance(found, dict) else None
    if not isinstance(held, dict):
        return {}
    return {k: [x for x in v if isinstance(x, str)] for k, v in held.items() if isinstance(v, list)}


def _strings(where: str, entry: dict, key: str, needed: bool = False) -> list[str]:
    value = entry.get(key, [])
    value = [] if value == "" else value
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value) or needed and not value:
        raise RegistryError(f"{where}: {key} must be a list of texts")
    return value


def _map(where: str, value, known: tuple[str, ...]) -> dict:
    if not isinstance(value, dict):
        raise RegistryError(f"{where} must be a map")
    if unknown := sorted(set(value) - set(known)):
        raise RegistryError(f"{where}: unknown field {', '.join(unknown)}")
    return value


def _unique(where: str, names: list[str]) -> None:
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise RegistryError(f"{where}: {', '.join(again)} occurs twice")


def registry_rows(text: str) -> list[tuple]:
    """A registry's analyzers as rows of ``ANALYZERS``, in order; a language without any has a row without one. Anything invalid is an error."""
    doc = _map("the registry", parse_yaml(text), ("version", "capabilities", "languages"))
    if doc.get("version") != str(VERSION):
        raise RegistryError(f"the version must be {VERSION}, not {doc.get('version')}")
    if unknown := sorted(set(_strings("the registry", doc, "capabilities")) - set(CAPABILITIES)):
        raise RegistryError(f"unknown capability {', '.join(unknown)}")
    languages = doc.get("languages")
    if not isinstance(languages, list) or not languages:
        raise RegistryError("there must be a language")
    rows, ids = [], []
    for entry in languages:
        language = _map("a language", entry, ("id", "display_name", "aliases", "detect", "analyzers"))
        name = language.get("id")
        if not name or not language.get("display_name"):
            raise RegistryError(f"language {name}: id and display_name are needed")
        ids.append(name)
        where = f"language {name}"
        detect = _map(f"{where}: detect", language.get("detect") or {}, ("extensions", "manifests"))
        head = (name, language["display_name"], _strings(where, language, "aliases"), _strings(where, detect, "extensions"), _strings(where, detect, "manifests"))
        analyzers = language.get("analyzers") or []
        if not isinstance(analyzers, list):
            raise RegistryError(f"{where}: analyzers must be a list")
        for nth, a in enumerate(analyzers):
            _map(f"{where}: an analyzer", a, ("id", "kind", "tool", "command", "capabilities", "priority", "required_files", "notes"))
            at = f"{where}: analyzer {a.get('id')}"
            if not a.get("id") or a.get("kind") not in KINDS or not a.get("tool"):
                raise RegistryError(f"{at}: id, tool and a kind of {', '.join(KINDS)} are needed")
            able = _strings(at, a, "capabilities", needed=True)
            if unknown := sorted(set(able) - set(CAPABILITIES)):
                raise RegistryError(f"{at}: unknown capability {', '.join(unknown)}")
            if not re.fullmatch(r"-?\d+", str(a.get("priority", ""))):
                raise RegistryError(f"{at}: priority must be a whole number")
            rows.append((*head, nth, a["id"], a["kind"], a["tool"], _strings(at, a, "command", needed=True), able, int(a["priority"]), _strings(at, a, "required_files"), a.get("notes")))
        _unique(where, [a["id"] for a in analyzers])
        if not analyzers:
            rows.append((*head, None, None, None, None, [], [], None, [], None))
    _unique("languages", ids)
    return rows


DEFAULT = """
version: 1
languages:
  - id: typescript
    display_name: TypeScript
    aliases:
      - ts
    detect:
      extensions:
        - .ts
        - .tsx
      manifests:
        - tsconfig.json
    analyzers:
      - id: tsserver
        kind: lsp
        tool: typescript-language-server
        command:
          - typescript-language-server
          - --stdio
        capabilities:
          - symbols
          - defs
          - refs
          - diagnostics
        priority: 100
        required_files:
          - package.json
      - id: patterns
        kind: heuristic
        tool: built-in
        command:
          - built-in
        capabilities:
          - symbols
        priority: 1
  - id: cpp
    display_name: C/C++
    detect:
      extensions:
        - .c
        - .h
        - .cpp
    analyzers:
      - id: clang-tidy
        kind: quality
        tool: clang-tidy
        command:
          - clang-tidy
          - "{file}"
        capabilities:
          - diagnostics
        priority: 50
        required_files:
          - compile_commands.json
"""


@dataclass(frozen=True)
class Registry:
    """Rows of a registry, and why the default took the place of another."""

    rows: list[tuple]
    error: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """A few rows, as many as analyzers are configured."""
        return spark.createDataFrame(self.rows, ANALYZERS)

    def endings(self) -> dict[str, str]:
        """Display names by file ending without its dot, for ``filesystem.language_of``."""
        return {e.lstrip("."): r[1] for r in self.rows for e in r[3]}


def load_registry(text: str | None) -> Registry:
    """The registry of a text; the default where there is none, or with the error where it isn't valid."""
    if text is None:
        return Registry(registry_rows(DEFAULT))
    try:
        return Registry(registry_rows(text))
    except RegistryError as e:
        return Registry(registry_rows(DEFAULT), str(e))


def eligible(analyzers: DataFrame, files: DataFrame) -> DataFrame:
    """``analyzers`` (of ``ANALYZERS``) whose required files are all among ``files`` (path). Only paths that are asked for are looked up."""
    wanted = analyzers.where("analyzer is not null").select("language", "analyzer", F.explode(F.array_distinct("required_files")).alias("path"))
    there = files.select("path").join(F.broadcast(wanted.select("path").distinct()), "path", "left_semi").distinct()  # as many as the registry names
    met = wanted.join(there, "path").groupBy("language", "analyzer").agg(F.count(F.lit(1)).alias("met"))
    held = analyzers.where("analyzer is not null").join(met, ["language", "analyzer"], "left")
    return held.where(F.coalesce("met", F.lit(0)) == F.size(F.array_distinct("required_files"))).drop("met")


def detect_languages(analyzers: DataFrame, files: DataFrame, plugins: dict[str, tuple[str, ...]], fallback: str = "registry") -> DataFrame:
    """Rows (language, plugin, confidence, files) of the languages that files have by their endings.

    A language of a plugin's list is its, others are the fallback's. One for
    which an analyzer is eligible has a confidence of 0.9, else 0.6.
    """
    ending = F.explode("extensions").alias("ending")
    known = F.broadcast(analyzers.select("language", ending).distinct())  # as many as the registry names
    found = files.select(F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ending")).groupBy("ending").agg(F.count(F.lit(1)).alias("n")).join(known, "ending").groupBy("language").agg(F.sum("n").alias("files"))
    able = eligible(analyzers, files).select("language").distinct().withColumn("able", F.lit(0.9))
    owner = F.coalesce(*(F.when(F.col("language").isin(*own), name) for name, own in plugins.items()), F.lit(fallback))
    return found.join(able, "language", "left").select("language", owner.alias("plugin"), F.coalesce("able", F.lit(0.6)).alias("confidence"), "files")


def select_analyzers(analyzers: DataFrame, files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows (language, capability, analyzer, attempt, status, selected): the attempts for each capability of each language.

    Those eligible are tried by falling priority, in the registry's order on
    ties, up to the first whose ``outcomes`` (analyzer, status) are a
    `success`. One without an outcome is `unavailable`. If none succeeds, all
    were tried and none is selected.
    """
    able = eligible(analyzers, files).select("language", "analyzer", "priority", "nth", F.explode("capabilities").alias("capability")).join(outcomes, "analyzer", "left")
    each = Window.partitionBy("language", "capability")
    tried = able.withColumn("attempt", F.row_number().over(each.orderBy(F.desc("priority"), "nth")))
    tried = tried.withColumn("won", F.min(F.when(F.col("status") == "success", F.col("attempt"))).over(each))
    return tried.where(F.col("won").isNull() | (F.col("attempt") <= F.col("won"))).select(
        "language", "capability", "analyzer", "attempt", F.coalesce("status", F.lit("unavailable")).alias("status"), F.coalesce(F.col("attempt") == F.col("won"), F.lit(False)).alias("selected")
    )
