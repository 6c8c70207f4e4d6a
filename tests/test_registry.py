"""The registry's text, its errors and its fallback, and what is selected from it."""

from __future__ import annotations

import pytest

from quarry.operators.flows import signals_of
from quarry.operators.texts import parse_log
from quarry.sources.registry import DEFAULT, RegistryError, detect_languages, eligible, load_registry, parse_yaml, registry_rows, section, select_analyzers


def test_the_subset_of_yaml():
    text = """
# a comment
a: 1   # behind
b:
  - x # gone
  - "y # not"
  - 'z'
c:
- flush
d:
  e:
    - id: one
      list:
        - 1
    -
  f: http://x:1/#y
g:
"""
    assert parse_yaml(text) == {"a": "1", "b": ["x", '"y', "z"], "c": ["flush"], "d": {"e": [{"id": "one", "list": ["1"]}, ""], "f": "http://x:1/#y"}, "g": ""}
    assert parse_yaml("") == "" and parse_yaml("- a\r\n- b") == ["a", "b"]
    for bad in ("a: 1\n   b: 2", "just words", "- a\nb: 1", "a:\n    - x\n  - y"):
        with pytest.raises(RegistryError, match="line"):
            parse_yaml(bad)


@pytest.mark.parametrize(("old", "new", "said"), [
    ("version: 1", "version: 2", "version"), ("languages:", "tongues:", "tongues"), ("kind: lsp", "kind: oracle", "kind"), ("priority: 100", "priority: high", "whole number"),
    ("id: patterns", "id: tsserver", "twice"), ("id: cpp\n", "id: typescript\n", "twice"), ("          - refs\n", "          - guess\n", "guess"), ("display_name: C/C++", "colour: red", "colour"),
    ("        command:\n          - built-in\n", "", "command"), ("        tool: clang-tidy\n", "", "tool"), ("    detect:\n      extensions:\n        - .c", "    detect:\n      extension:\n        - .c", "extension"),
])
def test_what_is_invalid_is_said_and_the_default_answers(old, new, said):
    assert old in DEFAULT
    text = DEFAULT.replace(old, new, 1)
    with pytest.raises(RegistryError, match=said):
        registry_rows(text)
    got = load_registry(text)
    assert got.rows == load_registry(None).rows and said in got.error and load_registry(None).error is None
    assert load_registry(None).endings() == {"ts": "TypeScript", "tsx": "TypeScript", "c": "C/C++", "h": "C/C++", "cpp": "C/C++"}


def test_selection_by_files_and_outcomes(spark):
    registry = load_registry(None).frame(spark)
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    outcomes = lambda *o: spark.createDataFrame(o, "analyzer string, status string") if o else spark.createDataFrame([], "analyzer string, status string")
    got = lambda f, o: {(r["language"], r["capability"], r["analyzer"], r["attempt"], r["status"], r["selected"]) for r in select_analyzers(registry, f, o).collect()}
    assert {r["analyzer"] for r in eligible(registry, files("package.json", "x/compile_commands.json")).collect()} == {"tsserver", "patterns"}
    both = got(files("package.json", "package.json"), outcomes(("tsserver", "failed"), ("patterns", "success")))
    assert {x for x in both if x[1] == "symbols"} == {("typescript", "symbols", "tsserver", 1, "failed", False), ("typescript", "symbols", "patterns", 2, "success", True)}
    assert ("typescript", "refs", "tsserver", 1, "failed", False) in both and len(both) == 5
    first = got(files("package.json", "compile_commands.json"), outcomes(("tsserver", "success")))
    assert ("typescript", "symbols", "tsserver", 1, "success", True) in first and not any(x[2] == "patterns" for x in first)
    assert ("cpp", "diagnostics", "clang-tidy", 1, "unavailable", False) in first
    found = {r["language"]: (r["plugin"], r["confidence"], r["files"]) for r in detect_languages(registry, files("a.ts", "b.tsx", "lib/c.h", "d.ts.bak", "noending"), {"web": ("typescript",)}).collect()}
    assert found == {"typescript": ("web", 0.9, 2), "cpp": ("registry", 0.6, 1)}


def test_user_signals_of_a_configuration():
    config = "ignore:\n  dirs:\n    - tmp\nflows:\n  route_deps:\n    - Flask\n  queue_patterns:\n    - '@task'\n    - delay\\(\n  cli_patterns:\n  other: x\n"
    got = signals_of(config)
    assert got.packages == {"http-routes": ("Flask",)} and got.patterns == {"queue-workers": ("@task", "delay\\(")}
    assert section(config, "ignore") == {"dirs": ["tmp"]} and section("no: \n     form", "x") == {} and signals_of("").packages == {}


def test_notes_stay_in_their_log(spark):
    rows = [(1, "t", 1, "a.c:1:1: warning: one [w]"), (2, "t", 2, "b.c:1:1: error: two [e]"), (3, "t", 1, "a.c:2:1: note: of one"), (4, "t", 2, "b.c:2:1: note: of two"), (5, "t", 3, "c.c:9:9: note: of nothing")]
    got = {(r["log"], r["path"], r["message"], r["severity"]) for r in parse_log(spark.createDataFrame(rows, "n int, tool string, log int, line string"), ("tool", "log")).collect()}
    assert got == {(1, "a.c", "one\nof one", "warning"), (2, "b.c", "two\nof two", "error"), (3, "c.c", "of nothing", "note")}
