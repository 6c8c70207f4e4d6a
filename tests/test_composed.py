"""Composed reports: limits, orders, empty parts and odd rows."""

from __future__ import annotations

import json

from quarry.operators import composed as C

NODES = "key string, kind string, label string, path string, parent string, score double, loc long, churn long, recency long, summary string"
EVIDENCE = "key string, kind string, source string, locator string, snippet string, at string, seq long"


def parts(spark):
    nodes = [("z", "zone", "Z", None, None, None, None, None, None, None), ("u", "unit", "U", "src/lexer.ts", "z", 0.8, 10, 7, 3, "Reads."), ("lone", "unit", None, None, None, 0.5, 1, 0, 999, None)]
    nodes += [(f"c{i:02}", "unit", f"c{i}", "x", "z", i / 100, 1, 0, 1, None) for i in range(40)] + [(None, "unit", "no key", None, "z", 1.0, 1, 1, 1, None)]
    evidence = [("u", "git", f"s{i}", "l", "p" if i == 69 else None, f"d{i // 2:03}", i) for i in range(70)] + [("u", "git", "undated", None, None, None, 1), (None, "git", "x", None, None, "d", 1), ("gone", "git", "x", None, None, "d", 1)]
    symbols = [("u", f"n{i:03}", "Variable") for i in range(80)] + [("u", "parse it", "Function"), ("u", "parse", "Function"), ("u", None, "Class"), ("lone", "go", "Method"), ("lone", "ok", "Class")]
    return {
        "nodes": spark.createDataFrame(nodes, NODES), "evidence": spark.createDataFrame(evidence, EVIDENCE), "symbols": spark.createDataFrame(symbols, "key string, name string, kind string"),
        "degrees": spark.createDataFrame([("u", 5), ("u", 5), ("gone", 9)], "key string, degree long"), "diagnostics": spark.createDataFrame([("u",), ("u",), ("gone",)], "key string"),
    }


def test_reports_are_cut_and_in_order(spark):
    t = parts(spark)
    frame = C.reports_of(**t)
    got = {r["key"]: r for r in frame.collect()}
    assert len(got) == 43 and None not in got
    u, z, lone = got["u"], got["z"], got["lone"]
    assert [e["source"] for e in u["evidence"]] == [f"s{i}" for i in range(69, 49, -1)] and len(u["symbols"]) == 50
    assert u["level"] == "high" and u["reasons"] == ["high hotspot score (0.80)", "recently high churn (7)", "connected to 5 graph edges", "2 diagnostics recorded"]
    # Phases look at all symbols, also those beyond the cut; the guidance at those shown.
    assert u["phases"] == ["token stream", "AST nodes"] and u["guidance"] == ["no flow edges detected; look at the related nodes"]
    assert [c["child"] for c in z["children"]] == ["u", *(f"c{i}" for i in range(39, 20, -1))]
    assert z["reasons"] == ["no elevated risk signals detected"] and z["level"] == "low" and (z["loc"], z["score"]) == (0, 0.0)
    assert lone["level"] == "medium" and lone["guidance"][1:] == ["references of go", "references of ok"] and lone["phases"] == []
    body = dict(map(tuple, C.markdown(frame).collect()))
    assert body["u"].startswith("# U  [unit]\n\n**Score:** 0.80  **LOC:** 10  **Churn:** 7  **Recency:** 3 days\n\n## Risk\nLevel: high\n- high")
    assert "- git: s69 → l → p\n" in body["u"] and "## Phase Boundaries\nArtifacts crossing phases: token stream -> AST nodes\n" in body["u"]
    assert body["lone"].startswith("# lone  [unit]") and "unknown" in body["lone"] and "No summary available" in body["lone"] and "### Evidence" not in body["lone"]
    assert all(b is not None for b in body.values())
    parsed = {r["key"]: json.loads(r["body"]) for r in C.as_json(frame).collect()}
    assert len(parsed["u"]["evidence"]) == 20 and parsed["z"]["summary"] is None


def test_flows_come_first_and_empty_tables(spark):
    t = parts(spark)
    flows = spark.createDataFrame([("u", f"f{i}", "route", i / 10) for i in range(5)], "key string, label string, kind string, confidence double")
    got = {r["key"]: r["guidance"] for r in C.reports_of(**t, flows=flows).collect()}
    assert got["u"] == [f"flow heuristic: f{i} (route, confidence 0.{i}0)" for i in (4, 3, 2)] and got["z"] == ["no flow edges detected; look at the related nodes"]
    none = {k: f.limit(0) for k, f in t.items()}
    assert C.reports_of(**none).count() == 0
    alone = C.markdown(C.reports_of(**(none | {"nodes": t["nodes"]}))).collect()
    assert len(alone) == 43 and all("### Evidence" not in r["body"] for r in alone)


def test_investigation_lines(spark):
    from datetime import datetime, timedelta

    from quarry.operators.investigations import LOG

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    log = [(1, at(1), "a", "start", None, None, "why?", 1), (2, at(2), "a", "add", None, "u", "see", 1), (3, at(3), "a", "add", None, "unknown", None, 1), (4, at(4), "a", "pin", None, "#1", "kept", 1),
           (5, at(5), "a", "note", None, None, "first", 1), (6, at(6), "a", "note", None, None, "second", 1), (7, at(7), "a", "end", None, None, None, 1), (8, at(8), "b", "start", None, None, None, 1)]
    t = parts(spark)
    commands = spark.createDataFrame([(9, at(5), "a", "show", ["u", "u"], False, 8), (10, at(9), "a", "show", ["u"], False, 8)], "seq long, ts timestamp, actor string, command string, keys array<string>, whole boolean, said long")
    frame = C.investigation_lines(spark.createDataFrame(log, LOG), t["nodes"], t["evidence"], commands, spark.createDataFrame([("u", 100)], "key string, tokens long"))
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r["investigation"], r["section"], r["n"])):
        got.setdefault((r["investigation"], r["section"]), []).append(r["line"])
    assert got[1, "head"] == ["# Investigation #1", "**Question:** why?", "**Status:** open", "**Created:** 2024-01-01"] and got[8, "head"][1] == "**Question:** "
    assert got[1, "notes"] == ["first", "second"] and got[1, "pinned"] == ["- #1", "  > kept"]
    assert got[1, "nodes"] == ["### U  [unit]", "Key: `u`  score: 0.80  loc: 10  churn: 7", "Reads.", "> see", "- git: s69 (l)", "- git: s68 (l)", "- git: s67 (l)", "### unknown  [unknown]", "Key: `unknown`"]
    assert got[1, "savings"] == ["1 commands: 100 tokens read, 2 said, 98 saved"] and got[8, "nodes"] == ["*No nodes added yet.*"] and (8, "savings") not in got
