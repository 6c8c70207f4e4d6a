"""The doctor's checks: pass, warn and fail of each, and nothing to look at."""

from __future__ import annotations

import pytest

from quarry.operators import doctor as D

SCHEMAS = {
    "tools": "tool string, required boolean, found boolean, remedy string", "runs": "run_id long, completed boolean", "files": "run_id long, path string",
    "analyzers": "language string, analyzer string, tool string, available boolean, capabilities array<string>", "analyzer_runs": "run_id long, capability string, status string",
    "enrichers": "run_id long, enricher string, available boolean, n long",
}


def see(spark, scope=None, error=None, **rows):
    frames = {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in SCHEMAS.items()}
    got = D.doctor_of(**frames, registry_error=error, scope=scope).collect()
    assert len({(r["part"], r["name"], r["message"]) for r in got}) == len(got)
    return {(r["part"], r["name"]): (r["status"], r["message"], r["remedy"]) for r in got}


SOUND = {
    "tools": [("git", True, True, "get git"), ("rg", False, True, "get rg")], "runs": [(1, True), (2, True), (3, False), (4, None)],
    "files": [(1, "old"), (2, "a"), (2, "b"), (2, "b"), (3, "c")], "analyzers": [("ts", "lsp", "tsserver", True, ["symbols", "defs", "refs", "diagnostics"])],
    "analyzer_runs": [(2, "symbols", "success"), (2, "symbols", "failed"), (2, "refs", "success"), (2, "diagnostics", "success"), (1, "defs", "failed")], "enrichers": [(2, "git", True, 3), (1, "git", True, 9)],
}


def test_all_is_well(spark):
    got = see(spark, **SOUND)
    assert {s for (part, _), (s, _, _) in got.items()} == {"pass"} and not [k for k in got if k[0] == "recommendation"]
    assert got["check", "database"][1] == "run 2, 2 files indexed" and got["check", "ts:lsp"][1] == "tsserver available"
    assert got["coverage", "symbols"][1] == "sweep: 1 of 2" and got["coverage", "refs"][1] == "on-demand: 1 of 1" and ("coverage", "defs") not in got
    assert got["enricher", "git"][1] == "rows: 3" and len([k for k in got if k[0] == "fidelity"]) == 6


def test_warn_and_fail(spark):
    rows = SOUND | {
        "tools": [("git", True, False, "get git"), ("rg", None, None, "get rg"), (None, True, False, "x")], "files": [(2, f"f{i}") for i in range(50_001)],
        "analyzers": [("ts", "lsp", None, False, ["refs"]), ("c", None, None, None, None), ("rust", "ra", "ra", True, ["diagnostics"]), (None, "x", "x", True, None)],
        "analyzer_runs": [(2, "defs", "failed"), (2, None, "success")], "enrichers": [(2, "git", False, 3), (2, "markdown", True, 0), (2, None, True, 1)],
    }
    got = see(spark, error="line 3", **rows)
    check = {n: s for (part, n), (s, _, _) in got.items() if part == "check"}
    assert check == {"git": "fail", "rg": "warn", "database": "pass", "repo-size": "warn", "analyzer-registry": "warn", "ts:lsp": "warn", "c:registry": "warn", "rust:ra": "pass"}
    fidelity = {n: s for (part, n), (s, _, _) in got.items() if part == "fidelity"}
    assert fidelity == {"structural": "pass", "hotspot": "fail", "flowHeuristics": "fail", "symbolNavigation": "fail", "semanticRefs": "fail", "diagnostics": "warn"}
    said = {n: m for (part, n), (_, m, _) in got.items() if part == "recommendation"}
    assert set(said) == {"semantic", "git", "rg", "repo-size", "analyzer-registry"} and said["semantic"] == D.UNVERIFIED and said["git"] == "git: get git"
    assert got["enricher", "git"][0] == "fail" and got["enricher", "markdown"][0] == "warn"
    assert got["coverage", "defs"][:2] == ("fail", "sweep: 0 of 1")
    rows["analyzers"] = []
    assert see(spark, **rows)["recommendation", "semantic"][:2] == ("fail", D.DEGRADED)


def test_nothing_to_look_at(spark):
    got = see(spark)
    assert {n: s for (part, n), (s, _, _) in got.items() if part == "check"} == {"database": "warn", "repo-size": "pass", "analyzer-registry": "pass"}
    assert {s for (part, _), (s, _, _) in got.items() if part == "fidelity"} == {"fail"} and got["recommendation", "structural"][1] == D.NO_INDEX
    assert see(spark, enrichers=[(1, "git", True, 4)])["enricher", "git"][:2] == ("warn", "no completed run yet")


@pytest.mark.parametrize(("scope", "want"), [("repo", {"git", "rg", "database"}), ("perf", {"repo-size", "database"}), ("semantic", {"ts:lsp", "analyzer-registry"})])
def test_scopes(spark, scope, want):
    got = see(spark, scope=scope, **SOUND)
    assert {n for part, n in got if part == "check"} == want
    assert "python" in {r["tool"] for r in D.tools_here(spark, {"python": (True, "x")}).where("found").collect()}
