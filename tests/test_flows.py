"""Flow detection on small repositories."""

from __future__ import annotations

import json

import pytest

from quarry.operators.flows import MOST_EVIDENCE, MOST_NODES, UserSignals, detect_flows, within_scope


def units(spark, files, repo="r"):
    return spark.createDataFrame([(repo, f"unit:{p}" if p else None, p, t) for p, t in files], "repo string, key string, path string, text string")


def symbols(spark, rows):
    return spark.createDataFrame([("r", f"unit:{p}", p, n, k) for p, n, k in rows], "repo string, key string, path string, name string, kind string")


def by_label(flows):
    return {r["label"]: r for r in flows.collect()}


def test_weak_evidence_alone_gives_no_flow(spark):
    files = units(spark, [("src/index.ts", "x"), ("a.ts", "emitter.on('x')"), ("package.json", "not json"), (None, None), ("b.ts", None)])
    assert by_label(detect_flows(files, symbols(spark, [("a.ts", "routeHandler", "Function")]))) == {}
    assert by_label(detect_flows(units(spark, []))) == {}


@pytest.mark.parametrize(("files", "confidence"), [
    ([("a.ts", "app.get('/x')\n  Router.POST('/y')")], 0.5),
    ([("a.ts", "app.get('/x')"), ("app/x/route.ts", "")], 0.7),
    ([("a.ts", "app.get('/x')"), ("app/x/route.ts", ""), ("package.json", json.dumps({"devDependencies": {"Express": "1", "koa": "2"}}))], 0.9),
])
def test_confidence_by_kinds(spark, files, confidence):
    got = by_label(detect_flows(units(spark, files), symbols(spark, [("s.ts", "UserController", "Class"), ("s.ts", "route", "Variable"), ("tests/t.ts", "endpoint", "Function")])))
    assert set(got) == {"http-routes"}
    r = got["http-routes"]
    assert (r["key"], r["kind"], r["confidence"]) == ("flow:http-routes", "request", confidence)
    assert r["evidence"][-1] == "symbol: UserController (Class) in s.ts" and r["nodes"][0] == "unit:a.ts" and r["nodes"][-1] == "unit:s.ts"
    if confidence == 0.9:
        assert r["evidence"][:2] == ["dependency: web framework (express)", "a.ts: app.get('/x')"]


def test_tests_and_fixtures_are_no_application(spark):
    files = [("src/a.test.ts", "app.get('/')"), ("tests/b.ts", "new Worker(x)"), ("x/fixtures/route.ts", "yargs"), ("__tests__/worker.ts", "extends EventEmitter")]
    assert by_label(detect_flows(units(spark, files))) == {}


def test_a_users_patterns_count_once_and_come_last(spark):
    user = UserSignals({"queue-workers": ("Celery",)}, {"queue-workers": (r"@task", r"delay\("), "cli-commands": (r"argparse",)})
    files = [("a.py", "@task\nx.delay(1)\n" + "@TASK" + "z" * 300), ("package.json", json.dumps({"dependencies": {"celery": "5"}, "bin": {"x": "y"}}))]
    got = by_label(detect_flows(units(spark, files), user=user))
    queue = got["queue-workers"]
    assert queue["confidence"] == 0.7  # a dependency and the patterns
    assert queue["evidence"][:2] == ["dependency: queue/job library (celery)", "config-pattern: a.py: @task"] and queue["evidence"][-1] == "config-pattern: a.py: x.delay(1)"
    assert max(map(len, queue["evidence"])) == 120
    assert got["cli-commands"]["confidence"] == 0.5 and got["cli-commands"]["evidence"] == ["package.json: bin entry"] and got["cli-commands"]["nodes"] == []


def test_commands_once_a_file_and_repositories_apart(spark):
    files = units(spark, [("a.ts", "process.argv\nyargs"), ("src/commands/b.ts", ""), ("src/cli.ts", "")]).unionByName(units(spark, [("a.ts", "nothing"), ("q.worker.ts", "")], "other"))
    got = {(r["repo"], r["label"]): r for r in detect_flows(files).collect()}
    assert set(got) == {("r", "cli-commands"), ("other", "queue-workers")}
    assert got["r", "cli-commands"]["evidence"] == ["a.ts: process.argv", "command file: src/commands/b.ts", "file: src/cli.ts"]


def test_caps_and_scopes(spark):
    files = units(spark, [(f"z{i % 2}/f{i:02}.ts", "new Queue(x)\nnew Queue(y)") for i in range(30)])
    flows = detect_flows(files)
    r = by_label(flows)["queue-workers"]
    assert len(r["nodes"]) == MOST_NODES and len(r["evidence"]) == MOST_EVIDENCE and r["nodes"] == [f"unit:z0/f{i:02}.ts" for i in range(0, 20, 2)]
    assert by_label(within_scope(flows, "zone:z1")) == {}
    one = by_label(within_scope(flows, "unit:z0/f02.ts"))["queue-workers"]
    assert one["nodes"] == ["unit:z0/f02.ts"] and one["evidence"] == ["z0/f02.ts: new Queue(x)", "z0/f02.ts: new Queue(y)"]
    late = by_label(within_scope(flows, "unit:z0/f18.ts"))["queue-workers"]  # its evidence is beyond the first ten
    assert late["nodes"] == ["unit:z0/f18.ts"] and late["evidence"] == r["evidence"]
    assert by_label(within_scope(flows, "repo:."))["queue-workers"]["nodes"] == r["nodes"]
