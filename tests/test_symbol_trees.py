"""Nested symbols, their edges and what is unused, against brute force."""

from __future__ import annotations

import json
import random

import pytest

from quarry.operators import symbol_trees as st
from quarry.operators.reports import references


def r(a, b, c=0, d=0):
    return {"start": {"line": a, "character": c}, "end": {"line": b, "character": d}}


def visit(answers):
    """Rows by recursion."""
    out = []

    def each(path, entries, above, parent):
        for i, x in enumerate(entries):
            if not isinstance(x, dict):
                continue
            kind = x.get("kind")
            name = x.get("name", "")
            kind = st.KINDS[kind - 1] if isinstance(kind, int) and 1 <= kind <= len(st.KINDS) else "Variable"
            span = x.get("range") or (x.get("location") or {}).get("range") or r(0, 0)
            out.append((path, (*above, i), name, kind, x.get("containerName", parent), span["start"]["line"], span["end"]["character"]))
            if isinstance(x.get("children"), list):
                each(path, x["children"], (*above, i), name)

    for path, answer in answers:
        if isinstance(answer, list):
            each(path, answer, (), None)
    return sorted(out, key=str)


def flat(symbols):
    return sorted(((x["path"], tuple(x["place"]), x["name"], x["kind"], x["container"], x["range"]["start"]["line"], x["range"]["end"]["character"]) for x in symbols.collect()), key=str)


def tree(rng, depth):
    x = {"name": f"n{rng.randrange(99)}", "kind": rng.randrange(-1, 30)}
    if rng.random() < 0.8:
        x["range"] = r(rng.randrange(50), 60, 1, rng.randrange(9))
    if depth and rng.random() < 0.8:
        x["children"] = [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return x


def test_trees_of_any_depth(spark):
    rng = random.Random(1)
    answers = [(f"f{i}.ts", [tree(rng, rng.randrange(7)) for _ in range(rng.randrange(4))]) for i in range(30)]
    got = st.symbols_of(spark.createDataFrame([(p, json.dumps(a)) for p, a in answers], "path string, json string"))
    assert flat(got) == visit(answers)
    assert len({x["symbol_id"] for x in got.collect()}) == got.count()


def test_odd_answers(spark):
    answers = [
        ("flat", [{"name": "a", "kind": 12, "containerName": "box", "location": {"uri": "u", "range": r(3, 4, 1, 2)}}]),
        ("gaps", [None, 5, "x", [], {}, {"kind": "12"}, {"name": "b", "kind": 4, "children": None}, {"name": "c", "children": {"name": "no list"}}, {"name": "d", "containerName": None, "children": [{"name": "e", "containerName": "own"}]}]),
        ("object", {"name": "no list"}), ("empty", []),
    ]
    rows = [(p, json.dumps(a)) for p, a in answers] + [("broken", "[{\"name\": "), ("null", None), ("text", "hello")]
    got = {(x["path"], tuple(x["place"])): x for x in st.symbols_of(spark.createDataFrame(rows, "path string, json string")).collect()}
    assert got["flat", (0,)]["container"] == "box" and got["flat", (0,)]["kind"] == "Function" and got["flat", (0,)]["range"]["start"]["line"] == 3 and got["flat", (0,)]["selection"] is None
    assert {k for k in got if k[0] == "gaps"} == {("gaps", (i,)) for i in (4, 5, 6, 7, 8)} | {("gaps", (8, 0))}
    assert got["gaps", (8, 0)]["container"] == "own" and got["gaps", (4,)]["kind"] == "Variable" and got["gaps", (4,)]["name"] == "" and got["gaps", (6,)]["kind"] == "Package"
    assert {k[0] for k in got} <= {"flat", "gaps", "broken"}
    assert st.symbols_of(spark.createDataFrame([], "path string, json string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_smallest_enclosing_range(spark, seed):
    rng = random.Random(seed)
    symbols, places = [], []
    for path in ("a", "b", "c"):
        for i in range(60):
            a = (rng.choice([rng.randrange(40), rng.randrange(5000)]), rng.randrange(5))
            b = (a[0] + rng.choice([0, 1, 3, 70, 3000, 2_000_000_000]), rng.randrange(5))
            symbols.append((path, f"{path}#{i}", [i], f"n{i}", "Class", None, "high", r(*(a[0], b[0], a[1], b[1])), None))
        places += [(f"{path}#{rng.randrange(60)}", path, rng.choice([rng.randrange(60), rng.randrange(6000)]), rng.randrange(5)) for _ in range(150)]
    schema = f"path string, symbol_id string, place array<int>, name string, kind string, container string, signal string, range {st._RANGE}, selection {st._RANGE}"
    df = spark.createDataFrame(symbols, schema)
    refs = spark.createDataFrame(places, "target_id string, path string, line int, character int")
    want = set()
    for target, path, line, character in places:
        inside = []
        for s in symbols:
            a, b = ((s[7][k]["line"], s[7][k]["character"]) for k in ("start", "end"))
            if s[0] == path and a <= (line, character) <= b:
                inside.append(((b[0] - a[0]) * 10_000 + b[1] - a[1], s[2], s[1]))
        if inside and min(inside)[2] != target:
            want.add((min(inside)[2], target))
    edges = st.symbol_edges_of(df, refs)
    assert set(map(tuple, edges.collect())) == want and edges.count() == len(want)


def test_unused_symbols_and_the_ladder(spark):
    answer = [
        {"name": "Box", "kind": 5, "range": r(0, 9), "selectionRange": r(0, 0, 13, 16), "children": [{"name": "open", "kind": 6, "range": r(2, 4), "selectionRange": r(2, 2, 2, 6)}]},
        {"name": "lost", "kind": 12, "range": r(11, 12)}, {"name": "not one", "kind": 12, "range": r(13, 13)}, {"name": "unasked", "kind": 12, "range": r(14, 14)},
    ]
    text = "export class Box {\n\n  open() {\n  }\n" + "\n" * 7 + "function lost() {\n}\n"
    tests = [{"name": "helper", "kind": 12, "range": r(0, 1)}]
    symbols = st.symbols_of(spark.createDataFrame([("a.ts", json.dumps(answer)), ("tests/t.ts", json.dumps(tests))], "path string, json string"))
    asked = spark.createDataFrame([(f"a.ts#{i}",) for i in ("0", "0.0", "1", "2")] + [("tests/t.ts#0",), ("a.ts#1",)], "target_id string")
    refs = spark.createDataFrame(
        [("a.ts#0", "a.ts", 0, 13), ("a.ts#0.0", "a.ts", 2, 2), ("a.ts#0.0", "tests/t.ts", 0, 5), ("a.ts#0.0", "tests/t.ts", 0, 9), ("a.ts#0.0", "a.ts", 50, 0), ("a.ts#1", "a.ts", 11, 0)],
        "target_id string, path string, line int, character int",
    )
    counted = st.counted_references(symbols, asked, refs)
    assert {x["symbol_id"]: x["external_refs"] for x in counted.collect()} == {"a.ts#0": 0, "a.ts#0.0": 3, "a.ts#1": 0, "a.ts#2": 0, "a.ts#3": None, "tests/t.ts#0": 0}
    found = st.unused_of(counted, spark.createDataFrame([("a.ts", text)], "path string, text string"))
    assert {(x["name"], x["rule_id"], x["line"], x["severity"]) for x in found.collect()} == {("Box", "unused-export", 1, "warning"), ("lost", "unused-symbol", 12, "info")}
    edges = st.symbol_edges_of(symbols, refs)
    assert {tuple(x) for x in edges.collect()} == {("tests/t.ts#0", "a.ts#0.0")}
    named = st.references_of(edges, symbols)
    source, rows = references(named, symbols, "OPEN")
    assert source == "indexed-edges" and [x["path"] for x in rows.collect()] == ["tests/t.ts"]
    assert references(named, symbols, "lost")[0] == "indexed-symbols"


def test_ranges_are_read_once_and_levels_are_asked_for_by_few(spark):
    """A range's text is parsed once; places within narrow ranges look at no levels, also across a border of large blocks; wide ranges and long lines stay right."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"start":{"line":1,"character":2},"end":{"line":3,"character":4}}',), ('{"start":{"line":1}}',), ("5",), (None,)], "j string")
    got = df.select(st._range(F.col("j")).alias("r"))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
    assert [x["r"] and x["r"]["end"]["character"] for x in got.collect()] == [4, None, None, None]
    schema = f"path string, symbol_id string, place array<int>, name string, kind string, container string, signal string, range {st._RANGE}, selection {st._RANGE}"
    row = lambda i, *at: ("a", f"a#{i}", [i], "n", "Class", None, "high", r(*at), None)
    edge = 1 << 20
    refs = spark.createDataFrame([("a#9", "a", line, 5) for line in (edge - 1, edge, edge + 1, edge + 50)] * 2, "target_id string, path string, line int, character int")
    narrow = st.enclosing(spark.createDataFrame([row(0, edge - 1, edge, 0, 9)], schema), refs)
    assert "sequence(" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x["line"], x["inner"]) for x in narrow.collect()) == [(edge - 1, "a#0"), (edge, "a#0")]
    both = st.enclosing(spark.createDataFrame([row(0, edge - 1, edge, 0, 900_000), row(1, edge - 40, edge + 40, 0, 9)], schema), refs)
    assert sorted((x["line"], x["inner"]) for x in both.collect()) == [(edge - 1, "a#1"), (edge, "a#1"), (edge + 1, "a#1")]


def test_json_is_read_once_and_lines_are_no_rows(spark, monkeypatch):
    """Three levels of well-formed answers are one round, and deeper ones and others are as before; Spark repeats no reading of JSON in a filter."""
    leaf = lambda n, *children: {"name": n, "kind": 12, "range": {"start": {"line": 1, "character": 0}, "end": {"line": 2, "character": 3}}, **({"children": list(children)} if children else {})}
    good, deep = [leaf("a", leaf("b", leaf("c")), leaf("d"))], [leaf("a", leaf("b", leaf("c", leaf("e", leaf("f")))))]
    odd = [leaf("a", {**leaf("b", leaf("c")), "kind": "6"}, None, leaf("d")), leaf("g", {**leaf("h"), "range": "none"}, 7, leaf("i"))]
    from pyspark.sql import functions as F

    rounds, plans, keep = [], [], st.stored
    monkeypatch.setattr(st, "stored", lambda df, name: rounds.append(name) or plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    read = lambda answer: [(x["name"], x["place"], x["kind"], x["container"], x["range"]["end"]["character"]) for x in sorted(st.symbols_of(spark.createDataFrame([("p", json.dumps(answer))], "path string, json string")).collect(), key=lambda x: x["place"])]
    assert [x[:2] for x in read(good)] == [("a", [0]), ("b", [0, 0]), ("c", [0, 0, 0]), ("d", [0, 1])] and rounds == ["symbols"]
    assert not any("Filter" in line and "from_json" in line for line in plans[0].split("\n"))
    assert [x[0] for x in read(deep)] == ["a", "b", "c", "e", "f"]
    assert read(odd) == [
        ("a", [0], "Function", None, 3), ("b", [0, 0], "Method", "a", 3), ("c", [0, 0, 0], "Function", "b", 3), ("d", [0, 2], "Function", "a", 3),
        ("g", [1], "Function", None, 3), ("h", [1, 0], "Function", "g", 0), ("i", [1, 2], "Function", "g", 3),
    ]
    symbols = spark.createDataFrame([("p", "p#0", "x", 1, 0)], "path string, symbol_id string, name string, line int, external_refs long").withColumn("selection", F.struct(F.struct("line").alias("start"))).withColumn("range", F.col("selection"))
    found = st.unused_of(symbols, spark.createDataFrame([("p", "a\nexport b\nc")], "path string, text string"))
    assert [tuple(x)[:5] for x in found.collect()] == [("unused-export", "p", "p#0", "x", 2)]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
