"""Symbols at the linker against the rule applied to every pair."""

from __future__ import annotations

import random
import re

from quarry.operators import abi
from quarry.operators.symbol_trees import unused_of

FORMS = [
    ("C/C++", "int {n}(void) {{", True, True), ("C/C++", "int {n}(void);  ", False, True), ("C/C++", "static int {n};", False, False), ("C/C++", "int {n} = 3;", True, True), ("C/C++", "", True, True),
    ("Rust", 'pub extern  "C" fn {n}()', True, True), ("Rust", "fn {n}()", False, False), ("Zig", "export fn {n}()", True, True), ("Zig", "extern fn {n}();", False, True), ("Zig", "fn exports_{n}()", False, False),
    ("Python", "def {n}():", False, False), (None, "export {n}", False, False),
]


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    symbols, units, known = [], [], {}
    for i in range(300):
        language, form, export, member = rng.choice(FORMS)
        name, kind, above, refs = f"n{rng.randrange(25)}", rng.choice(["Function", "Function", "Variable", "Struct"]), rng.randrange(6), rng.choice([None, 0, 1, 50])
        lines = [""] * 5
        if rng.random() < 0.5 and above:
            lines[5 - above] = "  #[ no_mangle ] // kept"
            if language == "Rust" and above <= 3:
                export = member = True
        units.append((f"f{i}", "\n".join([*lines, form.format(n=name), "x"])))
        symbols.append((i, name, kind, language, f"f{i}", 5, refs))
        if member and kind != "Struct":
            known[i] = (name, language, export, refs)
    schema = "symbol_id int, name string, kind string, language string, path string, line int, external_refs int"
    found = abi.participants(spark.createDataFrame(symbols, schema), spark.createDataFrame(units, "path string, text string"))
    assert {r["symbol_id"]: r["export"] for r in found.collect()} == {i: k[2] for i, k in known.items()}
    good = {n for n in {k[0] for k in known.values()} if len({k[1] for k in known.values() if k[0] == n}) > 1 and any(k[2] for k in known.values() if k[0] == n)}
    pairs = {(j, i) for i, a in known.items() for j, b in known.items() if a[0] == b[0] and a[0] in good and a[1] != b[1]}
    assert {tuple(r) for r in abi.single_edges(found).collect()} == pairs
    want = {i: (n := sum(j == i for _, j in pairs), max(n, known[i][3] or 0)) for i in {i for _, i in pairs}}
    assert {r["symbol_id"]: (r["foreign"], r["external_refs"]) for r in abi.abi_references(found).collect()} == want
    edges = abi.abi_edges(found).collect()
    assert len(edges) == len({(r["src"], r["family"]) for r in edges}) and sum(r["weight"] for r in edges) == len(pairs)
    one = spark.createDataFrame([(min(good),)], "name string")
    assert {tuple(r) for r in abi.single_edges(found, one).collect()} == {p for p in pairs if known[p[0]][0] == min(good)}


def test_what_the_linker_uses_is_not_unused(spark):
    answer = [("a.zig#0", "a.zig", "start", "export fn start() void {"), ("b.c#0", "b.c", "start", "void start(void);"), ("c.zig#0", "c.zig", "gone", "export fn gone() void {")]
    r = {"start": {"line": 0, "character": 0}, "end": {"line": 1, "character": 0}}
    schema = "symbol_id string, path string, name string, kind string, language string, line int, external_refs long, range struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>, selection struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>"
    counted = spark.createDataFrame([(i, p, n, "Function", "C/C++" if p.endswith("c") else "Zig", 0, 0, r, None) for i, p, n, _ in answer], schema)
    units = spark.createDataFrame([(p, t) for _, p, _, t in answer], "path string, text string")
    assert {x["symbol_id"] for x in unused_of(counted, units).collect()} == {i for i, *_ in answer}
    raised = abi.with_abi_references(counted, abi.abi_references(abi.participants(counted, units)))
    assert [(x["symbol_id"], x["rule_id"]) for x in unused_of(raised, units).collect()] == [("c.zig#0", "unused-export")]


def test_lines_that_are_not_there(spark):
    symbols = spark.createDataFrame([(1, "x", "Function", "C/C++", "gone.c", None, None), (2, "x", "Function", "Zig", "gone.zig", 9, None)], "symbol_id int, name string, kind string, language string, path string, line int, external_refs int")
    found = abi.participants(symbols, spark.createDataFrame([("gone.zig", None)], "path string, text string"))
    assert [(r["symbol_id"], r["export"]) for r in found.collect()] == [(1, True)]  # a C name without a line is taken for a definition
    assert abi.abi_references(found).count() == 0 and re.search(abi.NO_MANGLE, "#[no_mangle]")
