"""Every query against its SQL on the smallest tables, and the building blocks on small fixtures."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import scalars as S
from quarry.operators.related import mention_pairs
from quarry.operators.texts import LOG, parse_log, sections
from quarry.plans.graphs import strong_components, widest_paths
from quarry.plans.store import GraphStore
from quarry.sources import filesystem as fs
from quarry.streaming.events import windowed_activity

DATA = "/root/testdata/sf0.001"


#: Queries whose order is part of the answer.
ORDERED = (
    "language_summary", "hotspot_score_topk", "children_by_metric", "cochange_top500", "definitions", "atoms", "vector_find", "vector_neighbors", "zones_order", "zones_filtered", "evidence_order",
    "run_list", "findings_list", "flow_caps", "positions", "related_ranked", "node_lookup",
)


def rows(df: pd.DataFrame, order: bool = False) -> list[tuple]:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "None"
        if isinstance(v, float):
            return f"{v:.6g}" if not v.is_integer() else str(int(v))
        return str(int(v)) if type(v).__name__.startswith(("int", "bool", "uint")) else str(v)

    out = [tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()]
    return out if order else sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert name in catalog.ORACLE_SQL
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, name in ORDERED) == rows(want, name in ORDERED)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


RING = [(i, i % 60 + 1) for i in range(1, 61)]


@pytest.mark.parametrize("small", [1_000_000, 0])
@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(1, 2), (2, 3)], []),
        ([(1, 2), (2, 1), (2, 3)], [(1, 1), (2, 1)]),
        ([(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (5, 6)], [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]),
        ([(1, 1), (1, 2)], []),
    ],
)
def test_strong_components(spark, edges, want, small):
    got = strong_components(spark.createDataFrame(edges, "src long, dst long"), small=small).collect()
    assert sorted(map(tuple, got)) == want


def test_ring_in_one_task(spark):
    assert strong_components(spark.createDataFrame(RING, "src long, dst long")).count() == 60


def test_a_large_component_is_linear():
    """A component's nodes are compared a few times each, not all with all."""
    from quarry.plans.graphs import _tarjan

    class Node(int):
        compared = 0
        __hash__ = int.__hash__

        def __lt__(self, other):
            Node.compared += 1
            return int(self) < int(other)

    n = 2000
    nodes = [Node(i) for i in range(n)]
    ring = pd.DataFrame({"src": pd.Series(nodes, dtype=object), "dst": pd.Series(nodes[1:] + nodes[:1], dtype=object)})
    got = _tarjan(ring)
    assert len(got) == n and set(got["component"]) == {0} and Node.compared < 20 * n


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_widest_paths(spark, small):
    e = spark.createDataFrame([("i", "a", 1.0), ("a", "b", 0.5), ("i", "c", 1.0), ("c", "b", 1.0), ("c", "d", 0.5), ("x", "y", 1.0)], "src string, dst string, confidence double")
    got = dict(map(tuple, widest_paths(e, spark.createDataFrame([("i",)], "node string"), small=small).collect()))
    assert got == {"i": 1.0, "a": 1.0, "b": 1.0, "c": 1.0, "d": 0.5}


def test_scalars(spark):
    one = spark.range(1).select(
        S.line_count(F.lit("a\nb")).alias("a"), S.line_count(F.lit("a\n")).alias("b"), S.line_count(F.lit("")).alias("c"),
        S.slugify(F.lit("Hello, World!")).alias("d"), S.normalize_path(F.lit("a/./b/../c")).alias("e"), S.normalize_path(F.lit("../x")).alias("f"),
        S.package_name(F.lit("@s/p/x")).alias("g"), S.layer_of(F.lit("src/core/x.ts"), ["ui", "core"]).alias("h"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0))).alias("i"), S.risk_level(F.lit(0.8), F.lit(0), F.lit(0), F.lit(0)).alias("j"),
        S.code_tokens(F.lit("a = 'x y'; // no\n/* c */ b")).alias("k"), S.zone_of(F.lit("README")).alias("l"), S.confidence_from_strong(F.lit(2)).alias("m"),
    ).first()
    assert tuple(one) == (2, 1, 0, "hello-world", "a/c", None, "@s/p", 1, 0.0, "high", ["a", "=", "'x y'", ";", "b"], None, 0.7)


def test_code_tokens(spark):
    texts = ['u = "http://x" // c', "/* a\n// b */ x`a\n${b}`", "'it\\'s' /* open", '"' + "\\x" * 30_000, "a_1$+=b\f", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.code_tokens(F.col("t"))).collect()]
    assert got == [["u", "=", '"http://x"'], ["x", "`a\n${b}`"], ["'it\\'s'"], [texts[3]], ["a_1$", "+", "=", "b", "\f"], []]


def test_kinds_of_paths_and_names(spark):
    paths = {"src/a.test.ts": (True, "markdown"), "spec/x.ts": (False, "markdown"), "a/__tests__/b.py": (True, "markdown"), "specs/notes.md": (False, "markdown"), "docs/PRD.md": (False, "spec"), "README.MDX": (False, "readme"), "adr/x.md": (False, "markdown"), "0001-adr.md": (False, "adr")}
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.is_test_path(F.col("p")), S.classify_doc(F.col("p"))).collect()}
    assert got == paths
    names = {("Variable", "row"): "low", ("Variable", "total"): "high", ("Function", "row"): "high", ("Function", "a.b"): "low", ("Property", "data"): "low", ("Class", "map() callback"): "low"}
    got = {(r[0], r[1]): r[2] for r in spark.createDataFrame(list(names), "k string, n string").select("k", "n", S.symbol_signal(F.col("k"), F.col("n"))).collect()}
    assert got == names and len(S.LOW_SIGNAL_NAMES) == 42
    got = spark.createDataFrame([('{"start":{"line":3,"character":4}}',), ('{"start":',), ("{}",), (None,)], "r string").select(S.parse_range(F.col("r"))["line"]).collect()
    assert [r[0] for r in got] == [3, None, None, None]
    assert [r[0] for r in spark.createDataFrame([("a\nexport b", 1), ("exported", 0), ("x", 7)], "t string, n int").select(S.on_line(F.col("t"), F.col("n"))).collect()] == [True, False, False]



def test_globs():
    import re

    assert re.match(S.glob_to_regex("src/**/*.ts"), "src/a/b/c.ts") and re.match(S.glob_to_regex("src/**/*.ts"), "src/c.ts")
    assert not re.match(S.glob_to_regex("src/*.ts"), "src/a/c.ts") and re.match(S.glob_to_regex("*.{js,ts}"), "a.ts")


def test_tree_imports_and_symbols(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "node_modules" / "x" / "i.js").write_text("no")
    (tmp_path / "src" / "a.ts").write_text("import { b } from './b'\nconst c = await import('./c')\nexport function run() {}\n")
    (tmp_path / "src" / "b.ts").write_text("export class Bee {}\n")
    (tmp_path / "src" / "c.ts").write_text("#!/usr/bin/env bun\n")
    (tmp_path / "package.json").write_text('{"dependencies": {"Left-Pad": "1"}, "devDependencies": {"x": "2"}}')
    units = fs.read_tree(spark, str(tmp_path)).cache()
    assert sorted(r[0] for r in units.select("path").collect()) == ["package.json", "src/a.ts", "src/b.ts", "src/c.ts"]
    edges = fs.resolve_imports(fs.imports(units), units)
    assert sorted(map(tuple, edges.collect())) == [("src/a.ts", "src/b.ts", 1.0), ("src/a.ts", "src/c.ts", 0.5)]
    assert {("src/b.ts", "Class", "Bee"), ("src/a.ts", "Function", "run")} <= set(map(tuple, fs.heuristic_symbols(units).drop("signal").collect()))
    assert sorted(map(tuple, fs.manifest_packages(units).select("name", "section").collect())) == [("left-pad", "dependencies"), ("x", "devDependencies")]
    e = {r["path"]: r["entrypoint"] for r in fs.entrypoints(units, ["src/b.*"]).collect()}
    assert e == {"package.json": None, "src/a.ts": None, "src/b.ts": "true", "src/c.ts": "inferred"}
    assert fs.scan(units, "EXPORT").count() == 2


def test_sources_by_their_rules(spark, tmp_path):
    files = {
        "out/a.ts": "", ".turbo/x": "", "src/a/b.gen.ts": "", "src/[id]/page.tsx": "export default 1", "pages/x.ts": "", "data.bin": "#!", "run.ts": "#!/usr/bin/env x", "bin/cli.js": "", "lib/m.mjs": "",
        "package.json": '{"bin": {"c": "./bin/cli.js"}, "main": "lib/m.mjs", "module": "./bin/cli.js"}', "sub/p.csproj": "", "p.csproj": "", "build.gradle": "",
        "s.sh": "source 'lib/x.sh'\n. ./y.sh # z\n# source no\n", "t.ts": "const a = 1\n. ./x\nimport type { A } from './types'\nexport * from './all'\nrequire('./req')\n",
        "c.c": "#define MAX 1\nstruct node { int x; };\nenum color { A };\nint add(int a) {\n  if (a) { return a; }\n}\ntypedef struct node node_t;\n",
        "k.ts": "export type Id = string\nexport abstract class Big {\n  async load(x) {\n  }\n  if (x) {}\n}\nconst low = 1\n", "f.bash": "function go {\n}\nrun () {\n}\n",
        "e.php": "", "e.kt": "", "e.mdx": "", "e.cxx": "", "e.cs": "", "e.none": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    units = fs.read_tree(spark, str(tmp_path), globs=["src/*.gen.ts"]).cache()
    seen = {r["path"]: r["language"] for r in units.collect()}
    assert set(seen) == set(files) - {"out/a.ts", ".turbo/x", "src/a/b.gen.ts"}
    assert [seen[f"e.{x}"] for x in ("php", "kt", "mdx", "cxx", "cs", "none")] == ["PHP", "Kotlin", "Markdown", "C/C++", "C#", "Other"]
    assert {r["path"] for r in units.where("is_manifest").collect()} == {"package.json", "p.csproj", "build.gradle"}
    found = {(r["path"], r["specifier"]) for r in fs.imports(units).collect()}
    assert found == {("s.sh", "lib/x.sh"), ("s.sh", "./y.sh"), ("t.ts", "./types"), ("t.ts", "./all"), ("t.ts", "./req")}
    why = {r["path"]: r["entrypoint_reason"] for r in fs.entrypoints(units, []).where("entrypoint is not null").collect()}
    assert why == {"bin/cli.js": "package.json bin", "lib/m.mjs": "package.json main", "src/[id]/page.tsx": "route convention", "run.ts": "shebang CLI"}
    symbols = {(r["path"], r["kind"], r["name"]) for r in fs.heuristic_symbols(units).collect()}
    assert {x for x in symbols if x[0] == "c.c"} == {("c.c", *x) for x in (("Constant", "MAX"), ("Struct", "node"), ("Enum", "color"), ("Function", "add"), ("Typedef", "node_t"))}
    assert {x[1:] for x in symbols if x[0] == "k.ts"} == {("TypeParameter", "Id"), ("Class", "Big"), ("Method", "load"), ("Variable", "low")}
    assert {x[1:] for x in symbols if x[0] == "f.bash"} == {("Function", "go"), ("Function", "run")}


def test_head_of_a_work_tree(tmp_path):
    import subprocess

    assert fs.read_head(str(tmp_path)) == (None, None)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-m", "one")
    head, dirty = fs.read_head(str(tmp_path))
    assert len(head) == 40 and dirty is False
    (tmp_path / "a").write_text("2")
    assert fs.read_head(str(tmp_path)) == (head, True)


def test_definitions_ladder(spark):
    from quarry.operators.listings import definitions_ladder

    names = spark.createDataFrame([("Walk", "b.ts"), ("run", "c.ts")], "name string, path string")
    none, some = names.limit(0), names.limit(1)

    def down(_):
        raise OSError("no server")

    got = [definitions_ladder(names, "RUN", live, only)[:2] for live, only in ((lambda n: some, False), (lambda n: none, False), (down, False), (down, True), (None, False))]
    assert got == [("semantic", False), ("indexed", True), ("indexed", True), ("indexed", False), ("indexed", True)]
    assert [r["path"] for r in definitions_ladder(names, "RUN")[2].collect()] == ["c.ts"]


def test_issues_and_history(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"id": "1", "title": "t", "status": "open", "priority": 2, "dependencies": [{"depends_on_id": "2"}]}, {"id": "3"}]')
    got = fs.read_issues(spark, str(tmp_path / "i.json")).collect()
    assert [(r["id"], r["depends_on"]) for r in got] == [("1", ["2"])]
    assert fs.read_history(spark, str(tmp_path)).count() == 0


def test_sections_and_log(spark):
    t = spark.createDataFrame([(1, "x\n# A\nb\n# C"), (2, "")], "id long, text string")
    got = sorted(map(tuple, sections(t, "^# ").collect()), key=str)
    assert got == [(1, 0, None, "x"), (1, 1, "# A", "b"), (1, 2, "# C", ""), (2, 0, None, "")]
    assert parse_log(spark.createDataFrame(list(LOG), "n int, tool string, line string")).where("message like '%declared here'").count() == 1


def test_sections_of_long_texts(spark, tmp_path):
    """Against a loop over the lines: texts below, at and far above 4000 characters, none at all, and many headings."""
    import re

    from quarry.operators.texts import markdown_sections

    long = "before\n" + "".join(f"The {i}. Head, of {i}!\n" + f"  line {i}\n\n" * (i % 7) for i in range(3000))
    texts = ["The a\nb", "x" * 3995 + "\nThe", "The b\n" + "y" * 4000, "The end\n" + "z\n" * 9000 + "The last", long, "no heading", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(texts):
        found = []
        for line in (text or "").split("\n"):
            if line.startswith("The "):
                found.append((line, []))
            elif found and line.strip(" "):
                found[-1][1].append(line.strip(" "))
        slug = lambda x: re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", x.lower()))
        want += [(i, k + 1, slug(title), " ".join(body[:4])[:500]) for k, (title, body) in enumerate(found)]
    got = markdown_sections(spark, str(tmp_path)).collect()
    assert len(want) == 3004 and sorted(map(tuple, got)) == sorted(want)


def test_graphs_of_whole_tables(spark, tmp_path):
    """Against brute force on tables of which the former filters on ids, sizes and first characters kept nothing or too little."""
    from quarry.operators import graph, reports, symbols, texts

    part = [(i, f"n{i % 4}", f"Brand#{i % 3}", ["SMALL", "MEDIUM", "PROMO"][i % 5 % 3], 5 + 5 * (i % 7)) for i in range(1, 40)]
    orders = [(i, i % 4, "O" if i % 3 else "F") for i in range(1, 16)]
    line = [(o, n, (o * 5 + n * 4) % 39 + 1, 48.0 if n % 2 else 3.0, "N" if o % 2 else "R") for o, _, _ in orders for n in (1, 2, 3)]
    docs = [(1, "s1", "en", "Alpha Head\nsmall\nAlpha Head\nsee the Name of it"), (2, "s1", "fr", "x" * 500 + " parser\nBeta"), (10, "s2", "en", "x" * 500 + " loading"), (11, "s3", "en", "q" * 900 + " load lexer")]
    names = [(7, "the Name"), (8, "none such")]
    for name, rows_, schema in (
        ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string"),
        ("lineitem", line, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string"),
        ("documents", docs, "doc_id long, source string, lang string, text string"), ("benchmark", names, "item_id long, text string"),
    ):
        spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda f, *cols: sorted(map(tuple, f(spark, str(tmp_path)).select(*cols).collect()))

    doc = {i: f"doc:{zone}/{i}.md" for i, zone, _, _ in docs}
    want = {("repo:.", x, "documents") for x in doc.values()} | {(doc[i], f"unit:{k}", "mentions") for i, _, _, t in docs for k, n in names if n in t}
    want |= {(doc[i], f"doc_section:{doc[i]}#{x[:20].lower().replace(' ', '-')}", "contains") for i, _, _, t in docs for x in t.split("\n") if x[:1].isupper()}
    assert run(reports.markdown_graph, "src", "dst", "kind") == sorted(want) and len(want) == 7

    want = {(f"issue:{a}", f"issue:{b}", "depends-on", 1.0) for a, c, _ in orders for b, e, _ in orders if c == e and a > b}
    want |= {(f"issue:{o}", f"unit:{f}", "tracked-by", 2.0 if orders[o - 1][2] == "O" else 1.0) for o, _, f, _, _ in line}
    assert run(reports.issue_graph, "src", "dst", "kind", "weight") == sorted(want)

    held = {o: {x[2] for x in line if x[0] == o} for o, _, _ in orders}
    seed = min(set.union(*held.values()))
    want = [(f, n) for f in range(1, 40) if f != seed and (n := sum(seed in s and f in s for s in held.values()))]
    assert run(reports.related_by_issue, "file", "issues") == want and want

    zone = {p[0]: p[2] for p in part}
    reach = {(zone[a[2]], zone[b[2]]) for a in line for b in line if a[0] == b[0] and b[1] == a[1] + 1 and a[3] >= 47 and a[4] == "N" and zone[a[2]] != zone[b[2]]}
    for _ in range(3):
        reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
    mutual = sorted({frozenset(y for x, y in reach if x == z and (y, z) in reach) for z in zone.values() if (z, z) in reach}, key=min)
    assert run(graph.zone_cycles, "component", "scc_size", "members") == [(min(m), len(m), ",".join(sorted(m))) for m in mutual] and mutual

    family = {"SMALL": "c", "MEDIUM": "rust", "PROMO": "zig"}
    pairs = [(a[0], b[0]) for a in part for b in part if a[1:3] == b[1:3] and family[a[3]] != family[b[3]] and b[4] % 5 == 0]
    assert run(symbols.cross_language_refs, "src", "dst", "external_refs") == sorted((a, b, sum(y == b for _, y in pairs)) for a, b in pairs) and pairs

    assert run(texts.phase_boundaries, "zone", "stages") == [("s1", 2), ("s3", 2)]


def test_mentions_equal_containment(spark):
    """Random names of any characters in random texts, by keys of several lengths."""
    import random

    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab/.é😀 A") for _ in range(n))
    texts = [(i, word(r.randint(0, 60))) for i in range(150)] + [(200, "see foosrc/a.ts"), (201, None), (202, "..."), (202, "x src/a.ts")]
    names = [(k, word(r.randint(1, 6))) for k in range(200)] + [(300, "src/a.ts"), (301, "src/a.ts"), (302, "..."), (303, "a.")]
    want = sorted({(i, k) for i, t in texts for k, n in names if t is not None and len(n) >= 3 and n in t})
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name_id long, name string")
    assert len(want) > 100
    for gram in (12, 4, 3):
        assert sorted(map(tuple, mention_pairs(t, n, gram=gram).collect())) == want
    assert mention_pairs(t, n.limit(0)).count() == 0


def test_mentions_by_blocks(spark, monkeypatch):
    """Texts are cut into blocks side by side, with few names and with many; names of all lengths at all places are found; mentions are made once a query."""
    from quarry.operators import related

    names = [(n, "abcdefghijklmnopqrstuvwxyz0123456789"[:n]) for n in range(3, 36)]
    texts = [(100 * n + k, "é😀" * k + name + "-" * (k % 5)) for n, name in names for k in range(14)]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name_id long, name string")
    want = sorted((i, k) for i, text in texts for k, name in names if name in text)
    for few in (0, related.FEW):
        got = mention_pairs(t, n, few=few)
        assert "?=" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want
    made, keep = [], related.stored
    monkeypatch.setattr(related, "stored", lambda df, name: made.append(name) or keep(df, name))
    related.documented_together(spark, DATA).count()
    assert made == ["mentions"]


def test_rounds_of_graphs(spark, monkeypatch):
    """The last edges are solved by one task, however long their chains; only counted, small sides are broadcast."""
    from quarry.plans import graphs

    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    chain = [(i, i + 1) for i in range(1000, 1015)]
    edges = spark.createDataFrame(ring(0, 12) + ring(20, 9) + [(3, 22)] + ring(40, 2) + ring(50, 2) + [(3, 1000)] + chain, "src long, dst long")
    made, keep = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: made.append(name) or keep(df, name))
    want = {x: a for a, n in ((0, 12), (20, 9), (40, 2), (50, 2)) for x in range(a, a + n)}
    assert dict(map(tuple, graphs.strong_components(edges, small=41).collect())) == want
    assert made.count("edges") == 2
    monkeypatch.setattr(graphs, "FEW", 0)
    few = spark.createDataFrame(ring(0, 3) + ring(5, 2), "src long, dst long")
    assert dict(map(tuple, graphs.strong_components(few, small=0).collect())) == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5}
    plan = edges.join(graphs._near(edges.select("src"), 1), "src")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_mentions(spark):
    t = spark.createDataFrame([(1, "see src/a.ts and b"), (2, "nothing"), (3, None)], "id long, text string")
    n = spark.createDataFrame([(7, "src/a.ts"), (8, "no")], "name_id long, name string")
    assert list(map(tuple, mention_pairs(t, n).collect())) == [(1, 7)]


def test_store(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g")
    for run in (1, 2, 3):
        g.write("runs", spark.createDataFrame([("r", "t" if run < 3 else None)], "repo_root string, completed_at string"), run)
        g.write("nodes", spark.createDataFrame([("unit", "a", "m"), ("unit", "b", f"m{run}")], "kind string, path string, metadata string"), run, key=["kind", "path"])
    g.write("symbols", spark.createDataFrame([("a", "f"), ("b", "g")], "path string, name string"), 1)
    assert g.latest_run("r") == 2 and g.resolve("symbols", "r") == (1, 2)
    assert [r["name"] for r in g.carry("symbols", 1, 2).collect()] == ["f"]
    assert g.prunable(1, g.read("symbols")) == [2]


def test_sarif_log(spark):
    import json

    log = json.loads(fs.sarif_log(catalog.QUERIES["sarif_render"](spark, DATA)))
    assert log["version"] == "2.1.0" and log["runs"][0]["tool"]["driver"]["rules"] == [{"id": "layering-violation"}]


def test_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.write.parquet(f"{tmp_path}/e")
    q = windowed_activity(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("act").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("act").agg(F.sum("n")).first()[0] == e.count()


def test_references_and_analyzers(spark):
    from quarry.operators.reports import references, run_analyzers

    edges = spark.createDataFrame([("Run", "a.ts")], "to_name string, path string")
    names = spark.createDataFrame([("Walk", "b.ts"), ("run", "c.ts")], "name string, path string")

    def down(_):
        raise OSError("no server")

    got = [(s, [r["path"] for r in df.collect()]) for s, df in (references(edges, names, "run"), references(edges, names, "walk", down), references(None, names, "RUN"))]
    assert got == [("indexed-edges", ["a.ts"]), ("indexed-symbols", ["b.ts"]), ("indexed-symbols", ["c.ts"])]
    rows = run_analyzers(spark, DATA, ("architecture", "bad"), (("architecture", catalog.QUERIES["layer_violations"]), ("bad", lambda s, d: s.table("none"))))
    assert [(r["analyzer"], r["status"]) for r in rows.collect()] == [("architecture", "success"), ("bad", "failed")]
