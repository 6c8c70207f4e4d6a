"""Embedders that fail, vectors that are carried, chunks and search."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np

from quarry.operators import semantic
from quarry.operators.symbol_trees import symbols_of
from quarry.sources.embedder import Bounded, embed, http_embedder, letters

FILES = "path string, language string, text string, fingerprint string"


def test_failing_batches_lose_no_row(spark):
    def broken(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        if any("short" in t for t in texts):
            return [[1.0]]
        return [None if "none" in t else [] if "empty" in t else [float("nan")] if "nan" in t else ["x"] if "word" in t else [len(t), 2] for t in texts]

    texts = ["a", "boom", "bb", "short", "none", "empty", "nan", "word", None, "ccc"]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, text string, more string").coalesce(1)
    got = {r["i"]: r["vector"] for r in embed(rows, broken, batch=2).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, 9: [3.0, 2.0]}
    one = {r["i"]: r["vector"] for r in embed(rows, broken, batch=1).collect()}
    assert one == {**got, 0: [1.0, 2.0], 2: [2.0, 2.0], 3: [1.0]}
    assert embed(rows.limit(0), broken).count() == 0 and embed(rows, broken).columns == ["i", "more", "vector"]


def test_a_late_embedder_is_given_up():
    calls = []

    def late(texts):
        calls.append(texts)
        time.sleep(0.5)
        return [[1.0]] * len(texts)

    ask = Bounded(late, deadline=0.05, patience=2)
    assert [ask(["x"]) for _ in range(5)] == [[None]] * 5 and len(calls) == 2
    assert Bounded(late, deadline=5)(["x"]) == [[1.0]]


def test_a_service(spark):
    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = "bad" in asked["prompt"]
            body = b"not json" if bad else json.dumps({"embedding": [len(asked["prompt"]), 1]}).encode()
            self.send_response(500 if "worse" in asked["prompt"] else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = http_embedder(f"http://127.0.0.1:{server.server_port}/embed", "m", timeout=5)
        assert ask(["abc", "bad", "worse", ""]) == [[3, 1], None, None, [0, 1]]
        rows = spark.createDataFrame([(i, "z" * i) for i in range(9)], "i int, text string")
        assert sorted((r["i"], r["vector"]) for r in embed(rows, ask).collect()) == [(i, [float(i), 1.0]) for i in range(9)]
    finally:
        server.shutdown()
    assert http_embedder(f"http://127.0.0.1:{server.server_port}/embed", "m", timeout=1)(["gone"]) == [None]


def test_texts_of_units(spark):
    files = spark.createDataFrame([("a.ts", "TypeScript", "h" * 2000 + "m" * 1001 + "t" * 1000, "1"), ("b", None, None, "2"), ("c.ts", "TypeScript", "x", None)], FILES)
    names = spark.createDataFrame([("a.ts", f"n{i:03}") for i in range(100)] + [("c.ts", "only"), ("c.ts", "only")], "path string, name string")
    got = {r["path"]: r["text"] for r in semantic.unit_texts(files, names).collect()}
    listed = ", ".join(f"n{i:03}" for i in range(80))
    assert got["a.ts"] == f"search_document: path: a.ts\nlanguage: TypeScript\nsymbols: {listed}\n" + "h" * 2000 + "\n" + "t" * 1000
    assert got["b"] == "search_document: path: b" and got["c.ts"] == "search_document: path: c.ts\nlanguage: TypeScript\nsymbols: only\nx"


def test_chunks_carrying_and_search(spark):
    span = lambda a, b: {"start": {"line": a, "character": 0}, "end": {"line": b, "character": 0}}
    answer = [{"name": f"f{i}", "kind": 12, "range": span(i * 20, i * 20 + 8 + i)} for i in range(12)] + [{"name": "Box", "kind": 5, "range": span(300, 305)}, {"name": "file", "kind": 1, "range": span(0, 400)}]
    answer[11]["children"] = [{"name": "inner", "kind": 6, "range": span(220, 239)}]
    text = "\n".join("q" * (i % 7) if 240 > i >= 220 else "ab" for i in range(400))
    files = spark.createDataFrame([("a.ts", "TypeScript", text, "1"), ("b.ts", "TypeScript", "zzzz jazz zzzz", "2"), ("c.ts", "TypeScript", "fail", "3"), ("d.ts", "TypeScript", "dd", None)], FILES)
    symbols = symbols_of(spark.createDataFrame([("a.ts", json.dumps(answer)), ("c.ts", json.dumps([{"name": "big", "kind": 12, "range": span(0, 30)}]))], "path string, json string"))

    def service(texts):
        return [None if t.endswith("fail") and "symbol: " not in t else v for t, v in zip(texts, letters(texts), strict=True)]

    run = semantic.embed_run(files, service, symbols)
    rows = {(r["path"], r["chunk_key"]): r for r in run.collect()}
    assert {k[1] for k in rows if k[0] == "a.ts"} == {None} | {f"f{i}@{i * 20}" for i in range(4, 12)}
    assert rows["c.ts", None]["status"] == "failed" and rows["c.ts", None]["vector"] is None and ("c.ts", "big@0") not in rows
    source = "\n".join(text.split("\n")[220:240])
    assert rows["a.ts", "f11@220"]["vector"] == letters([f"search_document: path: a.ts\nsymbol: f11 (Function)\n{source}"])[0]

    def never(texts):
        raise AssertionError(texts)

    again = {(r["path"], r["chunk_key"]): r for r in semantic.embed_run(files.where("path in ('a.ts', 'b.ts')"), never, symbols, previous=run).collect()}
    assert {k: r["status"] for k, r in again.items()} == {k: "carried" for k in rows if k[0] in ("a.ts", "b.ts")}
    assert all(again[k]["vector"] == rows[k]["vector"] for k in again)
    third = {(r["path"], r["chunk_key"]): r["status"] for r in semantic.embed_run(files, service, symbols, previous=run).collect()}
    assert third["d.ts", None] == "embedded" and third["c.ts", None] == "failed" and third["a.ts", "f4@80"] == "carried" and set(third) == set(rows)

    best = semantic.find("qqqqqqqqqqqqqqqqqqqqqqqqqq", run, service, 2).collect()
    assert (best[0]["path"], best[0]["chunk"]) == ("a.ts", "f11")
    assert semantic.find("x", run, never) is None
    near = semantic.neighbors(run, "b.ts", 5).collect()
    vectors = {k: np.array(r["vector"]) for k, r in rows.items() if r["vector"]}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = {p: max(cos(v, vectors["b.ts", None]) for k, v in vectors.items() if k[0] == p) for p in ("a.ts", "d.ts")}
    assert [r["path"] for r in near] == sorted(want, key=lambda p: -want[p]) and np.allclose([r["score"] for r in near], sorted(want.values(), reverse=True))
    assert semantic.neighbors(run, "c.ts").count() == 0
