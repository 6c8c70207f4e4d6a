"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, common, decontaminate, embedding_dedup, html_text, license_scan, line_dedup, near_dedup, sharding, token_files, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "the of and to in is that it was for on are with as be at one have this from by hot word but what some we can out other were all".split()


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"{VOCAB[rng.integers(len(VOCAB))]}{rng.integers(400)}" for _ in range(n)]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", "x", "x", "\n\n", "a\x00b c", "é" * 50 + "\n" + "é" * 50, "word " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(i, t, None, "s", None, "z", 1.0) for i, t in enumerate(ODD)] + [(2, "x", None, "s", None, "z", 1.0), (None, "null id", "en", None, 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA + ", h string, id double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 1), (7, 8), (4, 4), *((20 + i, 21 + i) for i in range(30)), *((60, 61 + i) for i in range(20))]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = components(100, links)
    assert all(want[k] == v for k, v in got.items()) and len(got) == 4 + 2 + 31 + 21


# 1: embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * (0.1 + 0.01 * (i % 25))).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)] + [(400, [0.0] * 16, 1), (401, None, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, [1.0, None], 1), (405, [], 1), (0, rows[0][1], 0)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    usable = {r[0]: r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    ids = sorted({r[0] for r in rows})
    at = {k: i for i, k in enumerate(ids)}
    links = []
    for a, b in itertools.combinations(usable.values(), 2):
        if a[2] == b[2]:
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((at[a[0]], at[b[0]]))
    up = components(len(ids), links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 100
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(k, n[i], ids[up[i]], up[i] == i) for i, k in enumerate(ids)]


def test_embedding_edges(spark):
    clash = spark.createDataFrame([(1, [1.0, 0.0], 0, 5, 6, 7), (2, [1.0, 0.01], 0, 5, 6, 7), (None, [1.0, 0.0], 0, 5, 6, 7)], "vec_id long, embedding array<float>, label int, id int, links int, component_id int")
    assert sorted(map(tuple, embedding_dedup.link_embeddings(clash).collect())) == [(1, 1, 1, True, 1), (2, 1, 1, False, 2)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link_embeddings(none).count() == 0
    assert embedding_dedup.needed_count() >= 15


# 2: toxicity


def test_toxicity_learns_from_documents_and_locates(spark, odd, empty):
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(600):
        sentences = [" ".join(words(8, i * 10 + k)) + "." for k in range(6)]
        toxic = i % 3 == 0
        if toxic:
            sentences[int(rng.integers(6))] = " ".join([*words(4, i), ["grobble", "snarfwit"][i % 2], *words(3, i)]) + "."
        texts.append(" ".join(sentences))
        y.append(int(toxic))
    model = toxicity.fit(texts[:400], np.array(y[:400]))
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, texts), model).collect()}
    assert np.mean([got[i]["predicted"] == y[i] for i in range(400, 600)]) > 0.97
    hit = [i for i in range(600) if y[i] and got[i]["predicted"]]
    assert np.mean([bool(re.search("grobble|snarfwit", texts[i][got[i]["worst_start"] : got[i]["worst_end"]])) for i in hit]) > 0.97
    some = toxicity.score(odd, model, keep=("h", "id")).collect()
    assert len(some) == 10 and all(0 <= r["score"] <= 1 for r in some) and {r["h"] for r in some} == {"z", None}
    assert toxicity.score(empty, model).count() == 0
    bare = toxicity.fit([], np.array([], dtype=int))
    assert toxicity.score(docs(spark, ["a b"]), bare).first()["predicted"] == 0


def test_toxicity_never_sees_held_out_labels(spark):
    texts = [f"{'grobble' if i % 2 else 'fine'} text {i}." for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    seen = labels.where(~toxicity.held_out()).count()
    assert 0 < seen < 200
    flipped = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs(spark, texts), x.where(~toxicity.held_out())) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_scores_equal_brute_force(spark):
    """Each sentence scored by a plain loop over its words' features, documents by the product; texts of one sentence, long ones and odd ones."""
    texts = ["".join(f"{w}{'.!?'[k % 3] if k % 9 == 8 else ''} " for k, w in enumerate(words(n, n))) for n in (1, 5, 60, 200, 3000)] + ["", "...", "One\ntwo", "x " * 500]
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.where(rng.random(1 << 12) < 0.3, rng.standard_normal(1 << 12), 0).astype(np.float32), -4.0)
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        clean, scores = 1.0, []
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text):
            found = re.findall(r"\w+", sentence.lower())
            for k in range(0, len(found), 60):
                names = {n for w in found[k : k + 60] for n in (f"={w}", *(f"{w[:m]}*" for m in (4, 6) if len(w) >= m))}
                cells = {zlib.crc32(n.encode()) % (1 << 12) for n in names}
                known = [float(model.weights[c]) for c in cells if model.weights[c]]
                scores.append(1 / (1 + math.exp(4.0 - sum(known))) if known else 0.0)
                clean *= 1 - scores[-1]
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-6)
        assert got[i]["worst_score"] == (pytest.approx(max(scores), abs=1e-6) if scores else None)


def test_training_labels_that_are_no_examples(spark, empty, monkeypatch):
    """Empty tables, null and contradictory labels, repeated ids, and texts beyond the bound on characters."""
    texts = [f"{'grobble' if i % 2 else 'fine'} text {i}." for i in range(60)]
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda t, y, **_: seen.append((t, y.tolist())))
    toxicity.train(empty, labels)
    toxicity.train(docs(spark, texts), labels.limit(0))
    assert seen == [([], []), ([], [])]
    more = docs(spark, texts).union(docs(spark, ["a longer text of the same id"], 5)).union(docs(spark, [texts[7]], 7)).union(docs(spark, ["x" * 5000, None, ""], 60))
    labels = labels.union(spark.createDataFrame([(60, 1), (61, 1), (62, 1)], labels.schema))
    toxicity.train(more, labels, max_chars=2000)
    got = dict(zip(seen[2][0], seen[2][1], strict=True))
    assert got == {t: i % 2 for i, t in enumerate(texts)}


# 3: licences


def test_license_forms(spark, odd, empty):
    known = license_scan.known_digests(spark)
    texts = [
        "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + license_scan.MIT.upper(), license_scan.MIT[:-10], "x\nReleased  under the MIT LICENCE!\ny",
        "Licensed under the Apache License, Version 2.0.", "see Licensed under the MIT License. here",
    ]
    got = sorted((r["doc_id"], r["scope"], r["line"], r["license"]) for r in license_scan.scan_licenses(docs(spark, texts), known).collect())
    assert got == [(0, "line", 4, "MIT"), (0, "text", -1, "MIT"), (2, "line", 1, "MIT"), (3, "text", -1, "Apache-2.0")]
    assert license_scan.scan_licenses(odd, known).count() == 0 and license_scan.scan_licenses(empty, known).count() == 0


@pytest.mark.parametrize("width", [20, 40, 60, 72, 79, 100])
def test_wrapped_licenses(spark, width):
    """Known texts wrapped at any width, with copyright lines of all kinds before them; lines of the licence's own that begin with copyright stay."""
    import textwrap

    heads = ["Copyright (c) 2020, A. Body", "Copyright 1999-2003 The B Authors.", "© Someone\nAll rights reserved.", "Copyright (C) <year> <name>", "COPYRIGHT", "Copyright The C Authors"]
    known = license_scan.known_digests(spark)
    plain = [(n, t) for n, t in license_scan.KNOWN if "\n" not in t]
    texts = [f"{heads[i % len(heads)]}\n\n" + "\n".join(textwrap.wrap(t, width, break_long_words=False)) for i, (_, t) in enumerate(plain)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs(spark, texts), known).where("scope = 'text'").collect()}
    assert [got.get(i) for i in range(len(texts))] == [n for n, _ in plain]


def test_license_query_of_null_and_repeated_ids(spark, tmp_path):
    line = "x\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"
    rows = [(None, line), (None, "none"), (None, None), (1, line), (1, line), (1, "SPDX-License-Identifier: ISC"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, license_scan.op3_license_scan(spark, str(tmp_path)).collect()), key=str)
    hit = (None, "MIT", 2, 1)
    assert got == sorted([(None, *hit), (None, None, "", 0, None), (None, None, "", 0, None), (1, *hit), (1, *hit), (1, "ISC", "ISC", 0, None), (2, None, "", 0, None)], key=str)


@pytest.mark.parametrize("name", ["op3_license_scan", "op9_line_dedup"])
def test_equals_sql(spark, name):
    from quarry.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, cur.fetchall()))


# 4: token files


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 5000, dtype=np.uint64).astype(np.uint32)
    assert np.array_equal(token_files.unpack(token_files.pack(ids, bits), bits, len(ids)), ids)
    lists = [ids[:0], ids[:1], ids[1:4000], ids[4000:]]
    held = token_files.TokenFile(token_files.to_bytes([1, 2, 3, 4], lists, bits, 64))
    assert all(np.array_equal(held.document(i), x) for i, x in enumerate(lists))
    assert np.array_equal(held.ids(63, 66), ids[63:66])


def test_token_files_equal_library(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "a<|endoftext|>b", " lead  and\ttabs \n\n x's 12²", "日本語 😀"]
    written = token_files.write_tokens(docs(spark, texts), path, f"file://{tmp_path}/a", file_ids=1000, block=64, block_bytes=300)
    got = token_files.read_tokens(spark, written.cache()).collect()
    start = 0
    for r, text in zip(sorted(got, key=lambda r: r["doc_id"]), texts, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    w = token_files.write_tokens(odd, path, f"file://{tmp_path}/b")
    assert token_files.read_tokens(spark, w.cache()).count() == 9  # not the null id
    w = token_files.write_tokens(empty, path, f"file://{tmp_path}/c")
    assert token_files.read_tokens(spark, w.cache()).count() == 0


def test_coder_equals_library():
    """100,000 random texts of letters, digits, marks, added tokens and all blanks, and cases where blanks too many balance."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, t = token_files.Coder(path, most=20_000), Tokenizer.from_file(path)
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["x\n\n\ny\tz\tw", "Intro\n\n\nNext\tcol\tend", "a  b\rc", "a\n\nb\u00a0c", " a\tb", "a\tb\n", "a\x1cb  c", "a\u3000b\n\nc", "a b\nc d", "", " ", "\n", "a", "\n \n"]
    kinds = [list("abcXYZ"), ["the", "don't", "thing", "é", "ß", "日本語", "ひら", "кот", "ǅ", "ª", "²", "😀", "\u0301", "\u0378", "\U0001e900"], list("0123456789"),
             list(".,;:!?)('\"-%$#"), [" ", "\n"] * 20 + blanks, ["<|endoftext|>"], ["'s", "'ll", "...", "?!"]]
    rng = np.random.default_rng(8)
    odds = np.array([4, 4, 1, 2, 4, 0.05, 0.5])
    for _ in range(100_000):
        parts = [kinds[k] for k in rng.choice(len(kinds), rng.integers(1, 14), p=odds / odds.sum())]
        texts.append("".join(p[rng.integers(len(p))] for p in parts))
    for i in range(0, len(texts), 10_000):
        some = texts[i : i + 10_000]
        flat, sizes = coder.encode(pa.array(some, pa.string()))
        ends = np.cumsum(sizes)
        want = t.encode_batch_fast(some, add_special_tokens=False)
        for text, a, b, w in zip(some, ends - sizes, ends, want, strict=True):
            assert flat[a:b].tolist() == w.ids, repr(text)


def test_token_blocks_hold_all_rows():
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 40, 300)] + ["y" * 500, "", "z" * 99]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, min(a + 70, 303))), "t": texts[a : a + 70]}) for a in range(0, 303, 70)]
    got = list(token_files.blocks(iter(batches), 100))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= 100 for b in got) and len(got) < 150


# 5: BPE


def test_bpe_equals_tiktoken(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocab = bpe.vocabulary(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = [*ODD, "aaaa aaaaaaa aaa", "=" * 99 + "!!!", "日本語 😀😀 don't", "".join(map(chr, range(1, 3000)))]
    coded = bpe.bpe_encode(docs(spark, texts), path, public_tokenizers.PATTERN, block_chars=100)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    once = bpe.bpe_round_trip(docs(spark, texts), path, public_tokenizers.PATTERN, block_chars=100)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, bpe.bpe_digest(coded, path).collect()))
    for r in bpe.bpe_digest(coded, path).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[r["doc_id"]])).encode()).hexdigest()
    assert bpe.bpe_round_trip(odd, path, public_tokenizers.PATTERN).count() == 10
    assert bpe.bpe_digest(bpe.bpe_encode(empty, path, public_tokenizers.PATTERN), path).count() == 0


def test_replay_equals_greedy_merging():
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(2)
    some = [bytes(rng.choice(list(b"abethn \xc3\xa9"), rng.integers(0, 14))) for _ in range(2000)]
    ids, offsets = bpe.replay(vocab, some)
    assert all(ids[offsets[i] : offsets[i + 1]].tolist() == vocab.one_word(w) for i, w in enumerate(some))


# 6: near duplicates


def shingle_set(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    texts = []
    for k in range(25):
        base = words(80 + 7 * k, k)
        for c in range(1 + k % 6):
            w = list(base)
            for i in range(c * (1 + k % 3)):
                w[(i * 37 + c * 11) % len(w)] = f"new{c}x{i}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + ["", "", "one two", "one two", "one two three", "One, two!"]
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert len(links) > 30 and [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_a_large_group(spark):
    base = words(120, 5)
    texts = [" ".join(["x" if i == k % 120 else w for i, w in enumerate(base)] + [f"tail{k}"]) for k in range(300)]
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["class_id"] for r in got} == {0}


def test_blocks_find_links(spark):
    """Members of a bucket whose star misses them are joined in their blocks."""
    rows = []
    for i, t in enumerate([words(100, 1), [*words(100, 1)[:98], "a", "b"], words(100, 2), [*words(100, 2)[:98], "a", "b"]]):
        w = [zlib.crc32(x.encode()) - 2**31 for x in t]
        rows.append((1, 0, 0, 0, i, i, 96, bytes(96), w))
    schema = "key long, i int, j int, side int, id long, c long, n int, low binary, w array<int>"
    assert sorted(map(tuple, near_dedup.within_blocks(spark.createDataFrame(rows, schema)).collect())) == [(0, 1), (2, 3)]


def test_estimate_misses_no_more_than_bands():
    """The joint miss of a pair at 0.8: the bands' 3.2e-6 and, by the binomial, the least agreement's."""
    n, p = near_dedup.SIZE, near_dedup.MIN_SIMILARITY
    bands = (1 - p**near_dedup.BAND) ** (n // near_dedup.BAND)
    least = math.ceil(near_dedup.MIN_ESTIMATE * n)
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least)) < bands < 4e-6


def test_near_duplicates_edges(spark, odd, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(odd).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    key = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    of = np.repeat([0, 1], 400)
    sig = near_dedup.dart_signatures(of, np.concatenate((key, key)), np.concatenate((a, b)), 2, size=4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# 7: decontamination


def test_decontamination_finds_copies_and_paraphrases(spark, odd, empty):
    items = [" ".join(words(20 + 2 * k, 900 + k)) for k in range(15)]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "two words")], "item_id long, text string")
    texts, want = [], set()
    for i in range(120):
        w = words(150, 5000 + i)
        if i % 4 == 0:
            k = (i // 4) % 15
            passage = items[k].split()
            if i % 8 == 0:
                passage = ["changed" if j % 10 == 3 else x for j, x in enumerate(passage)]
            w[40:40] = passage
            want.add((i, k))
        texts.append(" ".join(w))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs(spark, texts), bench).collect()}
    assert got == want
    assert decontaminate.find_contamination(odd, bench).count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs(spark, texts), bench.limit(0)).count() == 0


def brute_contamination(texts, items):
    """All pairs by the rule: windows of the operator's sizes at its steps, each compared with each item, without any gate."""
    found = set()
    cut = lambda t: [w.encode() for w in re.findall(r"[^\W_]+|_", t.lower())] if t else []
    for k, item in enumerate(map(cut, items)):
        n, width = len(item), decontaminate.window_of(len(item))
        for d, w in enumerate(map(cut, texts)):
            last = max(0, len(w) - width)
            for start in {*range(0, last, max(1, width // 3)), last}:
                region = w[max(0, start - n // 2 - 2) : start + width + n // 2 + 2]
                if decontaminate.counts_as_found(*decontaminate.shares(item, region)):
                    found.add((d, k))
                    break
    return found


def test_decontamination_against_brute_force(spark):
    """Items of 5 to 60 words, whole or with words replaced, dropped or put between, at any place, and texts that share single sentences with them."""
    rng = np.random.default_rng(12)
    items = [" ".join(words(int(n), 700 + i)) for i, n in enumerate([5, 6, 8, 11, 14, 16, 20, 25, 31, 38, 44, 52, 60])]
    texts = []
    for i in range(160):
        w, k = words(int(rng.integers(0, 260)), 8000 + i), i % len(items)
        passage = items[k].split()
        kind = i // len(items) % 6
        if kind in (1, 2, 3):
            every = (0, 10, 5, 3)[kind]
            passage = [f"other{j}" if j % every == i % every else x for j, x in enumerate(passage)]
        if kind == 4:
            passage = [y for j, x in enumerate(passage) for y in ([x, f"more{j}"] if j % 4 == 0 else [x])]
        if kind == 5:
            passage = [x for j, x in enumerate(passage) if j % 5 != i % 5] if i % 2 else passage[: len(passage) // 2]
        at = int(rng.integers(0, len(w) + 1))
        w[at:at] = passage
        texts.append((", " if i % 2 else " ").join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs(spark, texts), bench).collect()]
    want = brute_contamination(texts, items)
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 110
    assert len(got) >= 0.97 * len(want)


def test_decontamination_edges(spark):
    """Short items, unspaced scripts, marks, repeated and null ids, extra columns of the names used inside, blocks of the benchmark."""
    bench = spark.createDataFrame(
        [(1, "東京は日本の首都です。人口は多いです。", 0), (2, "what is love", 0), (3, "love is", 0), (None, "no id at all here is a text of more words", 0), (4, "", 0), (5, None, 0),
         (6, "This -- is, THE answer; to every question asked", 0), (6, "This -- is, THE answer; to every question asked", 1), (7, "this is the answer to every question asked", 0)],
        "item_id long, text string, t int",
    )
    rows = [
        (1, "前。東京は日本の首都です！人口は多いです。後"), (2, "so What is... love is it"), (3, "what love is"), (4, "x this is the answer to every question asked y"),
        (None, "This is the answer, to every question asked"), (4, "x this is the answer to every question asked y"), (5, None), (6, ""),
    ]
    table = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, id int, item_id int")
    want = sorted([(1, 1), (2, 2), (4, 6), (4, 6), (4, 7), (4, 7), (None, 6), (None, 7)], key=str)
    for chars in (20_000_000, 40):
        got = decontaminate.find_contamination(table, bench, block_chars=chars)
        assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str) == want


def test_words_equal_a_pattern():
    """The vectorised cutting against a regular expression, over all kinds of characters, in pieces."""
    rng = np.random.default_rng(5)
    kinds = "aBzÉßñ0_9 .,;-'\n\t\u00a0«»—…‘’「」、。！？Ａ０（）日本かカไทย한글кот😀\U00020000"
    texts = ["", None, *("".join(rng.choice(list(kinds), rng.integers(0, 60))) for _ in range(3000)), "x" * 50 + " " + "y" * 9]
    marks = r"\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\xbf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
    alone = r"\u0e00-\u0e7f\u3040-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    pattern = re.compile(f"[{alone}]|[^{marks}{alone}]+")
    for at, some in decontaminate.pieces(pa.array(texts, pa.string()), 500):
        w = decontaminate.cut(some)
        got = [w[int(a) : int(b)] for a, b in zip(w.begin[:-1], w.begin[1:], strict=True)]
        assert got == [[x.encode() for x in pattern.findall((t or "").lower())] for t in texts[at : at + len(some)]]
        flat = [x for row in got for x in row]
        assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_subsequence_equals_table():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.subsequence(decontaminate.masks_of(a), len(a), b) == t[-1, -1]


# 8: sharding


def brute_pack(loads, n):
    """Plain loops: items by falling largest share, each to the shard of the highest dot product with what is left."""
    total = [max(1e-300, sum(x[d] for x in loads)) for d in range(3)]
    share = [[x[d] / total[d] * n for d in range(3)] for x in loads]
    left = [[1.0] * 3 for _ in range(n)]
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-max(share[i]), i)):
        dots = [sum(a * b for a, b in zip(left[k], share[i], strict=True)) for k in range(n)]
        room = [k for k in range(n) if left[k][0] >= share[i][0]]
        k = max(room, key=lambda k: (dots[k], -k)) if room else max(range(n), key=lambda k: (left[k][0], -k))
        out[i] = k
        left[k] = [a - b for a, b in zip(left[k], share[i], strict=True)]
    return out


def test_packing_equals_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 3, 16):
        loads = np.round(rng.pareto(1.5, (200, 3)) * 100) + 1
        got = sharding.pack(loads, n).tolist()
        assert got == brute_pack(loads.tolist(), n)


def test_groups_split_only_above_a_share(spark):
    """A group just below a shard's share stays whole and the law holds; one above is split; null ids of a split group are dealt."""
    rest = [" ".join(words(30, i)) for i in range(3000)]
    size = len(rest[0])
    for copies, whole in ((190, True), (260, False)):
        texts = rest + ["c" * (size - 1)] * copies
        got = sharding.assign_shards(docs(spark, texts), cells_per_shard=64, heavy=64).toPandas()
        hot = got[got["doc_id"] >= 3000]
        assert (hot["shard"].nunique() == 1) == whole
        sizes = got.groupby("shard")["size"].sum()
        assert sizes.max() / sizes.min() < 1.03
    nulls = spark.createDataFrame([(None, "hot text")] * 4000 + [(i, t) for i, t in enumerate(rest)], "doc_id long, text string")
    got = sharding.assign_shards(nulls, cells_per_shard=64, heavy=64).toPandas()
    assert len(got) == 7000 and got.groupby("shard").size().max() < 700
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_law_and_groups(spark, odd, empty):
    texts = [" ".join(words(5 + i % 300, i)) for i in range(3000)] + ["copy of one hot text"] * 1500 + ["pair"] * 2
    got = sharding.assign_shards(docs(spark, texts), cells_per_shard=64, heavy=64).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and len(sizes) == 16 and sizes.max() / sizes.min() < 1.03
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    spread = got.groupby("group_key")["shard"].nunique()
    assert got[got["size"] == 5]["shard"].nunique() == 1 and spread.max() == 1  # not even the hot text, of a third of all rows but few bytes
    by = got.groupby("shard").agg(tokens=("tokens", "sum"), rows=("slot", "size"))
    assert by["tokens"].max() / by["tokens"].min() < 1.1
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got.head(50).to_dict("records"))
    long = [" ".join(words(5 + i % 30, i)) for i in range(2000)] + ["one hot text of more bytes than a shard holds"] * 2000
    got = sharding.assign_shards(docs(spark, long), cells_per_shard=64, heavy=64).toPandas()
    sizes, spread = got.groupby("shard")["size"].sum(), got.groupby("group_key")["shard"].nunique()
    assert sizes.max() / sizes.min() < 1.03 and (spread > 1).sum() == 1 and sorted(got["doc_id"]) == list(range(4000))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    blank = sharding.assign_shards(docs(spark, [" ".join(words(20 + i % 7, i)) for i in range(3600)] + [""] * 400)).toPandas()
    assert blank[blank["size"] == 1]["shard"].nunique() == 1
    assert sharding.assign_shards(odd).count() == 10 and sharding.assign_shards(empty).count() == 0


# 9: lines


def brute_lines(rows, min_chars=40, min_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blanks))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_equal_brute_force(spark, odd, empty):
    shared = "This Line Is Shared by many documents, and is long enough."
    texts = [f"own {i}\n \t{shared.upper() if i % 2 else shared}\r\n{shared}\nend" for i in range(8)] + [shared, "short\n" * 6, "é" * 40] + ["é" * 40] * 4
    got = sorted(map(tuple, line_dedup.dedup_lines(docs(spark, texts)).collect()))
    assert got == sorted(brute_lines(list(enumerate(texts))))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = line_dedup.dedup_lines(odd, keep=("h", "lang")).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted((str(a), *b) for a, *b in brute_lines(rows))
    assert line_dedup.dedup_lines(empty).count() == 0


# 10: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site, name, and more</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, many, many cookies, on this page of ours.</p></div>
<div id="wrap" class="layout has-sidebar"><div class="content">%s</div><div class="sidebar"><p>Side, text, with commas, and a length that a paragraph has.</p></div>
<div id="comments"><article class="comment"><p>A reader, who, writes, commas, and a lot of text, that is not the article at all.</p></article></div></div>
<form><p>Sign up, please, and give us your address, now, here.</p></form><footer>&copy; 2020</footer></body></html>"""
BODY = "<h2>Head</h2><p>First,&nbsp;long paragraph, with &amp; commas &lt;b&gt; and <b>bold</b>   text\n that goes on.<p>Second one, unclosed, also long enough to count as text.<ul><li>one<li>two</ul><p>end.</p>"
WANT = "Head\nFirst, long paragraph, with & commas <b> and bold text that goes on.\nSecond one, unclosed, also long enough to count as text.\none\ntwo\nend."


def test_html(spark):
    bare = PAGE % BODY
    pages = [bare, (PAGE % f"<article>{BODY}</article>"), None, "", "<p>cut", "<<<>>> &am", "<div>" * 3000 + "deep text, that is long enough to be taken" + "</div>" * 3000, "<script>var a"]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert [got[i] for i in range(8)] == [WANT, WANT, "", "", "cut", "<<<>>> &am", "deep text, that is long enough to be taken", ""]
    assert html_text.extract_text(df.limit(0)).count() == 0


PARA = "A paragraph, with commas, of a length that tells the score where the article is, in page %d."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>İstanbul</p><script>var a='</p>'</SCRIPT ><p>Two</p><style>p{}</STYLE><p>Three</p></article>", "İstanbul\nTwo\nThree"),
        ('<article><p class="a"">Two</p><p title=it\'s>Three</p><p data-x=\'a > b\' title="c > d">Four</p><p a=b"c>Five</p></article>', "Two\nThree\nFour\nFive"),
        ('<article><p class="skip">One</p><p class="related-work">Two</p><div class="related-work"><p>Three</p></div><p class="rail notice">Four</p></article>', "One\nTwo\nThree\nFour"),
        ('<article><p>One</p><div class="related-posts"><p>No</p></div><div class="share"><p>No</p></div><p class="cookie-note">No</p><div class="advert">No</div></article>', "One"),
        (f"<body><div id=wrap><h1>Head</h1><div class=content><p>{PARA % 1}</p><p>{PARA % 2}</p></div></div></body>", f"Head\n{PARA % 1}\n{PARA % 2}"),
        (f"<body><div id=wrap><p>Short lead.</p><div><p>{PARA % 1}</p><p>{PARA % 2}</p></div><p>The end.</p></div></body>", f"Short lead.\n{PARA % 1}\n{PARA % 2}\nThe end."),
        (f"<body><div><h1>Head</h1></div><div><div><p>{PARA % 1}</p><p>{PARA % 2}</p></div></div><p>&copy; 2020 Someone.</p></body>", f"Head\n{PARA % 1}\n{PARA % 2}"),
        ("<article><p>One</p><!--><p>Two</p><!---><p>Three</p><!-- a --!><p>Four</p><!-- b --><p>Five</p><!-- no", "One\nTwo\nThree\nFour\nFive"),
        ("<main><article>A</article><article>B</article><article class=comment>C</article></main>", "A\nB"),
        ("<article><p>The value <math><mi>x</mi><annotation>x</annotation></math> is</p><svg><desc>d</desc><text>label</text></svg></article>", "The value x is\nlabel"),
        (f"<main><h1>Head</h1><article><p>{PARA % 1}</p></article></main>", f"Head\n{PARA % 1}"),
        (f"<body><h1>Site</h1><article><h2>Head</h2><p>{PARA % 1}</p></article></body>", f"Head\n{PARA % 1}"),
    ],
)
def test_html_keeps_the_article(page, want):
    assert html_text.main_text(page) == want


def test_html_time_grows_with_the_page():
    """Elements left open, and headlines deep within them, cost no more than others."""
    import time

    for page in ("<b>" * 40000 + f"<p>{PARA % 1}" * 40000, "<div>" * 20000 + "<h1>a</h1>" * 20000, "<ul><li>" * 20000 + "<b><p>text" * 20000, "</i><b></p>" * 40000):
        t = time.time()
        html_text.main_text(page)
        assert time.time() - t < 20


def second_extractor(page):
    """Brute force by the library's parser, for pages with an article element: its blocks, less what stands in named parts."""
    from html.parser import HTMLParser

    gone = {"nav", "aside", "footer", "form", "script", "style", "button"}
    blocks = {"p", "h1", "h2", "li", "ul", "div", "article", "blockquote", "section"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.stack = [], "", []

        def flush(self):
            text = re.sub(r"\s+", " ", self.now).strip()
            if text:
                self.out.append(text)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in blocks:
                self.flush()
            if tag == "br":
                self.now += " "
            else:
                self.stack.append((tag, tag in gone or dict(attrs).get("class") in ("ad", "comment")))

        def handle_endtag(self, tag):
            if tag in blocks:
                self.flush()
            while self.stack and self.stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.stack) and not any(g for _, g in self.stack):
                self.now += data

    r = Reader()
    r.feed(page)
    r.flush()
    return "\n".join(r.out)


def test_html_equals_a_second_extractor(spark):
    """Random well-formed pages, very long ones and repeated rows among them, against the library's parser."""
    rng = np.random.default_rng(3)
    pages = []
    for i in range(150):
        parts = []
        for k in range(int(rng.integers(1, 30)) * (200 if i == 7 else 1)):
            text = " ".join(words(int(rng.integers(1, 40)), i * 1000 + k)).replace("the", ["th&eacute;", "<b>the</b>", "t&amp;he", "<br>the", "İ"][k % 5])
            kind = rng.integers(8)
            parts.append([f"<p>{text}</p>", f"<h2 class='x'>{text}</h2>", f"<ul><li>{text}</li><li>two</li></ul>", f"<div class=\"ad\"><p>{text}</p></div>", f"<script>var x='<p>{text}</p>'</script>",
                          f"<blockquote>{text}</blockquote>", f"<form><p>{text}</p></form>", f"<section><p>{text}</p></section>"][kind])
        pages.append(f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head {i}</h1>{''.join(parts)}</article><div class='comment'><p>No, no, no.</p></div><footer>f</footer></body></html>")
    rows = [(i, f"u{i}", h) for i, h in enumerate(pages)] + [(3, "u3", pages[3]), (None, None, pages[4])]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 152
    for r in got:
        want = second_extractor(pages[4 if r["page_id"] is None else r["page_id"]])
        assert r["text"] == want and r["n_chars"] == len(want)


# pipeline


def test_pipeline_stages_edges(spark):
    """Each stage with nulls in any column, empty and very long texts, ties, repeated rows and extra columns of all names used inside."""
    import corpus_pipeline as p

    names = ["score", "predicted", "worst_start", "n_lines", "n_dropped", "id", "t", "w", "g", "h", "n", "a", "b", "key", "row", "version", "lines", "kept", "copy_of", "class_id", "item_id", "cosine", "ids", "n_tokens"]
    schema = SCHEMA + "".join(f", {c} int" for c in names)
    extra = tuple(range(len(names)))
    line = "A line of more than forty characters that many documents hold."
    texts = [None, "", "x", "word " * 30_000, line, "own\n" + line, "Own\n" + line, "o\n" + line, "p\n" + line, "q\n" + line, "one two three four five six", "one two three four five six"]
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), *extra) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "null id\n" + line, None, None, None, *extra), (None, None, None, None, None, *[None] * len(names))]
    src = spark.createDataFrame(rows, schema)
    now = common.stored(src, "odd")
    sizes = []
    for name, stage in p.STAGES[:-1]:
        now = common.stored(stage(spark, now, DATA), name)
        assert now.columns == src.columns
        sizes.append(now.count())
        kept = now.where("score is not null").select(*names).distinct().collect()
        assert [tuple(r) for r in kept] == [extra]
    rest = [(r["doc_id"], r["text"]) for r in now.collect()]
    held = dict(rest)
    assert sizes[0] == sizes[1] == 15 and held[9] == "q\n" + line and sum(line in (t or "") for _, t in rest) == 2  # the last, and the null id's
    assert {0, 1, 3, 10} <= set(held) and 11 not in held
    out = p.STAGES[-1][1](spark, now, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == sizes[-1]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    src = spark.read.parquet(f"{DATA}/documents.parquet")
    now, seen = src, {r[0] for r in src.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        now = common.stored(stage(spark, now, DATA), name)
        assert now.columns == src.columns
        ids = [r[0] for r in now.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    out = p.STAGES[-1][1](spark, now, DATA)
    assert {r[0] for r in out.select("doc_id").collect()} == seen
    whole = p.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))
    none = src.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_pattern_is_what_the_library_uses():
    assert regex.compile(public_tokenizers.PATTERN).findall("it's  a\n\nb") == ["it", "'s", " ", " a", "\n", "\n", "b"]
