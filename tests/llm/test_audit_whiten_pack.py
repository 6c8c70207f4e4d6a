"""Source divergence, whitening and packing against brute force and odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, source_divergence, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(source_divergence.TERM)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    texts = [None, "", "x", "x", "\n\n", "a\x00b c", "é É " * 50, "Word word " * 30_000, "文字 _ [a] {b}"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "z", 1) for i, t in enumerate(texts)]
    rows += [(2, "x", None, "s", None, "z", 1), (None, "null id", "en", None, 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA + ", term string, value long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def divergence(rows, min_docs, top):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({(lang, source) for _, lang, source in rows})
    for text, lang, source in rows:
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in held.items()}
    whole = {lang: Counter() for lang in held}
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def share(c, terms):
        total = sum(c[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(terms)) for t in terms}

    def ranked(lang, source, part, found, most=None):
        found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
        out.extend((lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found, 1))

    for lang, source in groups:
        terms = kept[lang]
        p, q = share(counts[lang, source], terms), share(whole[lang], terms)
        others = [(s, share(counts[lang, s], terms)) for x, s in groups if x == lang and s != source]
        ranked(lang, source, "pair", [(s, sum(abs(p[t] - o[t]) for t in terms)) for s, o in others])
        ranked(lang, source, "term", [(t, p[t] - q[t]) for t in terms if counts[lang, source][t] and p[t] > q[t]], top)
    return sorted(out)


def corpus(seed, n=120, vocabulary=60):
    rng = random.Random(seed)
    names = [f"{rng.choice(['w', 'W', 'é', 'wo', '文'])}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", "", None, "d"])
        some = rng.sample(names, 12)
        out.append((" ".join(rng.choice(some) for _ in range(rng.randrange(0, 40))), lang, source))
    return out


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(1, 3, 50), (2, 2, 4), (3, 5, 1)])
def test_divergence_equals_brute_force(spark, seed, min_docs, top):
    rows = corpus(seed)
    got = source_divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=min_docs, top=top)
    assert sorted(map(tuple, got.collect())) == divergence(rows, min_docs, top)


def test_divergence_of_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "TILE", 7)
    monkeypatch.setattr(source_divergence, "BLOCK", 2)
    rows = corpus(4)
    got = source_divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=3)
    assert sorted(map(tuple, got.collect())) == divergence(rows, 3, 50)


def test_divergence_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = source_divergence.op11_source_divergence(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(source_divergence.SQL).fetchall())


def test_top_rows_refine_ties_by_bytes(spark):
    rng = random.Random(5)
    items = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(400)})  # many begin others
    rows = [(g, x, rng.choice([0, 5, 7, 10**9])) for g in "uvw" for x in items] + [("few", "x", 1)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 20, 57, 101, 130):
        got = defaultdict(set)
        for r in source_divergence.top_rows(df, ["g"], k).collect():
            got[r["g"]].add((r["item"], r["value"]))
        for g in ("u", "v", "w", "few"):
            want = sorted(((x, v) for h, x, v in rows if h == g), key=lambda y: (-y[1], y[0].encode()))[:k]
            assert got[g] == set(want)


def test_divergence_of_odd_and_empty_tables(odd, empty):
    got = source_divergence.source_divergence(odd, min_docs=2)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(map(tuple, got.collect())) == divergence(rows, 2, 50)
    assert source_divergence.source_divergence(empty).count() == 0
    none = source_divergence.source_divergence(odd).collect()  # no term in thirty documents
    assert none and all(r["part"] == "pair" and r["value"] == 0 for r in none)


VECTORS = "vec_id long, embedding array<float>, label int, n long, component int"


def checked(vectors, done, model, error, ids=None):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 1_000_000
    n, mean = len(x), x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    k = len(model.variances)
    assert model.n == n and np.allclose(model.variances, e[:k], rtol=1e-9) and np.allclose(model.shares, e[:k] / np.trace(v), rtol=1e-9)
    s = x.sum(axis=0).astype(np.int64)
    rows = sorted(done.collect(), key=lambda r: r["id"])
    assert [int(r["deviation"]) for r in rows] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s, strict=True)) for y in x]
    want, got = (x - mean) @ w[:, :k] / np.sqrt(e[:k]), np.array([r["whitened"] for r in rows])
    sign = np.sign((want * got).sum(axis=0))
    assert np.allclose(got * sign, want, atol=1e-7)
    assert error <= 1e-9 and abs(error - np.abs(got.T @ got / n - np.eye(k)).max()) < 1e-9
    return k


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((300, 40)) @ np.diag(np.linspace(3, 0.5, 40))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(vectors)], VECTORS)
    assert checked(vectors, *whitening.whiten(df)) == 32
    assert checked(vectors, *whitening.whiten(df, components=5)) == 5


def test_whitening_beyond_the_whole_gram(spark, monkeypatch):
    monkeypatch.setattr(whitening, "WHOLE_GRAM", 10)  # MLlib then iterates
    rng = np.random.default_rng(7)
    vectors = (rng.standard_normal((200, 120)) @ np.diag(np.linspace(5, 0.5, 120))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(vectors)], VECTORS)
    assert checked(vectors, *whitening.whiten(df, components=8)) == 8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = rng.standard_normal((50, 6)).astype(np.float32)
    rows = [(i, v.tolist(), None, None, None) for i, v in enumerate(good)]
    bad = [(100, None, 1, 1, 1), (101, [], 1, 1, 1), (102, [1.0] * 5 + [None], 1, 1, 1), (103, [float("nan")] * 6, 1, 1, 1), (104, [float("inf")] * 6, 1, 1, 1), (105, [1.0] * 7, 1, 1, 1)]
    assert checked(good, *whitening.whiten(spark.createDataFrame(rows + bad, VECTORS))) == 6
    again = [(None, rows[0][1], 0, 0, 0), rows[1]]
    done, model, error = whitening.whiten(spark.createDataFrame(rows + again, VECTORS))
    assert done.count() == model.n == 52 and done.where("id is null").count() == 1 and error <= 1e-9


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None, 1, 1, 1)], [(1, [1.0, 2.0], 1, 1, 1)] * 3):
        done, model, error = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert error is None and done.count() == sum(r[1] is not None for r in rows) and (model is None or not len(model.variances))
    huge = [(i, [3e38 * (i % 2), float(i)], 1, 1, 1) for i in range(4)]
    done, model, error = whitening.whiten(spark.createDataFrame(huge, VECTORS))
    assert done.count() == 4 and np.isfinite(model.variances).all()


def slow_best_fit(lengths, capacity):
    windows = []
    for x in sorted(lengths, reverse=True):
        fits = [(capacity - sum(w), i) for i, w in enumerate(windows) if capacity - sum(w) >= x]
        if fits:
            windows[min(fits)[1]].append(x)
        else:
            windows.append([x])
    return sorted(map(sum, windows))


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_runs_equal_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    top = rng.choice([1, capacity // 3 + 1, capacity])
    lengths = [rng.randint(1, top) for _ in range(rng.randrange(0, 400))] + [rng.randint(1, capacity)] * rng.randrange(0, 90)
    runs = packing.best_fit(Counter(lengths), capacity)
    windows = defaultdict(list)
    for length, n in Counter(lengths).items():
        window, offset = packing.places(runs, np.full(n, length), np.arange(n))
        for w, o in zip(window.tolist(), offset.tolist(), strict=True):
            windows[w].append((o, length))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(x for _, x in w[:i]) for i in range(len(w))]
    # Of windows with the same room either may be taken: what is left of all windows doesn't depend on it.
    assert sorted(sum(x for _, x in w) for w in windows.values()) == slow_best_fit(lengths, capacity)


def test_runs_are_bounded_by_the_capacity():
    rng = random.Random(9)
    runs = packing.best_fit({x: rng.randrange(1, 10**9) for x in range(1, 4097)}, 4096)
    assert len(runs) < 12 * 4096
    assert int((runs["windows"] * runs["each"]).sum()) > 10**12


def test_word_coder_gives_the_librarys_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), packing.WordCoder(path, most=500)
    pool = [*"abcXYZ019'’.,;:!?-<|>é́ßİΣς文字ا  　​\x1c\x85\x0b\x0c\r\n\t ", "<|endoftext|>", "<|startoftext|>", "'s", " ", " "]
    rng = random.Random(10)
    for _ in range(20):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 15))) for _ in range(200)]
        ids, sizes = coder.encode(pa.array(texts, pa.string()).slice(3))
        lists = np.split(ids, np.cumsum(sizes)[:-1])
        assert [x.tolist() for x in lists] == [library.encode(t, add_special_tokens=False).ids for t in texts[3:]]


def unpacked(rows, texts, capacity, end_id=2):
    """Check the law of the pieces of texts by id; returns the padding's share."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, end_id], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            own = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(own)) and r["length"] > 0
            assert "ids" not in r or bytes(r["ids"]) == own
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= capacity
    return 1 - sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_packing_of_the_table(spark):
    rows = packing.op13_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert unpacked(rows, texts, 4096) < 0.02


def test_packing_with_ids_any_coder_and_many_equal_lengths(spark):
    texts = {i: "same words here" if i % 3 else f"some {i} other " * (i % 40) for i in range(400)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    for by_words in (True, False):
        got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2, capacity=64, by_words=by_words, with_ids=True)
        assert unpacked(got.collect(), texts, 64) < 0.02


def test_packing_of_odd_and_empty_tables(odd, empty):
    got = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    assert sum(r["doc_id"] == 2 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    unique = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] not in (None, 2)}
    assert sum(r["doc_tokens"] for r in got if r["start"] == 0 and r["doc_id"] in unique) == sum(r["length"] for r in got if r["doc_id"] in unique)
    alone = packing.pack_documents(odd.where("doc_id <> 2"), public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    unpacked(alone, unique, 4096)
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0
