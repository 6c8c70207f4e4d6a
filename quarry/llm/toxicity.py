"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
MAX_WORDS = 60  # a longer sentence is scored in pieces of so many words
PREFIXES = (4, 6)


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each hashed feature
    bias: float

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the text, or of each piece of a long one."""
    out = []
    for m in SENTENCE.finditer(text):
        begin, n, last = m.start(), 0, m.start()
        for w in WORD.finditer(text, m.start(), m.end()):
            if n == MAX_WORDS:
                out.append((begin, last))
                begin, n = last, 0
            n, last = n + 1, w.end()
        if n:
            out.append((begin, m.end()))
    return out


class Hasher:
    """Features of words: the word and its beginnings, each hashed to ``bits`` bits. Known words are kept, up to a bound."""

    def __init__(self, bits: int, keep: int = 100_000) -> None:
        self.mask, self.keep = (1 << bits) - 1, keep
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            parts = {f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)}
            found = tuple({zlib.crc32(p.encode()) & self.mask for p in parts})
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = found
        return found


def fit(texts: list[str], labels: np.ndarray, bits: int = 18, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, min_docs: int = 5, min_z: float = 4.0) -> Model:
    """Sentence weights by gradient descent (Adam) on the documents' noisy-or log loss.

    A document is toxic with probability 1 - prod(1 - p) over its sentences,
    p the logistic of the sum of its distinct features' weights, and 0 for a
    sentence without any weighted feature: else a text would be the more toxic
    the longer it is. Features in
    fewer than ``min_docs`` documents, and those whose shares of toxic and of
    other documents differ by less than ``min_z`` standard errors, stay at 0:
    else a small sample would be learnt by heart. Texts without a sentence are
    left out; without any text of either label the model scores by the rate.
    """
    hasher = Hasher(bits)
    counts, cols, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for a, b in pieces(text):
            f = {x for w in WORD.findall(text[a:b].lower()) for x in hasher(w)}
            cols.extend(f)
            counts.append(len(f))
            doc.append(d)
    n = len(doc)
    weights, share = np.zeros(1 << bits, dtype=np.float64), float(np.clip(labels.mean() if len(labels) else 0.1, 0.01, 0.99))
    if not n or not 0 < labels.mean() < 1:
        return Model(weights.astype(np.float32), float(np.log(share / (1 - share))) if len(labels) else -2.0)
    cols, doc = np.array(cols), np.array(doc)
    rows = np.repeat(np.arange(n, dtype=np.int32), counts)
    pairs = np.unique(cols.astype(np.int64) * len(texts) + doc[rows])
    toxic = labels[pairs % len(texts)] == 1
    n_all, n_toxic = (np.bincount(pairs[x] // len(texts), minlength=1 << bits) for x in (slice(None), toxic))
    of_toxic, of_all = (labels == 1).sum(), len(labels)
    rate_all = n_all / of_all
    error = np.sqrt(rate_all * (1 - rate_all) * (1 / of_toxic + 1 / (of_all - of_toxic))) + 1e-12
    z = (n_toxic / of_toxic - (n_all - n_toxic) / (of_all - of_toxic)) / error
    used = ((n_all >= min_docs) & (abs(z) >= min_z))[cols]
    if not used.any():
        return Model(weights.astype(np.float32), float(np.log(share / (1 - share))))
    names, cols = np.unique(cols[used], return_inverse=True)
    told, rows = np.unique(rows[used], return_inverse=True)  # sentences with a feature
    doc, n = doc[told], len(told)
    held = np.unique(doc)
    y = labels[held].astype(float)
    doc = np.searchsorted(held, doc)
    w, bias = np.zeros(len(names)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        s = bias + np.bincount(rows, weights=w[cols], minlength=n)
        log_not = -np.logaddexp(0, s)  # log(1 - p)
        total = np.bincount(doc, weights=log_not, minlength=len(held))
        p_doc = np.clip(-np.expm1(total), 1e-9, 1)
        # dL/ds: y=0 gives p, y=1 gives -p (1 - P) / P
        slope = np.where(y == 1, -(1 - p_doc) / p_doc, 1.0)[doc] / (1 + np.exp(-s)) / len(held)
        g = np.bincount(cols, weights=slope[rows], minlength=len(w)) + decay * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    weights[names] = w
    return Model(weights.astype(np.float32), float(bias))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = 3000, max_chars: int = 8_000_000,
) -> Model:
    """Fit on a bounded sample of the labelled rows given: half of either label where there are enough.

    ``max_docs`` documents and ``max_chars`` characters bound the sample, of
    which the driver holds the texts: first only the lengths of at most
    ``max_docs`` rows with the smallest hashes of their ids are read, then
    the texts of those that fit, in the order of another hash. Rows whose
    label is null or not 0 or 1, whose id is null or whose text is null or
    empty are no examples. If an id has two labels, the larger holds; of
    several texts of an id the shortest counts, the smallest hash on ties.
    Without any example the model scores all texts low.
    """
    marked = labels.where(f"`{label_col}` in (0, 1)").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t <> '' and id is not null")
    order = F.xxhash64("id", F.lit(7))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(order, "id").limit(max_docs // 2)
        chosen = part if chosen is None else chosen.union(part)
    version = F.struct(F.char_length("t").alias("n"), F.xxhash64("t").alias("v")).alias("x")
    sizes = texts.join(F.broadcast(chosen), "id").select("id", "y", version).groupBy("id", "y").agg(F.min("x").alias("x")).select("id", "y", "x.*")
    held, taken = 0, []
    for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"])):  # max_docs rows without texts
        if held + r["n"] <= max_chars:
            taken.append((r["id"], r["y"], r["v"]))
            held += r["n"]
    if not taken:
        return fit([], np.array([], dtype=int))
    wanted = docs.sparkSession.createDataFrame(taken, f"id {dict(texts.dtypes)['id']}, y int, v long")
    rows = texts.withColumn("v", F.xxhash64("t")).join(F.broadcast(wanted), ["id", "v"]).groupBy("id", "y").agg(F.min("t").alias("t"))
    got = {r["id"]: r["t"] for r in rows.toLocalIterator()}
    return fit([got[k] for k, _, _ in taken], np.array([y for _, y, _ in taken], dtype=int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, score, predicted, worst_start, worst_end, worst_score, n_offending), one for each row.

    The columns of ``keep`` are carried along; nothing is shuffled.

    ``score`` is the noisy-or of all sentences of the whole text; the worst
    sentence's span counts code points. Null and empty texts score 0 and have
    no span. Repeated rows and null ids are scored like others. The model is
    of fixed size. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))
    schema = "id long, score double, worst_start int, worst_end int, worst_score double, n_offending int"
    names = [f"c{i}" for i in range(len(keep))]
    carried = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    schema += "".join(f", {n} {t}" for n, t in carried.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, bias = shared.value
        weights = np.frombuffer(raw, dtype=np.float32)
        hasher = Hasher(len(weights).bit_length() - 1)
        heavy: dict[str, tuple[int, ...]] = {}
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            out: dict[str, list] = {k: [] for k in ("score", "worst_start", "worst_end", "worst_score", "n_offending")}
            for text in batch.column(1).to_pylist():
                text = text or ""
                keep, best, span, bad = 0.0, -1.0, (None, None), 0
                for a, b in pieces(text):
                    seen: set[int] = set()
                    for w in WORD.findall(text[a:b].lower()):
                        f = heavy.get(w)
                        if f is None:
                            f = heavy[w] = tuple(x for x in hasher(w) if weights[x])
                            if len(heavy) > 150_000:
                                heavy.clear()
                        seen.update(f)
                    s = bias + sum(weights[x] for x in seen) if seen else -100.0  # a score of 0
                    keep -= np.logaddexp(0, s) if s > -30 else 0.0
                    if s > best or span[0] is None:
                        best, span = s, (a, b)
                    bad += s >= 0
                out["score"].append(float(-np.expm1(keep)))
                out["worst_start"].append(span[0])
                out["worst_end"].append(span[1])
                out["worst_score"].append(float(1 / (1 + np.exp(-best))) if span[0] is not None else None)
                out["n_offending"].append(bad)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["worst_start"], pa.int32()),
                pa.array(out["worst_end"], pa.int32()), pa.array(out["worst_score"], pa.float64()), pa.array(out["n_offending"], pa.int32()),
                *(batch.column(k) for k in places),
            ], names=["id", *out, *names])

    sent = [c for c in keep if c != text_col]  # the text goes to the task once
    places = [2 + sent.index(c) if c != text_col else 1 for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *(F.col(c).alias(f"s{i}") for i, c in enumerate(sent))).mapInArrow(run, schema)
    return rows.select(
        F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score",
        "n_offending", *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
    )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model by the labels of rows whose crc32(doc_id) mod 5 is not 0."""
    return train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) and the worst sentence, one for each row of ``documents``; see ``score`` for nulls and repeats."""
    docs = table(spark, sf_dir, "documents")
    done = score(docs, trained(spark, docs, sf_dir))
    return done.select("doc_id", held_out().alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score", "n_offending")
