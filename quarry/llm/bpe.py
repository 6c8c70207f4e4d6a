"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty

NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a byte-level BPE, and every pair of tokens that merges into a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = size
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.decimal = [str(i) for i in range(size)]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs that merge, in order, and the ranks of what they give."""
        size = self.size
        pairs = {
            self.ranks[t[:i]] * size + self.ranks[t[i:]]: rank
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        return keys[order], np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        keys, ranks = self.pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], NO_RANK)

    def one_word(self, word: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair of neighbours is merged until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
            if rank == NO_RANK:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


def replay(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words on end, and the offset of each word in them (one more than words).

    All words lie in one array of symbols. An inverted index holds, for each
    rank, the positions where a pair of that rank begins. Merges are applied
    in rank order, each to all its positions at once; then only the pairs
    with the touched neighbours are looked up and indexed anew. Stale
    positions are those whose pair no longer has the rank.

    In a rank order that training could have made, a merge never creates a
    pair of a lower or equal rank. Where one does, the word is set aside and
    encoded alone.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = int(starts[-1])
    if not n:
        return np.zeros(0, np.int32), starts
    sym = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = sizes > 0
    nxt[starts[1:][filled] - 1] = n
    prv[starts[:-1][filled]] = n
    sym, nxt, prv = (np.append(x, np.int32(y)) for x, y in ((sym, 0), (nxt, n), (prv, n)))  # n is a sentinel
    alive = np.ones(n + 1, dtype=bool)
    rank = np.full(n + 1, NO_RANK, dtype=np.int32)
    rank[:n] = np.where(nxt[:n] < n, vocab.rank_of(sym[:n], sym[nxt[:n]]), NO_RANK)
    first = np.argsort(rank[:n], kind="stable").astype(np.int32)
    begins = np.searchsorted(rank[first], np.arange(vocab.size + 1))
    later: dict[int, list[np.ndarray]] = {}
    odd: set[int] = set()
    for r in range(vocab.size):
        at = first[begins[r] : begins[r + 1]]
        more = later.pop(r, None)
        if more:
            at = np.sort(np.concatenate([at, *more]))
        if not len(at):
            continue
        at = at[rank[at] == r]
        if len(at) > 1:
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            hit = np.flatnonzero(nxt[at[:-1]] == at[1:])
            if len(hit):  # in a run of one pair every second one holds
                tied = np.zeros(len(at), dtype=bool)
                tied[hit + 1] = True
                order = np.arange(len(at))
                run = order - np.maximum.accumulate(np.where(tied, -1, order))
                at = at[run % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        sym[at] = r
        alive[gone] = False
        rank[gone] = NO_RANK
        after = nxt[gone]
        nxt[at] = after
        prv[after] = at
        prv[n] = n
        before = prv[at]
        rank[at] = np.where(after < n, vocab.rank_of(sym[at], sym[after]), NO_RANK)
        rank[before] = np.where(before < n, vocab.rank_of(sym[before], sym[at]), NO_RANK)
        rank[n] = NO_RANK
        new = np.concatenate((at, before))
        got = rank[new]
        new, got = new[got < NO_RANK], got[got < NO_RANK]
        if len(new) and got.min() <= r:
            odd.update(word_of[new[got <= r]].tolist())
            new, got = new[got > r], got[got > r]
        if len(new) == 1:
            later.setdefault(int(got[0]), []).append(new)
        elif len(new):
            order = np.argsort(got, kind="stable")
            new, got = new[order], got[order]
            cut = np.flatnonzero(got[1:] != got[:-1]) + 1
            for k, part in zip(got[np.concatenate(([0], cut))].tolist(), np.split(new, cut), strict=True):
                later.setdefault(k, []).append(part)
    kept = np.flatnonzero(alive[:n])
    ids = sym[kept]
    counts = np.bincount(word_of[kept], minlength=len(words))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if odd:
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(words))]
        for i in odd:
            parts[i] = np.array(vocab.one_word(words[i]), dtype=np.int32)
        ids = np.concatenate(parts)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return ids, offsets


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[offsets[r]:offsets[r + 1]] of all rows on end."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    shift = np.repeat(offsets[rows] - ends + sizes, sizes)
    return flat[np.arange(len(shift)) + shift]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = vocabulary(path).tokens
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


def encode_block(vocab: Vocabulary, split: regex.Pattern, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text; the texts are one corpus for the replay."""
    number: dict[str, int] = {}
    coded = []
    for text in texts:
        found = split.findall(text)
        coded.append(np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int32, count=len(found)))
    ids, offsets = replay(vocab, [w.encode() for w in number])
    return [gather(ids, offsets, c) for c in coded]


def blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of about ``chars`` characters; one longer text is a block of its own."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held + len(text) > chars:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if keys:
        yield keys, texts


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000
) -> DataFrame:
    """Rows (id, ids array<int>): the token ids of each whole text, as the ranks and the pattern give.

    Each task's texts, up to ``block_chars`` characters at a time, form the
    corpus that the merges are replayed on: a word that occurs often is
    merged once a block, nothing is shuffled, and memory is bounded by the
    block. Ids do not depend on how texts fall into blocks. ``ranks_path``
    must be readable at the same place on every executor.

    Null and empty texts give no ids. Repeated rows and null ids pass
    through. An empty table gives no rows. Other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(ranks_path), regex.compile(pattern)
        for keys, texts in blocks(batches, block_chars):
            coded = encode_block(vocab, split, texts)
            for i in range(0, len(keys), 2000):
                part = coded[i : i + 2000]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2000], pa.int64()), lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(encode, "id long, ids array<int>").withColumnRenamed("id", id_col)


def digest_batch(keys: list, lists: list[np.ndarray], ranks_path: str) -> pa.RecordBatch:
    """(id, n, a, b): the number of ids, and the digests of the ids in decimal and of the bytes that they decode to."""
    decimal = vocabulary(ranks_path).decimal
    flat, offsets = decoder(ranks_path)
    a = [hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest() for ids in lists]
    b = [hashlib.sha256(gather(flat, offsets, ids).tobytes()).hexdigest() for ids in lists]
    return pa.RecordBatch.from_pydict({
        "id": pa.array(keys, pa.int64()), "n": pa.array(map(len, lists), pa.int64()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())
    })


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("ids_sha256"), F.col("b").alias("decoded_sha256"))


def bpe_digest(coded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of rows (id, ids): decodes the ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            yield digest_batch(batch.column(0).to_pylist(), [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], ranks_path)

    return _named(coded.select(F.col(id_col).alias("id"), "ids").mapInArrow(decode, "id long, n long, a string, b string"), id_col)


def bpe_round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000
) -> DataFrame:
    """``bpe_digest`` of ``bpe_encode`` in one task: the ids don't leave it, and one Python process does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(ranks_path), regex.compile(pattern)
        for keys, texts in blocks(batches, block_chars):
            yield digest_batch(keys, encode_block(vocab, split, texts), ranks_path)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return _named(rows.mapInArrow(run, "id long, n long, a string, b string"), id_col)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each row of ``documents``; null texts are empty, repeated and null ids stay."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
