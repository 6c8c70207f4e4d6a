"""Packing of documents' token ids into windows of one length by best-fit decreasing."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stored, table, text_or_empty
from quarry.llm.token_files import blocks, gather_at, objects, on_end

CAPACITY = 4096
RUN = np.dtype([("length", "i8"), ("first", "i8"), ("window", "i8"), ("windows", "i8"), ("each", "i8"), ("used", "i8")])


class Capacities:
    """A segment tree over remaining capacities: which of them some open window has."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = np.zeros(2 * self.leaves, dtype=bool).tolist()

    def mark(self, capacity: int, there: bool) -> None:
        k = self.leaves + capacity
        self.any[k] = there
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is at least ``least``."""
        k = self.leaves + least
        while not self.any[k]:
            while k & 1:  # a right child: nothing further on below this parent
                k //= 2
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of ``counts[length]`` pieces of each length, as runs.

    A run says that the pieces of a length with the ranks from ``first`` on go
    to ``windows`` windows from ``window`` on, ``each`` to a window, behind
    ``used`` ids. Pieces of one length are alike, and so are windows with the
    same room: the tightest window takes pieces of a length until no more fit,
    and then the next window of that room does the same, so a whole range of
    windows is filled by one run. A range's room at least halves each time and
    each length splits two ranges at most: runs are bounded by the capacity
    (some 12 for each of its lengths), whatever the number of pieces.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # ranges of windows by room
    room, runs, made = Capacities(capacity), [], 0

    def put(c: int, window: int, n: int) -> None:
        if c and n:
            open_[c].append((window, n))
            room.mark(c, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            c = room.tightest(length)
            if c is None:
                c, n = capacity, -(-left // (capacity // length))
                put(c, made, n)
                made += n
            window, n = open_[c].pop()
            if not open_[c]:
                room.mark(c, False)
            each = c // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, window, full, each, capacity - c))
                put(c - each * length, window, full)
                rank, left, window, n = rank + full * each, left - full * each, window + full, n - full
            if n and 0 < left < each:
                runs.append((length, rank, window, 1, left, capacity - c))
                put(c - left * length, window, 1)
                rank, left, window, n = rank + left, 0, window + 1, n - 1
            put(c, window, n)
    return np.array(runs, dtype=RUN)


def places(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, by its rank among those of its length; ``runs`` as ``best_fit`` gives them."""
    begins = runs["length"] * -1 + runs["first"] * 1j  # falling lengths, rising ranks: in order as they are
    at = np.searchsorted(begins, -length + rank * 1j, "right") - 1
    run = runs[at]
    inside = rank - run["first"]
    return run["window"] + inside // run["each"], run["used"] + inside % run["each"] * length


class WordCoder:
    """Ids of whole texts, each different word encoded once by the library.

    For tokenizers that take white space for a border of tokens and then drop
    it: the ids of a text are those of its runs of other characters on end.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        """``most`` words are kept from call to call before they are forgotten."""
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has. Texts are not null."""
        if len(self.known) > self.most:
            self.forget()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = objects(coded.dictionary)
        at = np.fromiter((self.known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = on_end(e.ids for i in range(0, len(fresh), 1000) for e in self.tokenizer.encode_batch_fast(fresh[i : i + 1000], add_special_tokens=False))
            at[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip(fresh, at[new].tolist(), strict=True))
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))
        number = at[coded.indices.to_numpy()]
        size = self.sizes[number]
        ends = np.concatenate(([0], np.cumsum(size)))
        offsets = lists.offsets.to_numpy()
        return gather_at(self.flat, self.begins[number], size), ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]


class TextCoder:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return on_end(self.tokenizer.encode(x, add_special_tokens=False).ids for x in objects(texts))


@lru_cache(maxsize=1)
def coder_of(path: str, by_words: bool) -> WordCoder | TextCoder:
    """One for all tasks of a Python process."""
    return WordCoder(path) if by_words else TextCoder(path)


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values stand before each, in ``values`` and by the counts of ``seen``, which goes on counting."""
    order = np.argsort(values, kind="stable")
    some, first, n = np.unique(values[order], return_index=True, return_counts=True)
    ranks = np.empty(len(values), dtype=np.int64)
    ranks[order] = np.arange(len(values)) - np.repeat(first, n) + np.repeat(seen[some], n)
    seen[some] += n
    return ranks


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    by_words: bool = True, with_ids: bool = False, block_bytes: int = 4_000_000,
) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, task, rank[, ids]): windows of ``capacity`` ids and what is left over.

    ``rank`` counts a task's pieces of a length; ``task`` is its number. Store
    the rows before use, so that both stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder, task, seen = coder_of(tokenizer_path, by_words), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in blocks(batches, block_bytes):
            ids, sizes = coder.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4")
            tokens = sizes + 1
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            begin = (np.cumsum(tokens) - tokens)[doc] + start
            held = [ids[a:b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [
                batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in held], pa.int64()),
                pa.array(tokens[doc]), pa.array(np.full(len(doc), task)), pa.array(ranks_within(length, seen)),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes() for x in held], pa.binary())] * with_ids, names=names)

    return rows.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long" + ", ids binary" * with_ids)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    by_words: bool = True, with_ids: bool = False,
) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): each piece of each document and its place.

    A document is the ids of its whole text and ``end_id``. It is cut into
    windows of ``capacity`` ids; these, and the rests of all documents, are
    packed by best-fit decreasing over the whole corpus. That needs only how
    many pieces have each length: a histogram of at most ``capacity`` rows
    comes to the driver, and runs of a number bounded by the capacity, not by
    the corpus, go back to all tasks. A piece finds its run by its rank among
    the pieces of its length: its rank in the task that cut it, plus the
    pieces of the tasks before, a sum over counts by length and task. No
    length, however frequent, meets in one task. ``sequence_id`` is gapless
    from 0, as ``offset`` is within a sequence, whose pieces end before
    ``capacity``; what is left of it is padding.

    ``with_ids`` adds the ids as little-endian unsigned 32-bit integers, for
    those who write sequences. ``by_words`` is for tokenizers that drop white
    space (see ``WordCoder``); without it any tokenizer's library runs over
    whole texts.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like others. An empty table gives no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, by_words, with_ids), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    runs = spark.sparkContext.broadcast(best_fit(totals, capacity))
    ranked = pieces.join(counts.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    more = ["ids"] * with_ids
    ranked = ranked.select(*kept, *more, "rank")
    types = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, offset = places(runs.value, batch.column(2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(window), pa.array(offset)], names=[*kept, *more, "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in kept + more) + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all ``documents``; see ``pack_documents`` for nulls and repeats."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
