"""Token-id output: fixed-width bit packing in files with block offsets.

A file holds, little-endian: the header (magic, version, bits, ids a block,
documents, ids, blocks); the doc ids (int64); the document starts (int64,
one more than documents, in ids from the file's start); the block offsets
(int64, one more than blocks, in bytes from the payload's start); and the
payload: each block's ids, ``bits`` bits each, lowest bit first.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import new_path, parallelism, stored, table, text_or_empty

HEADER = struct.Struct("<8sIIQQQQ")
MAGIC = b"QUARRYTK"


def bits_for(n_ids: int) -> int:
    """The least number of bits that holds every id below ``n_ids``."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def to_bytes(doc_ids: list[int], lists: list[np.ndarray], bits: int, block: int) -> bytes:
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype("<i8")
    ids = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("<i8")
    head = HEADER.pack(MAGIC, 1, bits, block, len(doc_ids), len(ids), len(parts))
    return b"".join([head, np.array(doc_ids, dtype="<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *parts])


class TokenFile:
    """Random access to the ids in the bytes of one file."""

    def __init__(self, data) -> None:
        magic, version, self.bits, self.block, n_docs, self.n_ids, n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.starts = np.frombuffer(data, "<i8", n_docs + 1, at + 8 * n_docs)
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, at + 16 * n_docs + 8)
        self.payload = memoryview(data)[at + 16 * n_docs + 8 * n_blocks + 16 :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [
            unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block))
            for k in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: Blanks other than space and line feed, in the syntax of RE2: Python's, which are all of Unicode's and four more.
OTHER_BLANK = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Another blank, or one that does not stand alone between other characters.
ODD = rf"[{OTHER_BLANK}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Letters of any Unicode version (with the space before them) and marks: one match of the pattern each.
LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}]+"
WORD = rf"\A(?P<letters>{LETTERS})(?P<marks>[.,;:!?)]*)\z"
ALONE = re.compile(r"(?<=\S)([ \n])(?=\S)")


def objects(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def on_end(lists: Iterable[Iterable[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values on end, and how many each list has."""
    flat, ends = array("I"), array("q")
    for x in lists:
        flat.extend(x)
        ends.append(len(flat))
    return np.array(flat, dtype=np.uint32), np.diff(np.array(ends, dtype=np.int64), prepend=0)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100 on."""
    out, more = {}, itertools.count(256)
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out[b] = chr(b if plain else next(more))
    return out


id_of = attrgetter("id")


class Coder:
    """Ids of whole texts as the tokenizer's ``encode`` gives them, each different word encoded once.

    The byte-level pattern never joins what stands before a space or line
    feed with what begins at it, if that blank is a single one between other
    characters. So a text is cut before each such space and around each such
    line feed, and nowhere else; other blanks stay within their part. A part
    of letters, or of marks, is one match of the pattern, which the
    library's model encodes; a part of letters and marks is two of them; any
    other part goes through the library whole. A text that holds an added
    token's string is encoded whole, and so is every text by a tokenizer of
    another kind, or with a normaliser.
    """

    def __init__(self, path: str, most: int = 700_000, most_chars: int = 20_000_000) -> None:
        """``most`` parts, of ``most_chars`` characters, are kept from call to call before they are forgotten."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        split = config.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.apart = plain and not config.get("normalizer") and not config.get("truncation") and not config.get("padding")
        self.added = [t["content"] for t in config.get("added_tokens", ())]
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.most, self.most_chars = most, most_chars
        self.forget()

    def forget(self) -> None:
        """Empty the parts known so far. The ids of part k stand in ``flat`` from ``begins[k]``, ``sizes[k]`` of them."""
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}  # those without and with a space before them, which is left out
        self.chars = 0
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[str], led: int, flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.sizes)
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))
        self.known[led].update(zip(names, range(first, first + len(names)), strict=True))
        self.chars += sum(map(len, names))

    def find(self, names: list[str], led: int) -> np.ndarray:
        """The number of each of different parts; new ones are learnt."""
        at = np.fromiter(map(self.known[led].get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            self.learn(fresh, led)
            at[new] = np.fromiter(map(self.known[led].__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return at

    def learn(self, names: list[str], led: int) -> None:
        """Encode different parts, none of them known."""
        cut = pc.extract_regex(pa.array(names, pa.string()), WORD)
        word = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        letters, marks = (objects(cut.field(x)) for x in ("letters", "marks"))
        rest = [names[i] for i in np.flatnonzero(~word).tolist()]
        lead = " " * led
        if rest:
            coded = (e.ids for i in range(0, len(rest), 1000) for e in self.tokenizer.encode_batch_fast([lead + x for x in rest[i : i + 1000]], add_special_tokens=False))
            self.add(rest, led, *on_end(coded))
        where = np.flatnonzero(word).tolist()
        known = self.known[led]
        single = [x for x in dict.fromkeys(letters[i] for i in where) if x not in known]
        if single:
            feed = "\n".translate(self.letters)  # stands in no part here
            lines = (lead + f"\n{lead}".join(single)).encode().decode("latin-1").translate(self.letters).split(feed)
            self.add(single, led, *on_end(map(id_of, self.model.tokenize(x)) for x in lines))
        both = [i for i in where if marks[i]]
        if both:
            ends = dict.fromkeys(marks[i] for i in both)
            ends = dict(zip(ends, self.find(list(ends), 0).tolist(), strict=True))
            at = np.array([(known[letters[i]], ends[marks[i]]) for i in both], dtype=np.int64).ravel()
            sizes = self.sizes[at]
            self.add([names[i] for i in both], led, gather_at(self.flat, self.begins[at], sizes), sizes.reshape(-1, 2).sum(axis=1))

    def numbers(self, words: pa.Array, led: np.ndarray) -> np.ndarray:
        """The number of each part, a word with a space before it where ``led``."""
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        place = np.zeros((2, len(coded.dictionary)), dtype=np.int64)
        for k in (0, 1):
            seen = np.zeros(len(coded.dictionary), dtype=bool)
            seen[code[led == k]] = True
            used = np.flatnonzero(seen)
            place[k, used] = self.find(objects(coded.dictionary.take(pa.array(used))), k)
        return place[led.astype(np.int8), code]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words and line feeds of texts without odd blanks, whether a space led to each, and how many each text has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        feed = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
        led = ~feed
        led[1:] &= ~feed[:-1]
        led[np.cumsum(sizes) - sizes] = False
        return words, led, sizes

    def cut_odd(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The same of any texts."""
        words, led, sizes = [], [], []
        for text in texts:
            found = ALONE.split(text)
            before = "\n"
            for i, x in enumerate(found):
                if i % 2 == 0 or x == "\n":
                    words.append(x)
                    led.append(before == " ")
                before = x
            sizes.append(len(found) - found[1::2].count(" "))
        return pa.array(words, pa.string()), np.array(led, dtype=bool), np.array(sizes, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has. Texts are not null."""
        if len(self.sizes) > self.most or self.chars > self.most_chars:
            self.forget()
        kind = np.zeros(len(texts), dtype=np.int8)
        if self.apart:
            kind[pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)] = 1
            for x in self.added:
                kind[pc.match_substring(texts, x).to_numpy(zero_copy_only=False)] = 2
        else:
            kind[:] = 2
        flat, begins, sizes = [], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        held = 0
        for k in (0, 1, 2):
            where = np.flatnonzero(kind == k)
            if not len(where):
                continue
            some = texts.take(pa.array(where)) if len(where) < len(texts) else texts
            if k == 2:
                coded = [np.array(self.tokenizer.encode(x.as_py(), add_special_tokens=False).ids, dtype=np.uint32) for x in some]
                ids, n = np.concatenate(coded), np.array([len(x) for x in coded], dtype=np.int64)
            else:
                words, led, counts = self.cut(some) if k == 0 else self.cut_odd(some.to_pylist())
                at = self.numbers(words, led)
                size = self.sizes[at]
                ids = gather_at(self.flat, self.begins[at], size)
                ends = np.concatenate(([0], np.cumsum(size)))
                last = np.cumsum(counts)
                n = ends[last] - ends[last - counts]
            flat.append(ids)
            begins[where], sizes[where] = held + np.cumsum(n) - n, n
            held += len(ids)
        if len(flat) == 1:
            return flat[0], sizes
        return gather_at(np.concatenate(flat or [np.zeros(0, np.uint32)]), begins, sizes), sizes


@lru_cache(maxsize=1)
def coder_of(path: str) -> Coder:
    """One for all tasks of a Python process."""
    return Coder(path)


def gather_at(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[begins[i] : begins[i] + sizes[i]] of all i on end."""
    ends = np.cumsum(sizes)
    shift = np.repeat(begins - ends + sizes, sizes)
    return flat[np.arange(len(shift)) + shift]


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows (id, text) of about so many bytes of text; one longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            stop = max(int(np.searchsorted(ends, before + most_bytes - size, "right")), at + (not held))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at, before = stop, int(ends[stop - 1])
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def open_folder(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))


def write_bytes(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move: a task run twice or lost leaves whole files only."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_part-{name}-{os.urandom(8).hex()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


FILES = "range int, file int, folder string, name string, n_docs long, n_ids long"


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, block: int = 8192, file_ids: int = 2_000_000, n_ranges: int | None = None,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """Write the ids of all texts in ascending id order; rows (range, file, folder, name, n_docs, n_ids), one a file.

    Documents are range-partitioned by id before they are tokenised, so the
    text is shuffled once and tokenised once. Each range is one task, which
    tokenises its documents in order and closes a file at ``file_ids`` ids
    (a longer document stays whole). Files have names by range and number:
    their order is the order of ids. A rerun task writes the same files.
    ``end_id`` follows each document. Run it as an action, since it writes.

    Null and empty texts give the end id alone. Repeated rows are written
    each, ties of one id by text. Rows with a null id are refused by the
    caller's filter: they are left out here, as they have no place in the
    order. An empty table writes nothing. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).where("id is not null")
    n = n_ranges or parallelism(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "t")
    types = {"range": pa.int32(), "file": pa.int32(), "folder": pa.string(), "name": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder = coder_of(tokenizer_path)
        bits, part = bits_for(coder.tokenizer.get_vocab_size()), TaskContext.get().partitionId()
        keys, lists, held, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}.tok"
            write_bytes(folder, name, to_bytes(keys, lists, bits, block))
            return pa.RecordBatch.from_pydict({
                k: pa.array([v], t) for (k, t), v in zip(types.items(), (part, number, folder, name, len(keys), held), strict=True)
            })

        for batch in blocks(batches, block_bytes):
            ids, sizes = coder.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            ends = np.cumsum(sizes + 1)
            for key, a, b in zip(batch.column(0).to_pylist(), (ends - sizes - 1).tolist(), ends.tolist(), strict=True):
                if keys and held + b - a > file_ids:
                    yield close()
                    keys, lists, held, number = [], [], 0, number + 1
                keys.append(key)
                lists.append(ids[a:b])
                held += b - a
        if keys:
            yield close()

    return ordered.mapInArrow(encode, FILES)


def placed_files(files: DataFrame) -> DataFrame:
    """``files`` with ``before``, the ids of all files before each: a prefix within each range, and one over the ranges' sums.

    Only the sums of ranges, a row for each task that wrote, meet in one task.
    """
    ranges = files.groupBy("range").agg(F.sum("n_ids").alias("total"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    within = files.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return within.join(ranges, "range").select("folder", "name", (F.col("ahead") + F.col("own")).alias("before"))


def read_tokens(spark: SparkSession, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of the files that ``write_tokens`` returned, read back.

    Each file's place in the whole order is found on the executors, and each
    file is read by one task. ``start`` counts the ids of all documents
    before, ``ids_crc32`` is of the ids as little-endian uint32. No files
    give no rows.
    """
    n = parallelism(spark)
    placed = placed_files(files).repartition(n, "name")  # a count of its own: adaptive execution would read all files in one task

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder, name, before in (row.values() for batch in batches for row in batch.to_pylist()):
            store, path = open_folder(folder)
            with store.open_input_file(f"{path}/{name}") as f:
                held = TokenFile(f.read_buffer())
            flat = held.ids(0, held.n_ids).astype("<u4")
            lists = [flat[a:b] for a, b in zip(held.starts[:-1].tolist(), held.starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(held.doc_ids, pa.int64()), pa.array(held.starts[:-1] + before, pa.int64()),
                pa.array(np.diff(held.starts), pa.int64()), pa.array([zlib.crc32(x) for x in lists], pa.int64()),
            ], names=["id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents, read back from files of ids packed in 16 bits each.

    Null texts are empty; each document ends with id 0. Rows with a null
    doc_id are in no file and have no row; repeated ids have a row each.
    """
    import public_tokenizers

    written = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "tokens"))
    return read_tokens(spark, stored(written, "token-files"))
