"""MinHash near-dedup of documents with dart signatures on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import components, stored, table, text_or_empty

SIZE, BAND = 96, 4  # coordinates of a signature, of 16 bits each, and of a band
WORDS = 5
MIN_SIMILARITY = 0.8
#: Pairs whose signatures agree less than this much, in 58 of 96 coordinates, aren't compared word by word: a pair at 0.8 has less with a probability of 3e-6.
MIN_ESTIMATE = 0.6
SMALL = 12  # members of a bucket whose pairs are listed
BLOCK, BLOCK_WORDS = 1024, 4_000_000  # members of a larger bucket, and words of theirs, that meet in one task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: Column) -> Column:
    """Hashes of the words (letters, digits and _) of a text in lower case, in order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != ""), lambda x: F.hash(x))


def shingles(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle key, times) of the different shingles of texts given as word hashes on end.

    A text of fewer words than a shingle has all of its words as its only one.
    """
    sizes = np.diff(offsets)
    w = flat[offsets[0] : offsets[-1]].astype(np.int64).astype(np.uint64)
    begin = offsets[:-1] - offsets[0]
    with np.errstate(over="ignore"):
        key = np.zeros(max(0, len(w) - WORDS + 1), dtype=np.uint64)
        for i in range(WORDS if len(key) else 0):
            key = mix(key ^ w[i : len(w) - WORDS + 1 + i])
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(key)]
    last = begin + sizes - WORDS
    whole = np.arange(len(key)) <= last[of] if len(key) else np.zeros(0, dtype=bool)
    of, key = of[whole], key[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        extra = np.array([mix(np.array([hash(tuple(w[begin[i] : begin[i] + sizes[i]].tolist())) & (2**63 - 1)], dtype=np.uint64))[0] for i in short])
        of, key = np.concatenate((of, short)), np.concatenate((key, extra))
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return of[at], key[at], np.diff(at, append=len(key))


def dart_signatures(of: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """DartMinHash: n x size values; two rows agree in a coordinate with the probability of their weighted similarity.

    An element of weight w owns the unit cells 0 to w of a line (the last may
    be cut). Into each cell fall darts, one on average per unit of rank, at
    ranks, places and coordinates that only the element and the cell decide.
    A set keeps, of the darts within its weights, the one of lowest rank for
    each coordinate. Darts are thrown in rank order up to a bound by which
    all coordinates are expected to be hit; where one is not, the bound is
    doubled. So a large set throws about one dart an element. Sets without
    weight have values of 0.
    """
    cells = np.ceil(weight).astype(np.int64)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    row, room = np.repeat(of, cells), np.repeat(weight, cells) - cell
    seed = mix(np.repeat(key, cells) ^ mix(cell.astype(np.uint64)))
    total = np.bincount(of, weights=weight, minlength=n)
    out = np.zeros((n, size), dtype=np.uint16)
    bound = size * (np.log(size) + 3) / np.maximum(total, 1e-9)
    todo = total > 0
    while todo.any():
        best = np.full(n * size, np.inf)
        slots, ranks, values = [], [], []
        live = todo[row]
        s, r, d, left = seed[live], np.zeros(live.sum()), row[live], room[live]
        i = 0
        while len(s):
            i += 1
            with np.errstate(over="ignore"):
                h = mix(s + np.uint64(i) * np.uint64(0xD1342543DE82EF95))
            r = r - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            ok = r <= bound[d]
            s, r, d, left, h = s[ok], r[ok], d[ok], left[ok], mix(h[ok])
            inside = left >= 1
            if not inside.all():
                inside |= (mix(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < left
            at = (d * size + (h % np.uint64(size)).astype(np.int64))[inside]
            slots.append(at)
            ranks.append(r[inside])
            values.append((h >> np.uint64(48)).astype(np.uint16)[inside])
        slot, rank, value = np.concatenate(slots), np.concatenate(ranks), np.concatenate(values)
        np.minimum.at(best, slot, rank)
        first = best[slot] == rank
        flat = out.reshape(-1)
        flat[slot[first]] = value[first]
        todo &= np.isinf(best.reshape(n, size)).any(axis=1)
        out[todo] = 0
        bound[todo] *= 2
    return out


def sign(rows: DataFrame) -> DataFrame:
    """Rows (id, g, n, sig, low) of rows (id, g, w): n shingles, weighted by how often each occurs; no row where there are none.

    ``low`` is the low byte of each coordinate, for estimates: two values
    agree by chance once in 256.
    """
    schema = pa.schema([("id", pa.int64()), ("g", pa.binary()), ("n", pa.int32()), ("sig", pa.binary()), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            cut = np.searchsorted(np.cumsum(sizes), np.arange(400_000, sizes.sum() + 400_000, 400_000)) + 1
            steps = sorted({0, *(int(x) for x in cut if x < len(sizes)), *range(0, len(sizes), 1000), len(sizes)})
            for a, b in zip(steps, steps[1:], strict=False):
                part = batch.slice(a, b - a)
                words = part.column(2)
                offsets = words.offsets.to_numpy()
                of, key, times = shingles(words.values.to_numpy(), offsets)
                n = np.bincount(of, weights=times, minlength=b - a).astype(np.int32)
                sig = dart_signatures(of, key, times.astype(float), b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], schema=schema
                ).filter(pa.array(n > 0))

    return rows.mapInArrow(run, "id long, g binary, n int, sig binary, low binary")


def agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes and signatures allow the similarity."""
    left, right = (signed.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("low").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(
        (F.col("na") >= MIN_SIMILARITY * F.col("nb")) & (F.col("nb") >= MIN_SIMILARITY * F.col("na"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SIZE) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= MIN_ESTIMATE))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those of similarity 0.8 or more, by the shingles of ``texts`` (id, w)."""
    a, b = (texts.select(F.col("id").alias(c), F.col("w").alias(f"w{c}")) for c in "ab")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingles(part.column(k).values.to_numpy(), part.column(k).offsets.to_numpy()) for k in (2, 3)]
                n = part.num_rows
                of, key, times = (np.concatenate(x) for x in zip(*sets, strict=True))
                total = np.bincount(of, weights=times, minlength=n)
                order = np.lexsort((key, of))
                of, key, times = of[order], key[order], times[order]
                twice = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
                common = np.bincount(of[1:][twice], weights=np.minimum(times[1:], times[:-1])[twice], minlength=n)
                union = total - common
                yield part.select([0, 1]).filter(pa.array(common >= MIN_SIMILARITY * union))

    return both.mapInArrow(run, "a long, b long")


def within_blocks(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the components of one block pair: enough of them to join what is linked.

    ``rows``: (key, i, j, side, id, c, n, low, w), where a bucket's blocks i
    and j, at most about ``BLOCK`` members each, meet in the group (key, i, j).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"], ignore_index=True)
        low = np.frombuffer(b"".join(pdf["low"]), dtype=np.uint8).reshape(-1, SIZE)
        n, ids = pdf["n"].to_numpy(), pdf["id"].to_numpy()
        _, group = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        lists = pdf["w"].to_numpy()
        of, key, times = shingles(np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
        cut = np.searchsorted(of, np.arange(len(pdf) + 1))
        sets = [(key[x:y], times[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        first = int((pdf["side"] == 0).sum())
        both = first < len(pdf)
        found = []
        for k in range(first):
            start = first if both else k + 1
            may = (n[start:] >= MIN_SIMILARITY * n[k]) & (n[k] >= MIN_SIMILARITY * n[start:]) & (group[start:] != group[k])
            may = np.flatnonzero(may) + start
            agree = (low[may] == low[k]).mean(axis=1)
            for m in may[agree >= MIN_ESTIMATE][np.argsort(-agree[agree >= MIN_ESTIMATE], kind="stable")]:
                if group[m] != group[k]:
                    _, x, y = np.intersect1d(sets[k][0], sets[m][0], assume_unique=True, return_indices=True)
                    common = np.minimum(sets[k][1][x], sets[m][1][y]).sum()
                    if common >= MIN_SIMILARITY * (n[k] + n[m] - common):
                        found.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
                        group[group == group[m]] = group[k]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, copy_of, class_id, n_shingles, kept), one for each id.

    Documents are linked if their five-word shingles, weighted by how often
    each occurs, have a Jaccard similarity of 0.8 or more (the sum of the
    smaller weights, by that of the larger); a class is a connected
    component of links, its id the smallest in it, and the one kept is that
    one.

    1. Each text gets a dart signature in one pass. Equal texts become one
       representative by a pre-aggregated minimum (``copy_of``).
    2. Signatures are cut in 24 bands of 4 coordinates: a pair of similarity
       0.8 misses all of them with a probability of 3e-6. In each bucket all
       members are held against the bucket's smallest id, which costs a row a
       member, however large the bucket is. Pairs that pass are checked
       exactly, and components found.
    3. In buckets where members of several components remain, a second star
       starts from the smallest id of another component than the first's.
       Then what still differs is held against each other: the pairs of a
       bucket of at most 12, and larger ones in blocks of about 1024 members
       and four million words, in whose tasks they are checked exactly and only links that join two
       components are given. So no link is lost through step 2, and no step
       lists the pairs of a large group.

    Texts without a word, null and empty ones are linked with nothing.
    Repeated rows of one id count once, with the first text in order. Rows
    with a null id have no row. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    rows = base.select("id", F.unhex(F.md5("t")).alias("g"), words_of(F.col("t")).alias("w"))
    signed = stored(sign(rows), "signed")
    reps = signed.groupBy("g").agg(F.min(F.struct("id", "n", "sig", "low")).alias("r")).select("g", "r.*")
    reps = stored(reps, "representatives")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(SIZE // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * BAND * 2 + 1, F.lit(BAND * 2))),
    )
    buckets = reps.select("id", "n", F.explode(bands).alias("key"))
    shared = buckets.groupBy("key").agg(
        F.min("id").alias("star"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("words"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum")
    ).where("members > 1")
    # Buckets of the same members are one bucket.
    shared = shared.groupBy("star", "members", "words", "sum").agg(F.min("key").alias("key"))
    # A large bucket's blocks are of about as many members, and of about as many words.
    blocks = F.greatest(F.ceil(F.col("members") * 1.2 / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    met = stored(buckets.select("id", "key").join(shared.select("key", "star", "members", blocks.alias("blocks")).hint("merge"), "key"), "met")
    signs = reps.select("id", "n", "low")

    def texts(ids: DataFrame) -> DataFrame:
        held = base.join(ids.distinct().hint("merge"), "id", "left_semi").select("id", words_of(F.col("t")).alias("w"))
        return stored(held.dropDuplicates(["id"]), "texts")

    def checked(pairs: DataFrame) -> DataFrame:
        wanted = stored(agreeing(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), signs), "wanted")
        return stored(similar(wanted, texts(wanted.select(F.explode(F.array("a", "b")).alias("id")))), "links")

    def mixed(links: DataFrame) -> DataFrame:
        """Members, with their components c, of the buckets that hold several; ``star`` is the least id outside the first's."""
        found = stored(components(links), "components").select(F.col("node").alias("id"), "component")
        known = met.join(found.hint("merge"), "id", "left").select("key", "id", "members", "blocks", F.coalesce("component", "id").alias("c"))
        known = stored(known, "known")
        ends = known.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
        rest = known.join(ends.hint("merge"), "key")
        star = rest.where("c <> c1").groupBy("key").agg(F.min("id").alias("star"))
        return rest.join(star.hint("merge"), "key").select("key", "id", "members", "blocks", "c", "star")

    links = checked(met.select(F.col("star").alias("a"), F.col("id").alias("b")))
    links = stored(links.union(checked(mixed(links).select(F.col("star").alias("a"), F.col("id").alias("b")))), "links")
    rest = stored(mixed(links), "rest")
    small = rest.where(F.col("members") <= SMALL).select("key", "id", "c")
    pairs = small.join(small.select("key", F.col("id").alias("b"), F.col("c").alias("d")).hint("merge"), "key").where("id < b and c <> d")
    few = checked(pairs.select(F.col("id").alias("a"), "b"))
    large = rest.where(F.col("members") > SMALL)
    large = large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Block b is side 0 of (b, j >= b) and side 1 of (i < b, b).
    placed = large.select("key", "id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("other") < F.col("block"), 1).otherwise(0).alias("side"), "id", "c",
    )
    full = placed.join(signs.hint("merge"), "id").join(texts(large.select("id")).hint("merge"), "id")
    many = stored(within_blocks(full), "late-links")
    classes = stored(components(links.union(few).union(many)), "classes")

    owner = reps.select("g", F.col("id").alias("rep"))
    member = signed.groupBy("id").agg(F.min(F.struct("g", "n")).alias("x")).select("id", "x.*").join(owner, "g")
    placed = member.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.select("id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"), "n")
    every = base.select("id").distinct().join(placed, "id", "left")
    return every.select(
        F.col("id").alias(id_col), F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n", F.lit(0)).alias("n_shingles"), (F.coalesce("class_id", "id") == F.col("id")).alias("kept"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, copy_of, class_id, n_shingles, kept), one for each id of ``documents``; see ``near_duplicates`` for nulls, ties and repeats."""
    return near_duplicates(table(spark, sf_dir, "documents"))
