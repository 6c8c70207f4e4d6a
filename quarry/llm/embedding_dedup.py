"""Embedding near-dedup by collision counting on sorted projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import components, stored, table

PROJECTIONS = 24
WINDOW = 2.0  # half a window, in standard deviations of the difference of a pair at the threshold
MAX_MISS = 1e-4  # of the pairs at the threshold; closer pairs are missed less often
BLOCK = 4096  # vectors of a label that meet in one task


def needed_count(n: int = PROJECTIONS, window: float = WINDOW, max_miss: float = MAX_MISS) -> int:
    """The highest count of collisions that at most ``max_miss`` of the pairs at the threshold don't reach.

    A projection on a Gaussian vector takes a pair at distance d to a normal
    difference of deviation d, so the count is binomial.
    """
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > max_miss:
            return k
    return n


class Lines:
    """The sorted projections of one side, as the rank of each of its vectors on each line."""

    def __init__(self, lines: np.ndarray) -> None:
        order = np.argsort(lines, axis=0, kind="stable")
        self.sorted = np.take_along_axis(lines, order, axis=0)
        self.ranks = np.empty(lines.shape[::-1], dtype=np.uint16 if len(lines) < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order.T, np.arange(len(lines), dtype=self.ranks.dtype)[None, :], axis=1)

    def collisions(self, queries: np.ndarray, half: float) -> np.ndarray:
        """How often each vector lies in the window of each query, over the lines (columns).

        A window is a range of ranks, found by bisection. A rank less the
        range's begin is below the range's size inside, and wraps around to
        a large number on the left of it.
        """
        counts = np.zeros((len(queries), self.ranks.shape[1]), dtype=np.uint8)
        place, inside = np.empty(counts.shape, dtype=self.ranks.dtype), np.empty(counts.shape, dtype=bool)
        for p, ranks in enumerate(self.ranks):
            low = np.searchsorted(self.sorted[:, p], queries[:, p] - half, "left").astype(ranks.dtype)
            high = np.searchsorted(self.sorted[:, p], queries[:, p] + half, "right").astype(ranks.dtype)
            np.subtract(ranks[None, :], low[:, None], out=place)
            np.less(place, (high - low)[:, None], out=inside)
            counts += inside.view(np.uint8)
        return counts


def blocks_of(rows: DataFrame, min_cosine: float) -> DataFrame:
    """Of rows (label, dims, i, j, side, id, copies, unit): partial sums (id, links, to) of each block pair.

    A row with ``to`` null adds the copies that are linked with an id; one
    with ``to`` is a link that joins two parts of the block pair.
    """
    half = WINDOW * math.sqrt(2 - 2 * min_cosine)
    least = needed_count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"], ignore_index=True)
        unit = np.stack(pdf["unit"].to_list()).astype(np.float64)
        lines = unit @ np.random.default_rng(11).standard_normal((unit.shape[1], PROJECTIONS))
        first = int((pdf["side"] == 0).sum())
        alone = first == len(pdf)
        start = 0 if alone else first
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        links, part, joins = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf)), []
        side = Lines(lines[start:])
        for a in range(0, first, 128):
            b = min(first, a + 128)
            counts = side.collisions(lines[a:b], half)
            for q in range(a, b):
                found = np.flatnonzero(counts[q - a] >= least) + start
                found = found[found > q] if alone else found
                found = found[unit[found] @ unit[q] >= min_cosine]
                if not len(found):
                    continue
                links[q] += copies[found].sum()
                links[found] += copies[q]
                others, at = np.unique(part[found], return_index=True)
                for k in at[others != part[q]]:
                    joins.append((ids[q], ids[found[k]]))
                part[np.isin(part, others)] = part[q]
        some = links > 0
        out = pd.DataFrame({"id": ids[some], "links": links[some], "to": pd.array([None] * int(some.sum()), dtype="Int64")})
        more = pd.DataFrame(joins, columns=["id", "to"], dtype="int64").assign(links=0)
        more["to"] = more["to"].astype("Int64")
        return pd.concat([out, more[["id", "links", "to"]]], ignore_index=True)

    return rows.groupBy("label", "dims", "i", "j").applyInPandas(run, "id long, links long, to long")


def link_embeddings(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = 0.93
) -> DataFrame:
    """Rows (id, n_links, component_id, kept, copy_of), one for each id.

    Vectors of one label, not null, are linked at a cosine of ``min_cosine``
    or more in double precision. Equal vectors of a label become one, with
    their number, before anything meets. A label's vectors are dealt into
    blocks of about 4096 by a hash of the id, and each pair of blocks is a
    task: each of 24 Gaussian projections is sorted, each vector's window
    counts those within two deviations of a pair at the threshold, and pairs
    with the calibrated count are verified. The tasks give sums of links and
    the links that join components, a row a vector at most for each, and
    never the pairs of a group. The work grows with the square of a label's
    different vectors, in tasks of bounded size.

    Vectors that are null, empty or zero or hold null or non-finite
    components, and those of a null label, are linked with nothing. Vectors
    of other dimensions are not compared. Of rows with one id the first in
    the order of label and vector counts. Rows with a null id have no row.
    """
    base = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(F.struct(F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))).alias("x")
    ).select("id", "x.*")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    peak = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("peak"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x * x))
    good = base.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("peak", peak).where("peak > 0")
    good = good.withColumn("s", scaled).withColumn("norm", norm)
    good = good.select("id", "label", F.transform("s", lambda x: x / F.col("norm")).alias("unit"))
    good = stored(good.select("id", "label", F.size("unit").alias("dims"), "unit", F.md5(F.array_join("unit", ",")).alias("g")), "vectors")
    one = good.groupBy("label", "g").agg(F.min(F.struct("id", "dims", "unit")).alias("r"), F.count(F.lit(1)).alias("copies"))
    one = stored(one.select("label", "g", "r.*", "copies"), "different")
    sizes = one.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) * 1.1 / BLOCK).cast("int").alias("blocks"))
    dealt = one.join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = dealt.select("label", "dims", "id", "copies", "unit", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select(
        "label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("other") < F.col("block"), 1).otherwise(0).alias("side"), "id", "copies", "unit",
    )
    got = stored(blocks_of(placed, min_cosine), "links")
    links = got.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    found = components(got.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = one.join(links, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "g", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    done = good.select("id", "label", "g").join(known, ["label", "g"]).select("id", "rep", "n_links", "component_id")
    out = base.select("id").join(done, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("id")).alias("kept"), F.coalesce("rep", "id").alias("copy_of"),
    )


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept, copy_of), one for each id of ``embeddings``; see ``link_embeddings`` for nulls and repeats."""
    return link_embeddings(table(spark, sf_dir, "embeddings"))
