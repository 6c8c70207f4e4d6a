"""Whitening of embeddings by the singular values of their centred rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

STEP, SHIFT = 64, 1_000_000  # a component c becomes floor(STEP * c) + SHIFT
LARGEST = 1 << 40  # floor(STEP * c) is held within this, so that sums of a billion rows are exact
COMPONENTS = 32
WHOLE_GRAM = 4096  # up to so many dimensions all singular values are asked for, which MLlib takes from one pass over the rows
LEAST = 1e-12  # a component with less of the largest variance is rounding


@dataclass
class Whitening:
    """A fit: ``n`` rows, whole means and remainders of the sums by n, components as columns, their variances and shares."""

    n: int
    whole: list[int]
    rest: list[int]
    components: np.ndarray
    variances: np.ndarray
    shares: np.ndarray


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors without null or non-finite entries, as whole numbers, of the length that most of them have."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("v", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * STEP, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT)
    good = rows.where(F.col("v").isNotNull() & ~bad).select("id", x.alias("x"))
    sizes = good.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0").orderBy(F.desc("n"), "dims").first()
    return good.where(F.size("x") == (sizes["dims"] if sizes else -1))


def centred(rows: DataFrame, fit_whole: list[int], fit_rest: list[int], n: int) -> DataFrame:
    """Adds ``centred``, x - S / n, and ``deviation``, the sum of (n x - S)^2, exact.

    With S = n * whole + rest, n x - S is n (x - whole) - rest: small whole
    numbers, so that neither large means nor large sums lose digits.
    """
    parts = F.arrays_zip(F.col("x"), F.array(*map(F.lit, fit_whole)).alias("w"), F.array(*map(F.lit, fit_rest)).alias("r"))
    near = F.transform(parts, lambda t: F.struct((t["x"] - t["w"]).alias("d"), t["r"].alias("r")))
    with_near = rows.withColumn("near", near)
    wide = lambda c: c.cast("decimal(19,0)")
    gap = F.transform("near", lambda t: (wide(t["d"]) * F.lit(n).cast("decimal(12,0)") - wide(t["r"])).cast("decimal(19,0)"))
    squares = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g * g).cast("decimal(38,0)"))
    return with_near.select("id", "x", F.transform("near", lambda t: t["d"] - t["r"] / F.lit(float(n))).alias("centred"), squares.alias("deviation"))


def matrix_of(rows: DataFrame, col: str) -> RowMatrix:
    """The arrays of a column as MLlib's distributed rows, without passing through Python."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(col).alias("v")), "v"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of rows (id, x), and the rows with ``centred`` and ``deviation``, stored.

    ``computeSVD`` runs over the centred rows: a singular value s is the root
    of n times a variance. The total variance is not the sum of those but of
    the exact deviations. Components whose variance is nothing but rounding
    are left out.
    """
    by_place = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sorted(by_place.collect())  # a row a dimension
    if not sums:
        return None, rows.select("id", "x", F.array().cast("array<double>").alias("centred"), F.lit(None).cast("decimal(38,0)").alias("deviation"))
    n, dims = sums[0]["n"], len(sums)
    whole, rest = zip(*(divmod(int(r["s"]), n) for r in sums), strict=True)
    held = stored(centred(rows, list(whole), list(rest), n), "centred")
    total = held.agg(F.sum("deviation")).first()[0]
    if not total:
        return Whitening(n, list(whole), list(rest), np.zeros((dims, 0)), np.zeros(0), np.zeros(0)), held
    asked = dims if dims <= WHOLE_GRAM else min(dims, components)
    svd = matrix_of(held, "centred").computeSVD(asked, computeU=False)
    e = np.array(svd.s.toArray()) ** 2 / n
    columns = np.array(svd.V.toArray())
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > LEAST * e.max()]
    trace = int(total) / n**3
    return Whitening(n, list(whole), list(rest), columns[:, order], e[order], e[order] / trace), held


def whitened(held: DataFrame, model: Whitening) -> DataFrame:
    """Adds ``whitened``: the centred rows projected on the components, over the roots of their variances."""
    turn = model.components / np.sqrt(model.variances)
    kept = [f for f in held.schema.fields if f.name not in ("x", "centred")]
    names = [f.name for f in kept]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("centred"))
            got = lists.flatten().to_numpy().reshape(-1, turn.shape[0]) @ turn
            ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.ListArray.from_arrays(ends, pa.array(got.ravel()))], names=[*names, "whitened"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return held.select(*names, "centred").mapInArrow(project, f"{schema}, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """Rows (id, deviation, whitened), the fit, and the identity error of the whole table.

    A vector that is null, or holds null or non-finite entries, has no row.
    Entries beyond 2^40 / 64 count as that. A covariance needs vectors of one
    length: those of another than the most frequent one (of equally frequent
    ones, the shortest) have no row. Repeated rows and null ids have rows of
    their own. A table without variance, or without rows, has a fit without
    components (None without rows) and no identity error. Other columns are
    ignored.

    The sums, the total variance and the covariance of the whitened rows are
    aggregates over all rows; of a size by dimensions alone comes to the
    driver. Up to 4096 dimensions the singular values come from one pass;
    beyond, MLlib iterates over the stored rows.
    """
    model, held = fit(stored(usable(vectors, id_col, vector_col), "whole-vectors"), components)
    if model is None or not len(model.variances):
        return held.select("id", "deviation", F.array().cast("array<double>").alias("whitened")), model, None
    done = stored(whitened(held, model), "whitened")
    # The rows are centred before they are projected, so the mean of each component is nothing but rounding.
    gram = np.array(matrix_of(done, "whitened").computeGramianMatrix().toArray()) / model.n
    return done, model, float(np.abs(gram - np.eye(len(gram))).max())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of ``embeddings``; see ``whiten`` for odd rows.

    A deviation beyond the largest long is null. Without variance there are
    no components, and so no rows.
    """
    done, model, error = whiten(table(spark, sf_dir, "embeddings"))
    shares = model.shares.tolist() if model is not None else []
    each = done.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model is not None else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
