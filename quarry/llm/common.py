"""Shared helpers: tables, durable intermediate tables, component labelling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session has none and runs on one machine, as in tests, a
    temporary folder is made and set. A cluster without one is an error: its
    executors would each write to a folder that nobody else sees.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with replicated storage, so a lost executor costs only
    its running tasks. Used where two later steps need the same rows. A
    table lives until the folder is emptied, as results are lazy and may
    still read it, unless its caller knows better and calls ``drop``.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` returned. Nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., 2014).
    Each step sends a node's edges to the smallest neighbour, with the
    minimum as a pre-aggregated ``min`` and a join whose hot keys Spark can
    split, so neither a hub nor a long chain meets in one task. Stops when
    the edge set no longer changes; a round's table goes when the next is
    written. Edges touching nulls are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = stored(e.where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        )
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        old = e
        e = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(down.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
        drop(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
