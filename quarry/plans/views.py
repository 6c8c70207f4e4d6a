"""The engine's concepts as views over a folder of tables.

Each view has the SQL text of the same relation next to it, which the
queries' SQL is put together from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import line_count, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: key, path, zone, language, lines, bytes and tokens."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("unit:"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("key"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.col("doc_id").alias("id"), F.col("source").alias("zone"), F.col("lang").alias("language"), text.alias("text"),
        line_count(text).alias("loc"), F.octet_length(text).cast("long").alias("bytes"), tokens(F.char_length(text)).alias("tokens"),
    )


UNITS = """units AS (SELECT 'unit:' || source || '/' || doc_id || '.' || lang AS key, source || '/' || doc_id || '.' || lang AS path,
  doc_id AS id, source AS zone, lang AS language, coalesce(text, '') AS text,
  (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS loc,
  strlen(text)::BIGINT AS bytes, round(length(text) / 4.0::DOUBLE)::BIGINT AS tokens FROM documents)"""


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits (orders) and the files (parts) that they touch, once each."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file")).distinct()
    order = table(spark, sf_dir, "orders").where(~F.startswith("o_orderpriority", F.lit("Merge ")))
    return line.join(order.select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts")), "hash")


TOUCHES = """touches AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS file, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE NOT starts_with(o_orderpriority, 'Merge '))"""


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with lines (p_size), churn and recency in days (999 if never touched)."""
    t = touches(spark, sf_dir)
    now = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("now"))
    git = t.groupBy("file").agg(F.count(F.lit(1)).alias("churn"), F.max("ts").alias("last"))
    git = git.join(F.broadcast(now)).select(
        "file", "churn", F.floor((F.unix_timestamp("now") - F.unix_timestamp("last")) / 86400).cast("long").alias("recency")
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file"), F.col("p_brand").alias("zone"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("loc"), F.col("p_name").alias("name")
    )
    return part.join(git, "file", "left").select(
        "file", "zone", "language", "name", "loc", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), F.coalesce("recency", F.lit(999)).cast("long").alias("recency")
    )


STATS = f"""{TOUCHES}, stats AS (SELECT p_partkey AS file, p_brand AS zone, p_type AS language, p_name AS name, p_size::BIGINT AS loc,
  coalesce(churn, 0)::BIGINT AS churn, coalesce(recency, 999)::BIGINT AS recency FROM part LEFT JOIN (
    SELECT file, count(*) AS churn, floor(epoch((SELECT max(o_orderdate) FROM orders) - max(ts)) / 86400)::BIGINT AS recency FROM touches GROUP BY file
  ) g ON g.file = p_partkey)"""


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files of one order, one line to the next; the strongest confidence of equal ones."""
    line = table(spark, sf_dir, "lineitem")
    a = line.where("l_quantity >= 47").select(
        F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"),
        F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.5).alias("confidence"),
    )
    b = line.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["o", "n"]).where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


EDGES = """edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, max(CASE WHEN a.l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 47 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""
