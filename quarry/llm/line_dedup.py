"""Line dedup: drop lines that many documents share, keeping the last document's."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (id, n_lines, n_dropped, text): each row of ``docs`` with its shared lines removed.

    The columns of ``keep`` are carried along.

    Lines are exploded with their position and a 128-bit hash of their key;
    keys of ``min_chars`` code points found in ``min_docs`` distinct ids go,
    except in the largest id that holds them. Counting is pre-aggregated per
    (key, id) and per key, and the join back to positions is a plain
    equi-join that Spark splits for a hot line. The text is put together
    from the positions left.

    A null or empty text is one empty line. Repeated rows of one id count
    once and lose the same lines, each by its own positions if their texts
    differ. Rows with a null id keep all their lines and count for nothing.
    An empty table gives no rows. Other columns are ignored.
    """
    cut = docs.select(
        F.col(id_col).alias("id"), F.split(text_or_empty(text_col), "\n", -1).alias("lines"),
        F.xxhash64(text_or_empty(text_col)).alias("version"),
        F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("kept"),
    )
    keyed = cut.where("id is not null").select("id", "version", F.explode(F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("at"), line_key(x).alias("k"))),
        lambda s: F.char_length(s["k"]) >= min_chars,
    )).alias("s"))
    keyed = keyed.select("id", "version", "s.at", F.unhex(F.md5("s.k")).alias("h"))
    shared = (
        keyed.groupBy("h").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    )
    gone = keyed.join(shared, "h").where("id <> last").groupBy("id", "version").agg(F.collect_set("at").alias("gone"))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    out = cut.join(gone, ["id", "version"], "left").select("id", "lines", "kept", n.alias("n_lines"), left.alias("left"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias(text_col),
        *(F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(keep)),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256), one for each row of ``documents``; see ``dedup_lines`` for nulls, ties and repeats."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
parts AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM parts),
shared AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT p.doc_id, p.pos, p.line, s.k IS NOT NULL AND p.doc_id <> s.last_id AS gone
           FROM keyed p LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
