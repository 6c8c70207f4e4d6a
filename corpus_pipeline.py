"""From documents to token ids: toxicity, line dedup, near dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_round_trip
from quarry.llm.common import stored, table
from quarry.llm.decontaminate import find_contamination
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.toxicity import score, trained


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all columns in one, so that no name of theirs clashes with what an operator adds."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go. Null and empty texts stay, as do null ids, by their texts."""
    return score(carried(docs), trained(spark, docs, sf_dir), keep=("row",)).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but the last; n_chars follows the text.

    A document all of whose lines go stays, with an empty text. Rows with a
    null id keep their lines.
    """
    rest = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "n_chars"))).alias("row"))
    done = dedup_lines(rest, keep=("row",))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays. Rows with a null doc_id stay."""
    gone = stored(near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Rows with a null doc_id stay."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct()
    found = stored(found, "contaminated")  # usually few: Spark knows its size, and broadcasts it below its threshold
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document left."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# The toxicity model is fitted by gradient descent, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
