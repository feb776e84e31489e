"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; it is written as Parquet and read again in between. All but the last
return the columns of ``documents``. Before each the executors let go of the memory of the one before.

Null ids never name a document: line dedup leaves their lines alone, near-dedup
and decontamination judge their texts. Of ties the smaller id, and of its lines the earlier, stays; rows that
repeat id and text are one document to line dedup, and near-dedup keeps one of them. Null texts have no language
and go at once. Empty tables go through empty, and other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bpe, decontam, langid, linededup, minhash
from quirework.llm.common import cut, rest, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough."""
    rest(spark)
    return langid.keep_known(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; their length follows, and those left empty go."""
    rest(spark)
    out = linededup.without_repeats(docs)
    left = out.filter((F.col("_n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length.cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    rest(spark)
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    rest(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document as digests."""
    rest(spark)
    return bpe.encode_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Language ID and BPE can't be told in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
