"""A corpus from raw documents to token ids: quality, near duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import bounded_row_groups, materialise
from heddle.llm.mixing import mixed
from heddle.llm.ngram_join import keep_one
from heddle.llm.piece_codec import encode_pieces
from heddle.llm.pii import mask_pii
from heddle.llm.quality_rules import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host's shrunk failure rate is too high, go.

    Null, empty and short texts fail; a null source is judged by the base rules alone; repeated rows stay
    or go together; an empty table stays empty, as in all stages.
    """
    bounded_row_groups(spark)
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, a null id coming last.

    Rows equal in id and text are one; rows that share an id and not the text are told apart; rows
    without words are in no group and stay.
    """
    bounded_row_groups(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows. Every row stays; null texts stay null, with a null n_chars."""
    bounded_row_groups(spark)
    out = mask_pii(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: some not at all, none more than three times.

    Null sources form one source; rows without words are taken as often as their source's whole passes;
    rows that share an id are told apart by their texts.
    """
    bounded_row_groups(spark)
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: a row for each row, repeated ones too; a null text has null ids and 0 tokens."""
    return encode_pieces(docs).select("doc_id", "source", "ids", "n_tokens", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: The mixture's knapsack isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
