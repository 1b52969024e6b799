"""Corpus pipeline: the documents table through five operators, each on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
documents. Quality rules let whole documents go and take the lines above the limit out of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm.common import cut, read_table
from tablesync.llm.lines import line_dedup
from tablesync.llm.mixing import mixed_documents
from tablesync.llm.pieces import round_trip
from tablesync.llm.quality import kept_documents
from tablesync.llm.simhash import near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses all its lines stays, empty."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes more than once is there as often."""
    return mixed_documents(docs).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text decoded from them."""
    done = round_trip(docs.select("doc_id", "source", "text"))
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", pieces),
]

# The sampling and the piece table are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
