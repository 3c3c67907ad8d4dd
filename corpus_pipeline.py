"""A training-corpus pipeline: toxic documents go, exact copies go, one of each group of near copies stays,
sources are mixed to target weights, and the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the
shared folder and reads it again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitgrove.llm import bpe, exact_dedup, mixing, simhash, toxicity
from bitgrove.llm.base import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_targets(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their number: the documents as the trainer reads them."""
    made = bpe.encode(docs, bpe.tokenizer_source(), keep=("doc_id", "source"))
    return made.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: The first and the third stage rest on a trained model and on sampled bits: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
