"""The corpus pipeline: from raw documents to packed sequences.

Each stage works on what the one before it kept, written to the shared folder
and read again.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.llm.columns import kept
from tablefit.llm.mixing import resample
from tablefit.llm.packing import pack
from tablefit.llm.queries import LANGUAGE_WEIGHTS
from tablefit.llm.simhash import keep_one
from tablefit.llm.substrings import strip_repeats
from tablefit.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links: 4-word shingles, at most 4 bits apart."""
    return keep_one(docs, k=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; no document goes."""
    return strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of scarce languages up to the target shares; no document goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    labelled = docs.select("doc_id", "lang").join(labels, "doc_id", "left_semi")
    return resample(docs, labelled, LANGUAGE_WEIGHTS, domain_col="lang", floor=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The stages fit models and walk graphs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
