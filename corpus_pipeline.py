"""A pipeline from raw documents to tokens, of five operators.

Each stage gets the documents that its predecessor kept, written as Parquet and
read again. All but the last return the columns of ``documents``; the last one
returns doc_id, the ids of the text and their digests. Nulls, empty texts and
repeated rows go through as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, jaccard, linededup, sentencepiece, toxicity
from corpusmill.llm.common import SPACES, table
from corpusmill.shared import new_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; a document of which nothing else is left goes too."""
    out = linededup.line_dedup(docs)
    left = F.length(F.btrim("text", F.lit(SPACES))) > 0
    return out.filter((F.col("n_removed") == 0) | left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, decoded again to prove them."""
    return sentencepiece.round_trip(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("sentencepiece", tokenize)]
#: SQL can't express a trained classifier or a unigram tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What one stage has written goes when the next has read it; the last one's table stays for the caller."""
    docs, place, before = table(spark, sf_dir, "documents"), new_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, f"{place}/{before}")
        before = name
    return docs
