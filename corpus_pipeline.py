"""A training corpus from raw documents: quality, near copies, repeated strings, benchmark leaks, packing.

Each stage works on all that the one before it kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, minhash_dedup, packing, quality_classifier, suffix_dedup
from tracewell.llm.tables import held_out, row_key, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Texts are near copies from a Jaccard of 0.8 of their word shingles; a pair at 0.8 shares no
#: bucket with probability 4e-7, and its signatures' estimate has a standard deviation of 0.03.
NEAR = minhash_dedup.MinHash(percent=80, bands=37)

#: Strings of 256 bytes, some 45 words of prose, so that a passage of over 50 words is found whole.
STRINGS = suffix_dedup.Suffixes(length=256)


#: A row's key and its id: rows with both in common have equal texts and ids.
ROW = ["row", "own"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, row_key().alias("row"), own())


def own() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("own")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Each row is judged by its own text: null texts as empty ones, rows without or with equal ids each.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    accepted = quality_classifier.classify(docs, labels, ~held_out(4, 2)).where("score >= 0.7").select("row", own())
    return keyed(docs).join(accepted, ROW, "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (NEAR), that with the least id; of repeated rows, one.

    Rows with equal ids but texts that are linked both stay where theirs is the least id, as do
    linked rows that all lack an id.  Texts without words are linked with nothing and stay.
    """
    kept = minhash_dedup.near_duplicates(docs, NEAR).where("kept").select(*ROW)
    return keyed(docs).join(kept, ROW, "left_semi").dropDuplicates(ROW).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings (STRINGS) that occur elsewhere too; what is empty then goes, what was empty stays.

    Null texts become empty ones.  Repeated rows repeat each other.
    """
    left = suffix_dedup.remove_repeats(docs, STRINGS, carry=("lang", "source")).where("n_removed = 0 or trim(kept_text) <> ''")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged by its own text, null ones have none.

    Repeated rows stay or go together.  Where the benchmark is empty all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.decontaminate(docs, benchmark).where("not contaminated").select("row", own())
    return keyed(docs).join(clean, ROW, "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null texts are empty and are the end's token alone.

    Repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", leaks), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Neither boosted trees nor a tokenizer can be put in SQL.
ORACLE_SQL = None
