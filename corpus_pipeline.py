"""From documents to packed sequences: language, near-duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscrub.llm.fmindex import decontaminated
from rowscrub.llm.langid import held_out_fold, train, with_language
from rowscrub.llm.neardup import near_duplicates
from rowscrub.llm.packing import pack_documents
from rowscrub.llm.rounds import written
from rowscrub.llm.substrings import removed_words

TOKENIZER = "byte_bpe_50k.json"
FOLDS = 5


def _documents(changed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents from doc_id, kept text and the carried rest; documents left without a word go.

    n_chars follows the text where it has changed.
    """

    def column(name: str):
        if name == "doc_id":
            return F.col("doc_id").cast(like.schema[name].dataType).alias(name)
        if name == "text":
            return F.col("kept").alias(name)
        rest = F.col(f"rest.`{name}`")
        return (F.when(F.col("changed"), F.length("kept")).otherwise(rest).cast(like.schema[name].dataType) if name == "n_chars" else rest).alias(name)

    full = changed.where(~F.col("changed") | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return full.select(*(column(name) for name in like.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language can be told; null texts and texts without a letter go."""
    return with_language(docs, *train(docs.where(~held_out_fold(FOLDS))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the least doc_id, a null one last, and the least key of equal ones.

    The key of a row is a hash of its doc_id and text, so rows without an id and rows that share one are told apart; rows
    that are equal in both are copies, of which one stays.
    """
    name = "row" + "_" * max(map(len, docs.columns))
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text").cast("string")))
    rows = keyed.select(F.col(name).alias("doc_id"), "text")
    classes = near_duplicates(rows).distinct().withColumnRenamed("doc_id", name)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(name))
    least = keyed.select(name, "doc_id").join(classes, name).groupBy("class_id").agg(F.min(order)[name].alias(name))
    copies = Window.partitionBy(name).orderBy("doc_id")
    stay = keyed.join(least.select(name), name, "left_semi").withColumn(name + "_", F.row_number().over(copies))
    return stay.where(F.col(name + "_") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents before them contain."""
    found = removed_words(docs, carry=True)
    return _documents(found.withColumn("changed", F.col("n_removed") > 0), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that occurrences of benchmark windows cover."""
    found = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return _documents(found.withColumn("changed", F.col("contaminated")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
