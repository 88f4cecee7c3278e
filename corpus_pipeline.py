"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the
shared folder as Parquet and gives them to the next. All stages but the last return the columns of
documents. Null texts, ties, repeated rows, empty tables and extra columns follow the operators' contracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.llm import classifier, mixing, packing, rules, simhash
from larkspan.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from the labelled rows of sf_dir."""
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = classifier.scored(docs, model)
    return scored.where(F.col("score") >= 0.5).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return rules.quality_rules(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whatever ids it has: the one with the group's smallest
    doc_id, one without an id only where no row of the group has any. Of rows that share that doc_id one
    stays, by a hash of the content; rows are told apart by text and all other columns."""
    others = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    rows = docs.withColumn("_row", F.concat_ws(":", F.hex(F.xxhash64(*others)), F.md5(F.col("text"))))
    keep = simhash.survivors(rows.select("doc_id", "text", F.col("_row").alias("row")))
    once = rows.withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy("doc_id"))).where("_n = 1")
    return once.join(keep, F.col("_row") == F.col("row"), "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, from not at all to three times."""
    return mixing.repeated(mixing.mix(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; repeated documents are packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fingerprints, the classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
