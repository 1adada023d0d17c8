"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents. run() writes each stage's result to the shared folder
and reads it back for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import decontaminate, line_dedup, ngram_join, packing, quality
from lexiweave.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; without labels, or with labels of one kind, all. Null ids and repeated rows are scored like others."""
    ranker = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality.scored(docs, ranker, docs.columns, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that loses all its words so goes, for its lines stand elsewhere."""
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (none comes last). Unlike documents stay whatever their ids; rows that repeat id and text leave one."""
    return ngram_join.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to the contract's measure; empty ones stay, an empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of 2048; an empty text is a piece of the end id alone, repeated rows are packed each."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier can't be put in SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
