"""Corpus pipeline: quality rules, near duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents; `run` writes each stage's result to the shared folder and reads it
again, so a lost executor costs one stage at most.

Defined results of `run`: a null text is an empty one: the base rule of the first stage rejects it (fewer than 50
words), as it does short texts; rows that share a doc_id go or stay together in the first two stages, copies of a
document are near duplicates of each other, and of rows equal in id and text one piece list each is packed; an empty
documents table, or one of which nothing is kept, gives no rows in the schema of the last stage; extra columns travel
up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boqspark.llm.common import fresh_path
from boqspark.llm.jaccard_join import stage_near_duplicates
from boqspark.llm.packing import stage_packing
from boqspark.llm.quality_rules import stage_quality
from boqspark.llm.substring_dedup import stage_substrings

STAGES = [
    ("quality rules", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("substring dedup", stage_substrings),
    ("packing", stage_packing),
]
#: Learned rules and tokenizers have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
