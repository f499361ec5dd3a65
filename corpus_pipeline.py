"""Corpus pipeline: documents -> quality rules -> line dedup -> near-dedup -> mixing -> packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. Stages work on all that their predecessor kept; rows with null ids or texts, repeated rows,
empty tables and extra columns are handled as their operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.common import run_folder, written
from gridpulse.llm.fertility import quality
from gridpulse.llm.linededup import line_dedup
from gridpulse.llm.mixing import draw, mix
from gridpulse.llm.packing import pack
from gridpulse.llm.simhash import one_of_each

HAS_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rule keeps."""
    run_folder(spark, "quality")
    return quality(docs, with_row=True).filter("kept").select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that lose all their words that way go."""
    edited = line_dedup(docs, run_folder(spark, "lines"))
    return edited.filter((F.col(edited.columns[-1]) == 0) | F.regexp_like("text", F.lit(HAS_WORD))).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    return one_of_each(docs, run_folder(spark, "near"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document with its rate's chance, at most once. Plain documents are to stay whole; the other domains are thinned to their weights."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    folder = run_folder(spark, "mix")
    return draw(docs, written(mix(docs, labels, folder, whole="plain", max_rate=1.0), folder, "rates"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    pieces = pack(docs, run_folder(spark, "pack"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_deduplication", line_deduplication), ("simhash_near_dedup", simhash_near_dedup),
          ("mixing", mixing), ("packing", packing)]

#: Tokenizers, the classifier's fit and near-duplicate components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder, docs = run_folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), folder, name)
