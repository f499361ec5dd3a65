"""Shared helpers of the corpus operators: shared folders, written tables, connected components."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Words of the operator contracts: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


ARROW_ROWS, MAX_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; also lets Python workers import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get(ARROW_ROWS)) > MAX_ARROW_ROWS:  # texts are long: fewer rows at once in a Python worker
        spark.conf.set(ARROW_ROWS, MAX_ARROW_ROWS)
    shared = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    whole = shared.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(shared).toString()  # with scheme: the same place for Spark and for workers
    return f"{whole.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this run has written and needs no more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component) of the nodes on ``edges`` (a, b: long or comparable); component: smallest node reachable.

    Large-star and small-star steps in turn: every step aggregates a minimum
    per node (combined before the shuffle) and joins it back, so a node with
    very many edges never gathers in one task; the minima are written first, so
    that both join sides are plain shuffles, which AQE can split when skewed.
    Each step is a written table; the older ones are deleted. Null ends give no edge.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").filter("a <> b")
    step = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    before, turn = None, 0
    while True:
        # a > b in every row: b is the smaller neighbour
        turn += 1
        around = step.union(step.select("b", "a"))
        low = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), folder, f"{name}-{turn}-low")
        # large star: each larger neighbour of a node goes to the node's minimum
        large = step.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), folder, f"{name}-{turn}-large")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), folder, f"{name}-{turn}-least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = written(small.distinct(), folder, f"{name}-{turn}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in ([f"{name}-{turn}-low", f"{name}-{turn}-large", f"{name}-{turn}-least", f"{name}-{turn - 1}"]):
            remove(spark, f"{folder}/{old}")
        step = new
        if now == before:
            break
        before = now
    return step.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        step.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def file_system(folder: str):
    """(pyarrow file system, path) of a shared folder given as a path or URI."""
    from pyarrow import fs
    if folder.startswith("file:/") and not folder.startswith("file://"):  # as Hadoop writes it
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
