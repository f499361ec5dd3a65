"""Equal rows by the thousand, self-overlapping runs, sizes beyond 64 bits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.llm import linededup, sharding, topk
from plan_tools import shuffled_rows


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup_combines_equal_rows_before_the_shuffle(spark, tmp_path):
    passage = "\n".join(f"line {k} of the passage with some words in it" for k in range(8))
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("own words\n" + passage).alias("text")).union(docs(spark, [(9, "b\n" + passage)]))
    lines = df.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first(F.split("text", "\n")).alias("lines"))
    lines.collect()
    assert shuffled_rows(lines) < 100  # the grouping that the operator uses
    got = {r.doc_id: (r.text, r.n) for r in linededup.line_dedup(df, str(tmp_path / "w")).groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert got == {7: ("own words\n" + passage, 100_000), 9: ("b", 1)}


def test_line_dedup_of_a_run_over_itself(spark, tmp_path):
    rows = [(1, "\n".join(["one line of five words"] * 30)), (2, "\n".join(["short line here"] * 3)), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, rows), str(tmp_path / "w")).collect()}
    assert got == {1: "one line of five words", 2: "short line here\nshort line here\nshort line here", 3: None, 4: ""}


def test_shards_without_a_number_of_files(spark, tmp_path):
    df = docs(spark, [(i % 50, f"text {i % 50}") for i in range(3_000)] + [(None, None)])
    shards = ("b", "a", "c")
    got = sharding.write_shards(df, str(tmp_path / "s"), ["doc_id"], shards, 101)
    want = sharding.place(df, ["doc_id"], shards, 101)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_scores_beyond_64_bits_are_an_error():
    big = np.array([[2 ** 40, 2 ** 20]], "i8")
    with pytest.raises(OverflowError):
        topk.inner(big, big)
    a, b = np.array([[2 ** 33, 1]], "i8"), np.array([[2 ** 29 - 1, 3]], "i8")
    assert topk.inner(a, b).tolist() == [[2 ** 33 * (2 ** 29 - 1) + 3]]


def test_components_beyond_64_bits_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(50, [1e30]), (51, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, str(tmp_path / "w")).collect()
