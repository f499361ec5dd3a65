"""Line deduplication by winnowing over line hashes.

Lines with a word are hashed. From each line starts a gram: the lines from it up to ``gram_words`` words. A winnowing window
holds the grams that start within ``min_words - gram_words`` words; its smallest gram hash is a fingerprint. A window depends only on the
``min_words`` words it covers, so a run of lines with that many words that occurs in two places gives at least one common fingerprint. A
fingerprint's later positions are joined with its first one (a star: linear in the positions, never all pairs), matches are
extended line by line both ways, and the later run is deleted. That first one may stand in another context, so each fingerprint also carries
the hashes of the windows that picked it, which are joined with their own first position when the fingerprint repeats. The first copy stays. Only
DataFrame functions are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, run_folder, text_of, written

MIN_WORDS = 50
GRAM_WORDS = 25


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of (hash, pos), by hash."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["hash"] == y["hash"]), False)
    return F.when(n == 0, F.lit(0)).when(differs > 0, differs - 1).otherwise(n).cast("int")


def repeated_lines(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS,
                   gram_words: int = GRAM_WORDS) -> DataFrame:
    """(i, h, gone): the line numbers (from 0) that go, of each document (id i, text hash h) that loses any."""
    if not 0 < gram_words <= min_words:
        raise ValueError("gram_words must be from 1 to min_words")
    text = text_of(text_column)
    hashed = F.transform(F.split(text, "\n"), lambda line, pos: F.struct(
        pos.alias("pos"), F.xxhash64(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))).alias("hash"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    # rows with equal ids and texts are one document, and one row a task before the shuffle, which serves the grouping and the windows
    docs = docs.select(F.col(id_column).alias("i"), F.xxhash64(text).alias("h"), F.filter(hashed, lambda x: x["words"] > 0).alias("lines"))
    lines = docs.groupBy("i", "h").agg(F.first("lines").alias("lines")).select("i", "h", F.inline("lines"))
    doc = Window.partitionBy("i", "h")
    lines = lines.withColumn("before", F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    by_words, reach, line = doc.orderBy("before"), min_words + gram_words, F.struct("hash", "pos")
    # windows from a line: the shortest with min_words, and those that go on to a line that ends fewer than min_words behind this one; any longer run is made of them
    ends = doc.orderBy("end")
    lines = (lines.withColumn("end", F.col("before") + F.col("words"))
             .withColumn("whole", F.collect_list(line).over(ends.rangeBetween(0, min_words - 1)))
             .withColumn("over", F.collect_list(line).over(by_words.rangeBetween(0, min_words - 1)))
             .withColumn("full", F.sum("words").over(by_words.rangeBetween(0, min_words - 1)) >= min_words)
             .withColumn("most", F.when(F.size("whole") > F.size("over"), F.col("whole")).otherwise(F.col("over")))
             .withColumn("wins", F.when(F.col("full"), F.transform(F.sequence(F.size("over"), F.size("most")), lambda n: F.struct(
                 F.xxhash64(F.transform(F.slice("most", 1, n), lambda x: x["hash"])).alias("key"), F.transform(F.slice("most", 1, n), lambda x: x["pos"]).alias("at")))))
             .drop("end", "whole", "over", "full", "most"))
    lines = (lines.withColumn("left", F.collect_list(line).over(by_words.rangeBetween(-reach, -1)))
             .withColumn("right", F.collect_list(line).over(by_words.rangeBetween(0, reach)))
             .withColumn("n", F.count("*").over(by_words.rangeBetween(0, gram_words - 1)).cast("int"))
             .withColumn("enough", F.sum("words").over(by_words.rangeBetween(0, gram_words - 1)) >= gram_words)
             .withColumn("gram", F.when(F.col("enough"), F.xxhash64(F.transform(F.slice("right", 1, F.col("n")), lambda x: x["hash"])))))
    # a fingerprint is the smallest gram of the window that starts at its line or at one before it
    span = min_words - gram_words
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "before"))).over(by_words.rangeBetween(0, span))
    lines = lines.withColumn("least", least)
    picked = F.collect_list(F.when(F.col("least").isNotNull(), F.struct(F.col("least.before").alias("before"), "wins"))).over(by_words.rangeBetween(-span, 0))
    lines = lines.withColumn("picks", F.filter(picked, lambda x: x["before"] == F.col("before")))
    wins = F.flatten(F.transform("picks", lambda x: F.coalesce(x["wins"], F.array().cast("array<struct<key:bigint,at:array<int>>>")))).alias("wins")
    prints = written(lines.filter("gram is not null and size(picks) > 0").select("i", "h", "pos", "gram", "n", "left", "right", wins), folder, "prints")
    # combined before the shuffle: a passage in a third of all documents is one row a task
    first = (prints.groupBy("gram").agg(F.min(F.struct("i", "h", "pos", "left", "right")).alias("first"), F.count("*").alias("times")).filter("times > 1")
             .select("gram", "first"))
    first = written(first, folder, "first")
    later = ~(F.col("i").eqNullSafe(F.col("first.i")) & (F.col("h") == F.col("first.h")) & (F.col("pos") == F.col("first.pos")))
    met = (prints.join(first.hint("merge"), "gram").withColumn("after", _common(F.col("right"), F.col("first.right")))
           .withColumn("ahead", _common(F.reverse("left"), F.reverse("first.left"))))
    gone = F.concat(F.slice(F.reverse("left"), 1, F.col("ahead")), F.slice("right", 1, F.col("after")))
    gone = F.when(later & (F.col("after") >= F.col("n")), F.transform(gone, lambda x: x["pos"]))  # the gram itself is compared, too
    met = written(met.select("i", "h", gone.alias("gone"), "wins"), folder, "met")
    # the windows of repeated fingerprints: again a star, on the first position of the whole window
    wins = met.select("i", "h", F.explode("wins").alias("win")).select("i", "h", F.col("win.key").alias("key"), F.col("win.at").alias("at"))
    place = F.struct("i", "h", F.get("at", 0).alias("pos"))
    first = written(wins.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select("key", "first"), folder, "first-windows")
    again = wins.join(first.hint("merge"), "key").filter(~(F.col("i").eqNullSafe(F.col("first.i")) & (F.col("h") == F.col("first.h")) & (F.get("at", 0) == F.col("first.pos"))))
    gone = met.select("i", "h", F.explode("gone").alias("pos")).union(again.select("i", "h", F.explode("at").alias("pos"))).distinct()
    return gone.groupBy("i", "h").agg(F.collect_list("pos").alias("gone"))


def line_dedup(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS,
               gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with the text rid of later repeated runs, and the number of deleted lines (``n_deleted``, with underscores added if that name is taken).

    The order of documents is that of (id, text hash), null ids first; rows with equal ids and texts are one document and all
    stay, edited alike. Runs of fewer than ``gram_words`` words always stay; every run of ``min_words`` or more words that stands earlier in the documents as they come is deleted whole,
    wherever its parts occur besides. A run that overlaps its own earlier copy (many equal neighbouring lines) goes as well: of thirty equal lines of five words
    the first stays. Deletions may make lines neighbours that were none; runs that arise so are not searched for. Lines are compared
    without ASCII white space at their ends; lines without a word are never deleted. A null text stays null; a document may end up empty.
    """
    gone = repeated_lines(docs, folder, id_column, text_column, min_words, gram_words)
    gone = written(gone, folder, "gone")
    n, key, number = free_name(docs, "n_deleted"), free_name(docs, "h"), free_name(docs, "gone")
    gone = gone.select(F.col("i").alias("_i"), F.col("h").alias("_h"), F.col("gone").alias(number))
    keyed = docs.withColumn(key, F.xxhash64(text_of(text_column)))
    joined = keyed.join(gone.hint("merge"), keyed[id_column].eqNullSafe(gone["_i"]) & (keyed[key] == gone["_h"]), "left")
    lines = F.split(F.col(text_column), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(number))
    text = F.when(F.col(number).isNull(), F.col(text_column)).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return joined.select(*(text.alias(c) if c == text_column else docs[c] for c in docs.columns), F.when(F.col(number).isNull(), 0).otherwise(F.size(number)).alias(n))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines: doc_id, text, n_deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, run_folder(spark, "linededup"))
