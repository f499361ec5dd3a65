"""Audit of how far the sources of a language differ in their words.

Tasks count terms with Arrow compute alone: lower case, split by a pattern, dictionary codes, hash grouping; each gives partial counts per language,
source and term. They are summed, and the terms that enough documents of a language hold are kept. For the divergences the terms of a language are
dealt into shards of a bounded number of cells; a shard is one integer matrix (sources x terms), whose rows are compared column by column, and
the shards' sums are added. All arithmetic is in integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import run_folder, text_of, written

#: What stands between terms: ASCII characters that are no letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Text bytes handled at once, partial counts a task holds, cells (terms x sources) of a shard.
SLICE_BYTES, HELD_ROWS, SHARD_CELLS = 8_000_000, 1_000_000, 200_000
#: Totals up to here give exact probabilities with 64 bits; larger ones are an error.
LARGEST_TOTAL = (1 << 63) // 1000 - 1

_KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE_BYTES of text, a longer text alone."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype="<i8")
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _counted(rows: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of some documents; a row with a null term stands for each (lang, source)."""
    lang, source, text = rows.columns
    cut = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    terms, doc = pc.list_flatten(cut), pc.list_parent_indices(cut)
    there = pc.not_equal(terms, "")
    terms, doc = terms.filter(there).dictionary_encode(), doc.filter(there)
    per_doc = pa.table({"doc": doc, "term": terms.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    groups = pa.table({"lang": langs.indices.take(per_doc["doc"]), "source": sources.indices.take(per_doc["doc"]), "term": per_doc["term"], "n": per_doc["count_all"]})
    n = groups.group_by(_KEYS).aggregate([("n", "sum"), ("n", "count")])
    seen = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    zeros = pa.array(np.zeros(seen.num_rows, "<i8"))
    return pa.concat_tables([
        pa.table({"lang": langs.dictionary.take(n["lang"]), "source": sources.dictionary.take(n["source"]), "term": terms.dictionary.take(n["term"]), "n": n["n_sum"], "docs": n["n_count"]}),
        pa.table({"lang": seen["lang"], "source": seen["source"], "term": pa.nulls(seen.num_rows, pa.string()), "n": zeros, "docs": zeros})])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents (lang, source, text), merged while they stay below HELD_ROWS."""
    held, rows = [], 0

    def merged() -> pa.Table:
        both = pa.concat_tables(held).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        return both.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])

    for batch in batches:
        for part in _slices(batch, 2):
            held.append(_counted(part))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [merged()]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=100_000)


def scaled(count, total):
    """1 + floor(SCALE * (count + PRIOR) / total) in numpy, by three steps of 1000."""
    rest = count + PRIOR
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _scaled_column(count: Column, total: Column) -> Column:
    """``scaled`` as a Column."""
    rest = count + F.lit(PRIOR)
    whole = F.call_function("div", rest, total)
    out, rest = whole, rest - whole * total
    for _ in range(3):
        step = F.call_function("div", rest * 1000, total)
        out, rest = out * 1000 + step, rest * 1000 - step * total
    return out + 1


def _compare_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's sums of absolute differences for each ordered pair of sources. Rows without a term name the language's sources."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    named = table.filter(pc.is_null(table["term"]))
    cells = table.filter(pc.is_valid(table["term"]))
    sources, totals = named["source"].combine_chunks(), named["total"].to_numpy()
    codes = cells["term"].combine_chunks().dictionary_encode()
    at, of = pc.index_in(cells["source"].combine_chunks(), sources).to_numpy(zero_copy_only=False), codes.indices.to_numpy()
    width = len(codes.dictionary)
    if width:
        p = np.repeat(scaled(np.zeros(len(totals), "<i8"), totals)[:, None], width, 1)
        p[at, of] = scaled(cells["n"].to_numpy(), totals[at])
    else:
        p = np.zeros((len(totals), 0), "<i8")
    lang = table["lang"][0].as_py()
    for k in range(len(sources)):
        others = np.flatnonzero(np.arange(len(sources)) != k)
        sums = np.abs(p - p[k]).sum(1, dtype="<i8")[others]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([sources[k].as_py()] * len(others), pa.string()),
                                          sources.take(pa.array(others)), pa.array(sums)], ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, folder: str, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text_column: str = "text", lang_column: str = "lang",
               source_column: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: for each other source of the language, the sum over the language's kept terms of the absolute difference of the two probabilities, all ranks;
    ``term``: the source's own terms above the language's probability, the ``top_terms`` with the largest difference. Probabilities are integers,
    1 + floor(1e9 * (count + 5) / (total + 5 * kept terms)). A term is kept where at least ``least_docs`` documents (rows, repeated ones too) of the
    language hold it. Null texts, languages and sources count as ''; sources without a term take part; a language with a single source has no pairs;
    without kept terms all pair values are 0. Ties go by the item's UTF-8. An empty table gives no row; other columns are not read.
    """
    rows = docs.select(text_of(lang_column).alias("lang"), text_of(source_column).alias("source"), text_of(text_column).alias("text"))
    partial = rows.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    counts = partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select(*_KEYS, "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    counts = written(counts.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)), folder, "counts")

    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = counts.groupBy("lang").agg(F.count_if(F.col("term").isNotNull() & F.col("lead")).alias("kept"), F.sum("n").alias("lang_total"), F.count_if(F.col("term").isNull()).alias("sources"))
    total, lang_total = F.col("n") + PRIOR * F.col("kept"), F.col("lang_total") + PRIOR * F.col("kept")
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / F.lit(SHARD_CELLS))).cast("int")
    too_large = F.raise_error(F.lit(f"a language with more than {LARGEST_TOTAL} terms"))
    groups = own.join(langs, "lang").select("lang", "source", total.alias("total"), F.when(lang_total > LARGEST_TOTAL, too_large.cast("long")).otherwise(lang_total).alias("lang_total"), shards.alias("shards"))
    groups = written(groups, folder, "groups")

    cells = counts.filter("term is not null").drop("docs", "lead").join(groups, ["lang", "source"])
    p, q = _scaled_column(F.col("n"), F.col("total")), _scaled_column(F.col("lang_n"), F.col("lang_total"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)

    sharded = cells.select("lang", "source", "term", "n", "total", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    named = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    sums = sharded.union(named).groupBy("lang", "shard").applyInArrow(_compare_shard, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.union(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of all documents differ, and by which terms."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"), run_folder(spark, "divergence"))
