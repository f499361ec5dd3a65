"""SimHash near-duplicates: fingerprints per document, then a tiled exact comparison of all of them.

Equal fingerprints are one row from the start, so copies cost nothing. Distinct fingerprints fall into cells by
the population counts of their two halves. Two fingerprints within the radius differ by at most the radius in
both counts together, so only tile pairs of neighbouring cells are compared (exclusive-or and bit counts over numpy arrays), and the
pairs of other cells are skipped without loss. A tile holds a bounded number of fingerprints of one cell. From each tile pair come
the edges of a spanning forest of its links, at most one a fingerprint, never all pairs of a group.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, free_name, run_folder, text_of, written

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile (about; tiles are dealt by hash).
TILE = 4096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the XXH64 values of the text's word shingles, repeats included."""
    import xxhash
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, "i8")
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, h, fp): h is the text's hash (null as empty), fp the fingerprint as a signed long."""
    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.xxhash64(text_of(text_column)).alias("h"), F.col(text_column).cast("string").alias("t"))

    def hashed(batches):
        import pyarrow as pa
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(2)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "h", "fp"])

    return rows.mapInArrow(hashed, "doc_id long, h long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles (or within one)."""
    nodes = a if same else np.concatenate([a, b])
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    shift, out = 0 if same else len(a), []
    rows = max(1, (1 << 16) // max(1, len(b)))  # in the cache
    for i in range(0, len(a), rows):
        near = np.flatnonzero(np.bitwise_count(a[i:i + rows, None] ^ b[None, :]).ravel() <= radius)
        for at in near.tolist():
            x, y = at // len(b) + i, at % len(b) + shift
            if x != y and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    if not out:
        return nodes[:0], nodes[:0]
    x, y = np.array(out).T
    return nodes[x], nodes[y]


def near_links(prints: DataFrame, folder: str, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints ``fp`` exactly as all pairs within ``radius`` bits do."""
    spark = prints.sparkSession
    half = lambda low: F.bit_count(F.shiftrightunsigned("fp", 32) if not low else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = prints.select("fp", half(False).alias("h"), half(True).alias("l"))
    counts = {(r.h, r.l): r["count"] for r in cells.groupBy("h", "l").count().collect()}  # 33 * 33 cells at most
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    # tiles of a cell, and each tile pair once: the lower one first
    of = {c: -(-n // tile) for c, n in counts.items()}
    plan = [(h, l, h2, l2) for h, l in of for h2, l2 in of if abs(h - h2) + abs(l - l2) <= radius and (h, l) <= (h2, l2)]
    key = "(h * 33 + l)"
    tiles_in = F.element_at(F.from_json(F.lit(str([of.get((h, l), 1) for h in range(33) for l in range(33)])), "array<int>"), F.expr(f"{key} + 1"))
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("fp"), tiles_in.cast("long")).cast("int"))
    tiles = written(dealt.groupBy("h", "l", "part").agg(F.sort_array(F.collect_list("fp")).alias("prints")), folder, "tiles")  # bounded by ``tile``
    # at most 1089 * 41 / 2 rows
    ways = spark.range(1).select(F.explode(F.from_json(F.lit(str([dict(h=h, l=l, h2=h2, l2=l2, n=of[h, l], n2=of[h2, l2]) for h, l, h2, l2 in plan]).replace("'", '"')),
                                                       "array<struct<h:int,l:int,h2:int,l2:int,n:int,n2:int>>")).alias("w")).select("w.*")
    ways = F.broadcast(ways)
    left = (tiles.join(ways, ["h", "l"]).withColumn("part2", F.explode(F.expr("sequence(0, n2 - 1)")))
            .filter("h <> h2 or l <> l2 or part <= part2")
            .select("h2", "l2", "part2", F.expr("h = h2 and l = l2 and part = part2").alias("same"), F.col("prints").alias("a")))
    right = tiles.select(F.col("h").alias("h2"), F.col("l").alias("l2"), F.col("part").alias("part2"), F.col("prints").alias("b"))
    # little data and much work: a fixed number of partitions, which AQE leaves as they are
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pair = ["h2", "l2", "part2"]
    met = left.repartition(n, *pair).join(right.repartition(n, *pair), pair).select("same", "a", "b")

    def compare(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for k, same in enumerate(batch.column(0).to_pylist()):
                a, b = (batch.column(c)[k].values.to_numpy().view("<u8") for c in (1, 2))
                out.append(forest(a, b, radius, same))
            x, y = (np.concatenate(side).view("<i8") for side in zip(*out)) if out else (np.zeros(0, "i8"),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return written(met.mapInArrow(compare, "a long, b long").distinct(), folder, "links")


def near_dedup(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS,
               radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, h, fp, component, component_id): one row per row of ``docs``; component_id is the smallest id that links lead to, the own included;
    component is a fingerprint that names the component also where no row has an id; h is the text's hash.

    Empty, blank and null texts have fingerprint zero and link like any other. Repeated rows are copies of each other. A row with a null id
    belongs to its component, whose id is null only if it holds no other id. An empty table gives no row. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_column, text_column, shingle_words), folder, "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "distinct")
    links = near_links(distinct.select("fp"), folder, radius, tile)
    members = connected_components(links, folder)  # of fingerprints that have a link
    of = distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", F.coalesce("component", "fp").alias("c"), "first")
    of = written(of, folder, "of")
    low = written(of.groupBy("c").agg(F.min("first").alias("component_id")), folder, "low")
    named = written(of.select("fp", "c").join(low, "c").select("fp", F.col("c").alias("component"), "component_id"), folder, "named")
    return prints.join(named, "fp").select("doc_id", "h", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """``docs`` with one row per component: the smallest id (null ids last), then the smallest text hash; of rows equal in both, one."""
    found = written(near_dedup(docs, folder, id_column, text_column, **how), folder, "found")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("best")
    best = found.groupBy("component").agg(best).select(F.col("best.doc_id").alias("_i"), F.col("best.h").alias("_h"))
    times = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    best = written(best.join(times, best["_i"].eqNullSafe(times["doc_id"]) & (best["_h"] == times["h"])).select("_i", "_h", "n"), folder, "best")
    i, h = free_name(docs, "i_"), free_name(docs, "h_")
    keyed = docs.withColumns({i: F.col(id_column).cast("long"), h: F.xxhash64(text_of(text_column))})

    def those(which: DataFrame) -> DataFrame:
        return keyed.join(which.hint("merge"), keyed[i].eqNullSafe(which["_i"]) & (keyed[h] == which["_h"]), "left_semi")

    out = those(best.filter("n = 1"))
    again = best.filter("n > 1")
    if not again.isEmpty():  # rows that come more than once
        out = out.union(those(again).dropDuplicates([i, h]))
    return out.select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), run_folder(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
