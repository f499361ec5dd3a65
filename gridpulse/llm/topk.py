"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to a fixed set of pivots are computed once (the pivot table). By the
triangle inequality the distance of a query and a candidate is at least the largest difference of
their pivot distances, which bounds their inner product from above:

    q.c = (|q|^2 + |c|^2 - d(q, c)^2) / 2  <=  (|q|^2 + |c|^2 - max_p(|d(q,p) - d(c,p)|)^2) / 2

Candidates are evaluated in the order of their bounds, until no bound reaches the k-th best score. Vectors are
packed into blocks with their tables; a task takes one block of queries and one group of candidate blocks.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import run_folder, written

PIVOTS = 32
#: Rows from which the pivots are chosen; they change the speed only.
PIVOT_SAMPLE = 512
BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 2048
#: Candidates evaluated between two looks at the k-th best score.
STEP = 512


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice: spread pivots give different distances."""
    if not len(sample):
        return sample
    picked = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows x pivots)."""
    return np.sqrt(np.maximum(((vectors[:, None, :].astype("f8") - pivots[None, :, :]) ** 2).sum(2), 0)) if len(vectors) * len(pivots) < 2 ** 16 else \
        np.concatenate([pivot_table(v, pivots) for v in np.array_split(vectors, len(vectors) // 1024 + 2)])


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where every partial sum is below 2^53, else by integers. A product beyond 64 bits is an error."""
    if not len(vectors) or not len(queries):
        return np.zeros((len(queries), len(vectors)), "i8")
    top = float(np.abs(queries.astype("f8")).max()) * float(np.abs(vectors.astype("f8")).max()) * queries.shape[1]
    if top < 2.0 ** 53:
        return (queries.astype("f8") @ vectors.astype("f8").T).astype("i8")
    if top < 2.0 ** 62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.T.astype(object)
    if exact.max() >= 2 ** 63 or exact.min() < -2 ** 63:
        raise OverflowError("an inner product lies beyond 64 bits; use a smaller scale")
    return exact.astype("i8")


def search_block(q_ids, queries, q_table, c_ids, vectors, c_table, k: int, best: list) -> int:
    """Update ``best`` (per query (scores, ids), best first) with one candidate block; returns the pairs evaluated.

    Candidates are taken in bound order, ``STEP`` at a time. A query stops when the next bound is below its k-th score:
    an equal bound may still tie with a smaller id, so it is evaluated. The bounds get a margin for rounding.
    """
    q2, c2 = (queries.astype("f8") ** 2).sum(1), (vectors.astype("f8") ** 2).sum(1)
    done = 0
    for i in range(len(q_ids)):
        apart = np.abs(c_table - q_table[i]).max(1) if c_table.shape[1] else np.zeros(len(c_ids))
        bound = np.minimum((q2[i] + c2 - apart ** 2) / 2, np.sqrt(q2[i] * c2))
        bound += 1e-9 * (q2[i] + c2) + 1e-3
        scores, ids = best[i]
        if len(scores) == k:  # what can't reach the k-th score needs no order
            reach = np.flatnonzero(bound >= scores[-1])
            order = reach[np.argsort(-bound[reach], kind="stable")]
        else:
            order = np.argsort(-bound, kind="stable")
        at = 0
        while at < len(order):
            if len(scores) == k and bound[order[at]] < scores[-1]:
                break
            take = order[at:at + STEP]
            at += STEP
            done += len(take)
            take = take[c_ids[take] != q_ids[i]]  # before the products: a long vector's with itself may be too large
            scores, ids = np.concatenate([scores, inner(queries[i:i + 1], vectors[take])[0]]), np.concatenate([ids, c_ids[take]])
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
        best[i] = scores, ids
    return done


def top_k(vectors: DataFrame, folder: str, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, scale: int = 256,
          query_filter: str = "id % 50 = 0", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of every query; ties go to the smaller id.

    A component x counts as floor(scale * x); components and scores beyond 64 bits are an error. ``query_filter`` is a condition on ``id``. All rows are candidates but those with the query's own id.
    Rows with a null id, a null vector or a null, NaN or infinite component take no part; vectors are compared with those of their own length only, empty
    vectors with none. An id may repeat: every row is a query and a candidate of its own, but never a candidate for its own id, and the ``k`` best of an id are those
    of all its query rows together, as in the registered SQL. Other columns are not read. An empty table gives no row.
    """
    spark = vectors.sparkSession
    x = F.col(vector_column)
    clean = (vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("v")).filter("id is not null and v is not null and size(v) > 0")
             .withColumn("v", F.transform("v", lambda c: c.cast("double")))
             .filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
             .select("id", F.transform("v", lambda c: F.when(F.abs(F.lit(float(scale)) * c) < 2.0 ** 63, F.floor(F.lit(float(scale)) * c).cast("long"))
                                       .otherwise(F.raise_error(F.lit("a component lies beyond 64 bits; use a smaller scale")).cast("long"))).alias("v"), F.size("v").alias("dim")))
    # equal rows beyond the k-th can't add to the k best
    copies = clean.groupBy("id", "v", "dim").agg(F.count("*").alias("n"))
    clean = written(copies.select("id", "v", "dim", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("copy")).drop("copy"), folder, "vectors")
    queries = written(clean.filter(query_filter), folder, "queries")
    # at most PIVOT_SAMPLE rows: the pivots of each length
    sample = clean.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).collect()
    chosen = {d: choose_pivots(np.array([r.v for r in sample if r.dim == d], "f8"), pivots) for d in {r.dim for r in sample}}
    n_queries, n_rows = queries.count(), clean.count()
    query_blocks, groups = max(1, -(-n_queries // query_block_rows)), max(1, -(-n_rows // (4 * block_rows)))
    block = "dim int, part int, ids binary, vectors binary, pivot_table binary"

    def packed(rows):
        def pack(batches):
            import pyarrow as pa
            held: dict = {}

            def out(key):
                ids, v = zip(*held.pop(key))
                v = np.array(v, "<i8")
                table = pivot_table(v, chosen[key[0]]) if key[0] in chosen else np.zeros((len(v), 0))
                return pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()],
                                                   "vectors": [v.tobytes()], "pivot_table": [table.astype("<f8").tobytes()]})
            for batch in batches:
                for i, v, d, part in zip(*(c.to_pylist() for c in batch.columns)):
                    held.setdefault((d, part), []).append((i, v))
                    if len(held[d, part]) == block_rows:
                        yield out((d, part))
            for key in list(held):
                yield out(key)
        return rows.mapInArrow(pack, block)

    # a block of queries meets a group of candidates in one task: blocks of queries go to every group and the reverse
    part = lambda n: F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(n)).cast("int").alias("part")
    meet = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c_blocks = packed(clean.select("id", "v", "dim", part(groups)).repartition(groups, "part")).withColumn("q", meet(query_blocks)).withColumnRenamed("part", "g")
    q_blocks = packed(queries.select("id", "v", "dim", part(query_blocks)).repartition(query_blocks, "part")).withColumn("g", meet(groups)).withColumnRenamed("part", "q")

    def unpack(row):
        ids = np.frombuffer(row["ids"], "<i8")
        return ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1), np.frombuffer(row["pivot_table"], "<f8").reshape(len(ids), -1)

    def search(left, right):
        import pandas as pd
        out = []
        for _, q in right.iterrows():
            q_ids, queries_, q_table = unpack(q)
            best = [(np.zeros(0, "i8"), np.zeros(0, "i8")) for _ in q_ids]
            for _, c in left.iterrows():
                c_ids, vectors_, c_table = unpack(c)
                search_block(q_ids, queries_, q_table, c_ids, vectors_, c_table, k, best)
            out += [(int(i), int(v), int(s)) for i, (scores, ids) in zip(q_ids, best) for s, v in zip(scores, ids)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    n = groups * query_blocks
    met = (c_blocks.repartition(n, "dim", "q", "g").groupBy("dim", "q", "g")
           .cogroup(q_blocks.repartition(n, "dim", "q", "g").groupBy("dim", "q", "g")).applyInPandas(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every query (vec_id divisible by 50)."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), run_folder(spark, "topk"))
