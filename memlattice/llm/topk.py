"""Exact top-k by inner product of whole-number vectors: norm buckets, local cosine thresholds, coordinate or length
pruning, exact verification.

Edge cases: a vector that is null, holds a null or a component that is not finite, or has no id takes no part. Vectors
are compared with those of as many components. Rows that share the query's id count as the query itself; a query row
that is repeated is asked once. Ties go to the smaller id. Further columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Query, Scratch, table

#: Components (rows x dimensions) of a chunk of candidates, and of a block of queries, at most about.
CHUNK, BLOCK = 1 << 18, 1 << 16
#: Longest candidates whose scores give each query a first threshold.
SEEDS = 1024
FOCUS = 5


def whole(x: Column, scale: int = 1024) -> Column:
    return F.transform(x, lambda c: F.floor(c.cast("double") * scale))


def usable(x: Column) -> Column:
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def product(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact whole-number products: as floats where no sum can pass 2^53, else as unbounded numbers held to 64 bits."""
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if bound < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    sums = c.astype(object) @ q.astype(object)
    return np.array([max(min(int(x), 2**63 - 1), -(2**63)) for x in sums], np.int64)


def candidates(c: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float, least: float) -> np.ndarray:
    """Rows of the bucket ``c`` that can reach ``least`` with ``q``: by the local cosine threshold, coordinates of the
    query's largest components must lie in their feasible range; where the threshold is too low for that to prune,
    only the length counts."""
    top = norms.max(initial=0.0)
    if not least > 0 or not q_norm:
        return np.arange(len(c))
    local = least / (q_norm * top) if top else np.inf
    if local > 1 + 1e-9:
        return np.arange(0)
    mask = norms >= least / q_norm * (1 - 1e-9)
    if local > 0.5:
        unit, reach = q / q_norm, np.arccos(min(local, 1.0))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            at = np.arccos(np.clip(unit[f], -1, 1))
            lo, hi = np.cos(min(np.pi, at + reach)) - 1e-9, np.cos(max(0.0, at - reach)) + 1e-9
            mask &= (c[:, f] >= lo * norms) & (c[:, f] <= hi * norms)
    return np.flatnonzero(mask)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def dealt(df: DataFrame, band: Column, size: int, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with a number ``name`` of a chunk: rows of one dimension and band, ``size`` components at most, about."""
    df = df.withColumn("_band", band)
    n = df.groupBy("dim", "_band").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_c", F.ceil(F.col("_n") * F.greatest("dim", F.lit(1)) / size).cast("int"))
    n = n.withColumn("_at", F.coalesce(F.sum("_c").over(Window.partitionBy("dim").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(scratch.write(n.drop("_n"), name), ["dim", "_band"])
    return df.withColumn(name, (F.col("_at") + F.pmod(F.xxhash64("vec_id"), F.col("_c"))).cast("long")).drop("_band", "_c", "_at")


def top_k(vectors: DataFrame, k: int = 10, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that ``is_query`` marks.

    Candidates are grouped by length (bands of a sixteenth of a power of two) into chunks, queries by the length that a
    candidate must have to reach their threshold. A pair of chunk and block is worked on only if its longest candidate
    can reach some query's threshold; each returns k rows a query at most.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    is_query = F.col(id_col) % 100 == 0 if is_query is None else is_query
    v = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    v = v.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    v = v.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    v = scratch.write(v, "vectors")
    seeds = v.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v", "dim").toArrow()
    by_dim = {}
    for dim in set(seeds.column("dim").to_pylist()):
        own = seeds.filter(pa.compute.equal(seeds.column("dim"), dim))
        by_dim[dim] = own.column("vec_id").to_numpy(), matrix(own.column("v")) if dim else np.zeros((len(own), 0))
    shared = spark.sparkContext.broadcast(by_dim)

    def first_threshold(batches):
        for b in batches:
            least = []
            for i, q, dim in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), b.column("dim").to_pylist()):
                ids, m = shared.value.get(dim, (np.zeros(0), np.zeros((0, dim))))
                scores = np.sort(product(m, np.array(q, np.int64))[ids != i])
                least.append(float(scores[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.float64())], names=[*b.schema.names, "least"])

    q = v.where("asks").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "dim", "norm").mapInArrow(first_threshold, "vec_id long, v array<long>, dim int, norm double, least double")
    q = q.withColumn("need", F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm")).otherwise(0.0))
    q = scratch.write(dealt(q, F.floor(F.log2(F.col("need") + 1) * 16), BLOCK, "block", scratch), "queries")
    c = v.select("vec_id", "v", "dim", "norm")
    c = scratch.write(dealt(c, F.floor(F.log2(F.col("norm") + 1) * 16), CHUNK, "chunk", scratch), "candidates")
    chunks = c.groupBy("dim", "chunk").agg(F.max("norm").alias("longest"))
    blocks = q.groupBy("dim", "block").agg(F.min("need").alias("need"))
    pairs = scratch.write(chunks.join(blocks, "dim").where(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("dim", "chunk", "block"), "pairs")

    def cell(key, left, right):
        ids, c_norms = right.column("vec_id").to_numpy(), right.column("norm").to_numpy()
        out = []
        if len(left) and len(right):
            m = matrix(right.column("v")) if len(right.column("v")[0]) else np.zeros((len(right), 0), np.int64)
            for i, x, n, least in zip(*(left.column(f).to_pylist() for f in ("vec_id", "v", "norm", "least"))):
                x = np.array(x, np.int64)
                at = candidates(m, c_norms, x, n, -np.inf if least is None else least)
                at = at[ids[at] != i]
                scores = product(m[at], x)
                if least is not None:
                    at, scores = at[scores >= least], scores[scores >= least]
                out += [(i, int(ids[at[t]]), int(scores[t])) for t in best(ids[at], scores, k)]
        cols = list(zip(*out)) or [()] * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols)})

    asks = q.join(pairs, ["dim", "block"]).select("dim", "chunk", "block", "vec_id", "v", "norm", "least")
    gives = c.join(pairs, ["dim", "chunk"]).select("dim", "chunk", "block", "vec_id", "v", "norm")
    on = ["dim", "chunk", "block"]
    found = asks.groupBy(*on).cogroup(gives.groupBy(*on)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_norm_bucket_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {"op8_norm_bucket_topk": op8_norm_bucket_topk}
SQL = {
    "op8_norm_bucket_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
