"""Filters, scores and top-k of hybrid retrieval, for one query or a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, vector
from .scans import every


def candidates(df: DataFrame, user: int | None = None, organization: str | None = None, kinds: Sequence[str] = (), tags: Sequence[str] = (), include_archived: bool = False, include_cold: bool = True, state_archived: bool = False) -> DataFrame:
    """Current memories that a query may see. ``state_archived``: also leave out those that decayed to 'archived'."""
    return df.where(
        every(
            F.col("valid_to").isNull(),
            None if user is None else F.col("user_id") == user,
            None if organization is None else F.col("organization_id") == organization,
            None if include_archived else ~F.col("is_archived"),
            None if include_cold else F.col("memory_state") != "cold",
            F.col("memory_state") != "archived" if state_archived else None,
            F.col("memory_type").isin(*kinds) if kinds else None,
            F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags))) if tags else None,
        )
    )


def with_terms(df: DataFrame, asked: Column | None = None) -> DataFrame:
    """``df`` with the ``terms`` of each memory, to be taken before it is joined with queries: once a memory, and its
    text need not travel. With ``asked``, terms of all queries, only those of them that the memory has."""
    own = text.terms(F.concat_ws(" ", "title", "content", F.concat_ws(" ", "tags")))
    return df.withColumn("terms", own if asked is None else F.array_intersect(own, asked))


def scored(df: DataFrame, query_terms: Column, query_vector: Column, linked: Column, now: Column) -> DataFrame:
    """``df`` with the five part scores and ``score``. ``linked``: whether the query's graph reaches the memory."""
    df = (df if "terms" in df.columns else with_terms(df)).withColumns({
        "semantic": vector.semantic(query_vector, F.col("embedding")),
        "graph": F.when(linked, F.lit(1.0)).otherwise(F.lit(0.0)),
        "recency": scoring.freshness(F.col("created_at"), now),
        "keyword": text.keyword_overlap(query_terms, F.col("terms")),
    })
    return df.withColumn("score", scoring.hybrid(F.col("semantic"), F.col("graph"), F.col("importance"), F.col("recency"), F.col("keyword"), F.col("memory_state")))


def top_k(df: DataFrame, k: int, per: str | None = None, key: str = "id") -> DataFrame:
    """The k best by score, ties to the smaller key; with ``per``, for each of its values."""
    order = [F.desc("score"), F.col(key)]
    if per is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= k)


def reranked(df: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """What ``rerank`` makes of the results; their own order where there is none or it can't be planned."""
    if rerank is None:
        return df
    try:
        return rerank(df)
    except Exception:  # noqa: BLE001  a reranker's failure must not cost the results
        return df


def mmr_order(score: Column, similarity: Column, weight: float = 0.7) -> Column:
    """The marginal-relevance score of a candidate, given its similarity to what is chosen already."""
    return score * weight - similarity * (1 - weight)


def rrf(df: DataFrame, scores: Sequence[str], key: str = "id", constant: int = 60, most: int = 1000) -> DataFrame:
    """(key, rrf): reciprocal-rank fusion of the result lists of several scores, each its ``most`` best rows (a list's
    length is part of the method); a row that a list lacks gets nothing from it."""
    lists = [df.orderBy(F.desc(s), key).limit(most).select(key, (1.0 / (constant + F.row_number().over(Window.orderBy(F.desc(s), F.col(key))))).alias("_part")) for s in scores]
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.sum("_part").alias("rrf"))
