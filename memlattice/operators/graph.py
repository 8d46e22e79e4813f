"""Bounded walks over a property graph held in two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def directed_both_ways(edges: DataFrame) -> DataFrame:
    """(here, there) for each edge from either end. A union of two equi-joinable halves: a join on 'source or target'
    would be a nested loop."""
    return edges.select(F.col("source").alias("here"), F.col("target").alias("there")).unionByName(edges.select(F.col("target").alias("here"), F.col("source").alias("there")))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbour, relationship) for each edge at one of ``nodes`` (id), from either end."""
    out = edges.join(nodes.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "relationship")
    back = edges.join(nodes.select(F.col("id").alias("target")), "target").select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "relationship")
    return out.unionByName(back)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of every node at most ``depth`` undirected steps from ``seeds`` (id), at its least depth.

    A level is the neighbours of the level before that no earlier level has, so every node's edges are joined once. Each
    level is written, and the walk ends with the first one that is empty.
    """
    scratch, both = Scratch(edges.sparkSession, "reach"), directed_both_ways(edges)
    level = scratch.write(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "0")
    out = level
    for d in range(1, depth + 1):
        new = both.join(level, F.col("here") == F.col("id")).select(F.col("there").alias("id")).distinct()
        level = scratch.write(new.join(out, "id", "left_anti").withColumn("depth", F.lit(d)), str(d))
        out = out.unionByName(level)
        if level.isEmpty():
            break
    return out


def linked_memories(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(memory_id) of memories that a link ties to one of ``nodes`` (id)."""
    return links.join(nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("memory_id").distinct()


def typed_edges(pairs: DataFrame, relationship: str) -> DataFrame:
    """Edges of a kind to append, one for each pair (source, target) of different nodes, however often it is named."""
    return pairs.where("source <> target").select("source", "target", F.lit(relationship).alias("relationship")).distinct()


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with an end among ``nodes`` (id)."""
    ends = nodes.select("id")
    one = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi")
    two = edges.join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return one.unionByName(two.select(*one.columns)).dropDuplicates(["source", "target", "relationship"])


def memory_counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with memory_count, 0 where nothing links to a node."""
    n = links.dropDuplicates(["memory_id", "entity_id"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("memory_count"))
    return nodes.join(n, nodes.id == n.entity_id, "left").drop("entity_id").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)).cast("long"))
