"""The memory model over the driver's tables. Each view is a projection or an equi-join, so filters and column pruning
reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.text import strip

DOCS_NOW, EVENTS_NOW, ORDERS_NOW = "2025-06-01 00:00:00", "2024-02-01 00:00:00", "2001-08-01 00:00:00"


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plus_days(ts: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), ts)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, body = F.col("doc_id"), strip(F.col("text"))
    created = plus_days(at("2024-01-01 00:00:00"), i % 400)
    return load(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.col("lang").alias("organization_id"),
        (i % 50).alias("user_id"),
        pick(D.MEMORY_TYPES, i % 11).alias("memory_type"),
        pick(D.SOURCE_TYPES, i % 5).alias("source_type"),
        pick(D.MEMORY_STATES, i % 4).alias("memory_state"),
        F.left(body, F.lit(80)).alias("title"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        (i % 17 == 0).alias("is_pinned"),
        (i % 13 == 0).alias("is_archived"),
        (i % 100 / 100.0).alias("importance"),
        (i % 21 / 20.0).alias("utility_score"),
        (i % 87).alias("session_id"),
        created.alias("created_at"),
        plus_days(created, i % 7).alias("updated_at"),
        F.when(i % 3 == 0, plus_days(created, i % 90)).alias("last_accessed_at"),
        created.alias("valid_from"),
        F.when(i % 19 == 0, plus_days(created, F.lit(10))).alias("valid_to"),
    )


def embedded(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    """Memories (or ``m``, some of them) with the vector of the same id; memories without one keep a null."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    m = memories(spark, sf_dir) if m is None else m
    return m.join(v, m.id == v.vec_id, "left").drop("vec_id")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three earlier versions for each superseded memory."""
    m = memories(spark, sf_dir).where(F.col("valid_to").isNotNull())
    v = m.withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))))
    return v.select(F.col("id").alias("memory_id"), "organization_id", F.col("n").cast("long").alias("version"), F.concat_ws("#", "title", "n").alias("content"), (F.col("importance") / F.col("n")).alias("importance"), plus_days(F.col("valid_from"), F.col("n")).alias("valid_from"), plus_days(F.col("valid_from"), F.col("n") + 1).alias("valid_to"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each conversation: its user, start, end (every seventh is still open)."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    start = plus_days(at("2024-01-01 00:00:00"), F.col("conv_id") % 300)
    return c.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 50).alias("user_id"), "turns", start.alias("started_at"), F.when(F.col("conv_id") % 7 != 0, plus_days(start, F.lit(1))).alias("ended_at"))


def meter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("tenant_id"), F.col("user_id").alias("actor_id"), "event_type", F.col("ts").alias("recorded_at"), F.col("value").alias("units"), k.alias("target_id"), F.octet_length("props").cast("long").alias("bytes"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, kind, key, label, user: load(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("name"), user.cast("long").alias("user_id"))
    none = F.lit(-1)
    return (
        one("region", "region", "r_regionkey", "r_name", none)
        .unionByName(one("nation", "nation", "n_nationkey", "n_name", none))
        .unionByName(one("customer", "customer", "c_custkey", "c_name", F.col("c_custkey") % 50))
        .unionByName(one("supplier", "supplier", "s_suppkey", "s_name", F.col("s_suppkey") % 50))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, a, a_key, b, b_key, kind: load(spark, sf_dir, name).select(F.concat(F.lit(f"{a}:"), F.col(a_key)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(b_key)).alias("target"), F.lit(kind).alias("relationship"))
    return (
        one("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of")
        .unionByName(one("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in"))
        .unionByName(one("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"))
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are the memories that mention a customer."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory_id"), F.concat(F.lit("customer:"), F.col("o_custkey")).alias("entity_id"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as memories with a lifecycle: last seen on the order's date."""
    i = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(i.alias("id"), pick(D.MEMORY_TYPES, i % 11).alias("memory_type"), pick(D.MEMORY_STATES, i % 4).alias("memory_state"), (i % 17 == 0).alias("is_pinned"), (i % 13 == 0).alias("is_archived"), (i % 100 / 100.0).alias("importance"), F.col("o_orderdate").alias("seen_at"), F.col("o_custkey").alias("user_id"))
