"""Decay, reflection, reactivation and flags: one-step transitions with an explicit reference time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scoring
from ..functions.text import strip


def decay_candidates(df: DataFrame) -> DataFrame:
    return df.where("NOT is_pinned AND NOT is_archived AND valid_to IS NULL")


def decayed(df: DataFrame, seen: Column, now: Column) -> DataFrame:
    """``df`` with ``new_state``."""
    return df.withColumn("new_state", scoring.decay(F.col("memory_state"), F.col("is_pinned"), seen, now))


def dormant(kind: Column, seen: Column, now: Column) -> Column:
    return (kind == "goal") & (scoring.age_days(seen, now) >= 180)


def reflected(df: DataFrame, seen: Column, now: Column) -> DataFrame:
    """Dormant goals go cold and lose importance."""
    d = dormant(F.col("memory_type"), seen, now)
    return df.withColumn("new_state", F.when(d, "cold").otherwise(F.col("memory_state"))).withColumn("new_importance", F.when(d, F.greatest(F.lit(0.0), F.col("importance") - 0.3)).otherwise(F.col("importance")))


def merge_exact(df: DataFrame, content: str, *keys: str, order: str = "id") -> DataFrame:
    """The first row of each content, lower-cased and without white space around it."""
    w = Window.partitionBy(*keys, F.lower(strip(F.col(content)))).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def legal_move(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, nexts in D.STATUS_MOVES.items():
        if nexts:
            out = out | ((before == state) & after.isin(*nexts))
    return out


def stale(status: Column, updated: Column, now: Column) -> Column:
    return (status == "active") & (updated <= F.timestamp_add("DAY", F.lit(-90), now))


def created_sessions(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Rows (id, user_id, started_at, ended_at) to append for requests (id, user_id): open from now on; a session that
    is there already is not created again."""
    new = requests.select("id", "user_id").dropDuplicates(["id"]).join(sessions.select("id"), "id", "left_anti")
    return new.select("id", "user_id", now.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"))
