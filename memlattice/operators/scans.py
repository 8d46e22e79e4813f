"""Tenant-scoped scans, pages, and mutations as change logs.

Parquet tables take no updates: the current state of a table is its base with the last change of each key applied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, organization: str, column: str = "organization_id") -> DataFrame:
    return df.where(F.col(column) == organization)


def every(*conditions: Column | None) -> Column:
    """All of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(df: DataFrame, *order: Column, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a total order; the last sort key should be unique."""
    return df.orderBy(*order).offset(offset).limit(limit)


def check_tenant(df: DataFrame, organization: str, column: str = "organization_id") -> DataFrame:
    """``df``, which fails when a row belongs to no tenant or another one."""
    ok = F.coalesce(F.col(column) == organization, F.lit(False))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit("tenant mismatch"))))


def only_one(df: DataFrame, what: str = "row") -> DataFrame:
    """The one row of ``df``, or none; reading it fails if there is a second. Two rows at most are looked at."""
    few = df.limit(2)
    return few.where(F.when(few.agg(F.count(F.lit(1))).scalar() > 1, F.raise_error(F.lit(f"more than one {what}"))).otherwise(F.lit(True)))


def insert_new(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key ``base`` lacks, the first of each key: what an insert that ignores conflicts appends."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in rows.columns if c != key] or [F.lit(1)])
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(base.select(key), key, "left_anti").select(*base.columns)


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``rows`` in place of those with the same keys."""
    return base.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(rows)


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``base`` after ``changes`` (key, seq, op: 'update' or 'delete', values: one nullable column for each column
    changed; a null leaves the value as it is). Later changes win, column by column."""
    values = [c for c in changes.columns if c not in (key, order, "op")]
    last = changes.groupBy(key).agg(
        F.max_by("op", order).alias("_op"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in values],
    )
    out = base.join(last, key, "left").where(F.coalesce(F.col("_op") != "delete", F.lit(True)))
    return out.select(*[(F.coalesce(f"_{c}", c) if c in values else F.col(c)).alias(c) for c in base.columns])


def affected(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """How many rows of ``base`` each kind of change meets."""
    return changes.join(base.select(key), key, "left_semi").groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def has_scope(scopes: Column, wanted: str) -> Column:
    """Whether a key's scopes hold the one wanted, or 'admin'; a scope is compared whole, never by its letters."""
    return F.coalesce(F.array_contains(scopes, wanted) | F.array_contains(scopes, "admin"), F.lit(False))


def same_tenant(header: Column, asked: Column) -> Column:
    """Whether a request stays within the tenant of its key."""
    return F.coalesce(header == asked, F.lit(False))
