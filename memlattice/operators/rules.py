"""Tenants' policies and schemas as tables: each request is joined with the rules that hold for it, and these are
evaluated by higher-order functions over their arrays, so one plan serves every tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.text import let

POLICY = "organization_id string, name string, store array<string>, ignore array<string>, weights map<string, double>"
#: fields: (name, type, values of an enum); a schema's required names are checked first.
SCHEMA = "organization_id string, schema string, fields array<struct<name: string, type: string, values: array<string>>>, required array<string>"


def builtin(spark: SparkSession) -> DataFrame:
    """The policies that every tenant has, by name."""
    return spark.createDataFrame([(None, k, store, ignore, weights) for k, (store, ignore, weights) in D.POLICIES.items()], POLICY).drop("organization_id")


def with_policy(requests: DataFrame, policies: DataFrame, organization: str = "organization_id", name: str = "policy") -> DataFrame:
    """``requests`` with ``rules`` (store, ignore, weights): the tenant's own policy of the name asked for, else the
    built-in one of that name, else the default, which stores every kind. ``policies``: one row a tenant and name."""
    rules = lambda alias: F.struct("store", "ignore", "weights").alias(alias)
    own = policies.select(F.col("organization_id").alias("_org"), F.col("name").alias("_name"), rules("_own"))
    all_ = builtin(requests.sparkSession).select(F.col("name").alias("_base"), rules("_builtin"))
    out = requests.join(own, (F.col(organization) == F.col("_org")) & (F.col(name) == F.col("_name")), "left")
    out = out.join(F.broadcast(all_), F.col(name) == F.col("_base"), "left")  # three rows
    every = F.struct(F.array(*map(F.lit, D.MEMORY_TYPES)).alias("store"), F.array().cast("array<string>").alias("ignore"), F.create_map().cast("map<string, double>").alias("weights"))
    return out.withColumn("rules", F.coalesce("_own", "_builtin", every)).drop("_org", "_name", "_base", "_own", "_builtin")


def accepts(rules: Column, kind: Column, content: Column) -> Column:
    """Whether the kind is stored and no pattern finds the content one to ignore."""
    return F.array_contains(rules["store"], kind) & ~F.exists(rules["ignore"], lambda p: F.regexp_like(content, F.concat(F.lit("(?i)"), p)))


def priority(rules: Column, kind: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(rules["weights"], kind), otherwise)


def schema_errors(data: Column, fields: Column, required: Column) -> Column:
    """Array of errors of a JSON object against the rules of its row: unknown keys are ignored, nulls pass every kind, a
    boolean is no number, dates are ISO dates. As ``ingest.schema_errors``, which compiles one schema into a plan."""
    def checked(values: Column) -> Column:
        lacks = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
        missing = F.transform(F.filter(required, lambda n: lacks(F.try_element_at(values, n))), lambda n: F.concat(n, F.lit(" is required")))
        wrong = F.filter(fields, lambda f: let(F.try_element_at(values, f["name"]), lambda v: ~(lacks(v) | right(f, v))))
        return F.concat(missing, F.transform(wrong, lambda f: F.concat(f["name"], F.lit(" must be "), f["type"])))

    def right(f: Column, v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        by_type = {
            "string": kind == "STRING",
            "number": kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
            "boolean": kind == "BOOLEAN",
            "date": (kind == "STRING") & text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(),
            "enum": (kind == "STRING") & F.array_contains(f["values"], text),
            "array": kind.startswith("ARRAY"),
            "object": kind.startswith("OBJECT"),
        }
        out = F.lit(False)
        for name, holds in by_type.items():
            out = F.when(f["type"] == name, F.coalesce(holds, F.lit(False))).otherwise(out)
        return out

    return let(F.from_json(data, "map<string, variant>"), checked)
