"""JSON lines in and out: observation payloads, exports, and a durable queue with dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
OBSERVATION = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "organization_id", "session_id")] + [T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("metadata", T.StringType()), T.StructField("policy", T.StringType())])


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(observations, lines that are no observation) of a JSON-lines file or folder."""
    full = T.StructType([*OBSERVATION.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = rows.where(F.col("_corrupt").isNotNull() & F.col("user_id").isNull())
    return rows.where("_corrupt IS NULL").drop("_corrupt"), bad.select("_corrupt")


def export(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rows as JSON lines, nulls left out."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").json(path)


def flush(queue: DataFrame, accepted: DataFrame, path: str, key: str = "id", rows: int = 1000, size: int = 50 << 20) -> None:
    """Moves what was not accepted of a batch of a durable queue to the dead letters at ``path``, in files that are
    rotated after ``rows`` rows, or fewer if as many as long as the longest could pass ``size`` bytes."""
    left = queue.join(accepted.select(key), key, "left_anti")
    longest = left.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    left.write.mode("append").option("maxRecordsPerFile", max(1, min(rows, size // (longest + 1)))).json(path)


def replay(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """The dead letters at ``path`` as a queue again: each key once, the latest file's row."""
    rows = spark.read.schema(schema).json(path).withColumn("_from", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path")))
    return rows.groupBy(key).agg(*[F.max_by(c, "_from").alias(c) for c in schema.fieldNames() if c != key]).select(*schema.fieldNames())
