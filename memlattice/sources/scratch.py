"""Tables that an iteration or a stream writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, one of our own, and on a cluster an
    error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="memlattice-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Scratch:
    """A folder for working tables. Results may read them lazily, so it goes when the application ends, or with
    ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, at = folder(spark, self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again, which cuts its lineage."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        fs, at = folder(self.spark, f"{self.root}/{name}" if name else self.root)
        fs.delete(at, True)
