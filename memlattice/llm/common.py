"""Helpers shared by the corpus operators: shared storage, unique ranks, bounded samples, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own
    in local mode, as in tests; on a cluster, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="memlattice-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor loses none of them. Results
    read some of them lazily; once a result is written itself, ``clear_since`` drops what was made for it."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        Scratch.made.append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Drops all of it: for state from which no result is read any more."""
        self.drop("")

    @classmethod
    def clear_since(cls, mark: int) -> None:
        """Clears what was made after ``len(Scratch.made)`` was ``mark``."""
        for x in cls.made[mark:]:
            x.clear()
        del cls.made[mark:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the fold of a row."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def hash_sample(df: DataFrame, keys: list[Column], rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``keys``; the same rows on every run and layout.

    A row's chance is the same at every input size. Twice ``rows`` is a hard bound, against repeated keys.
    """
    if total <= rows:
        return df.limit(2 * rows)
    share = rows / total
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows)


def gapless_rank(df: DataFrame, key: str, out: str, tie: list[Column], scratch: Scratch, name: str, most: int, rows: int = 200_000) -> DataFrame:
    """A rank from 0 without gaps within each value of ``key``, however many rows the value has.

    Rows are dealt to (key, salt) groups, ranked there, and shifted by the sizes of the groups before. ``most``: how
    many rows a value has, at most; there are as many salts as keep a group near ``rows``, or 16. The key must have a
    bounded number of values (shards, lengths): the sizes of the groups are the only thing joined.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(max(16, -(-most // rows)))).cast("int"))
    sizes = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = scratch.write(sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), name)
    ranked = salted.withColumn("_r", F.row_number().over(W.partitionBy(key, "_salt").orderBy(*tie)))
    joined = ranked.join(starts, [key, "_salt"])
    return joined.withColumn(out, (F.col("_start") + F.col("_r") - 1).cast("long")).drop("_salt", "_start", "_r")


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that ``near``, a symmetric matrix of links, joins: a tree for each component."""
    left, out = near.any(axis=1), []
    for i in np.flatnonzero(left).tolist():
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            seen = near[front]
            new = np.flatnonzero(seen.any(axis=0) & left)
            parents = front[seen[:, new].argmax(axis=0)] if len(new) else new
            out += zip(parents.tolist(), new.tolist())
            left[new] = False
            front = new
    return out


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: long); comp is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each round is two pre-aggregated shuffles, the number of rounds
    grows with the logarithm of the longest path, and no node's neighbours ever meet in one task's memory (minima
    are combined map-side; the join that hands them back is a plain one that adaptive execution can split).
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.write(e, f"{name}/0")

    def mark(x: DataFrame):
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())

    seen, i = mark(e), 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"{name}/{i}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = scratch.write(small.where("u <> v").distinct(), f"{name}/{i + 1}")
        scratch.drop(f"{name}/{i}")
        scratch.drop(f"{name}/{i}l")
        now, i = mark(e), i + 1
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


Query = Callable[[SparkSession, str], DataFrame]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y, fold, weight) of labelled documents to learn from: about ``rows`` of each class at most; weight is
    how many labelled rows of its class each stands for.

    Rows whose crc32 of the id modulo 4 is 2 are held out. Documents of any length are learned from. The chosen labels
    are at most 4 * rows + 2 small rows, so they are broadcast, and the documents are scanned once without a shuffle.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("fold", crc_mod(F.col("id"), 4).cast("int")).where("fold <> 2")
    known = scratch.write(known, f"{label}-labels")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [hash_sample(known.where(F.col("y") == y), [F.col("id")], rows, n).withColumn("weight", F.lit(max(1.0, n / rows))) for y, n in sorted(sizes.items())]
    chosen = known.withColumn("weight", F.lit(1.0)).limit(0)
    for p in parts:
        chosen = chosen.unionByName(p)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scratch.write(src.join(F.broadcast(chosen), "id"), f"{label}-sample")
