"""From raw documents to packed training sequences: quality, toxicity, repeated passages, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is written and read again
before the next. All but the last return the columns of ``documents``. Learned stages learn from the labels in ``sf_dir`` and the documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import lines, packing, quality, simhash, toxicity
from memlattice.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.7."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.mark(docs, model).where("score >= 0.7").select("doc.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.3 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.mark(docs, model).where("score < 0.3").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes chunks of lines that occur earlier; a document whose text goes altogether stays, with an empty one. Where
    there is a column n_chars, it follows the text."""
    count = "_removed"
    while count in docs.columns:
        count += "_"
    out = lines.clean(docs, count_col=count)
    n = lambda: F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[n().alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of SimHash near-duplicates, the document with the smallest id (once, if it is repeated), then
    the smallest hash of its text; one without an id only where none of the group has one. Groups are made over texts,
    so rows that share an id may be in several."""
    scratch, of = Scratch(spark, "kept"), F.xxhash64("text")
    texts = docs.select(of.alias("h"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    groups = simhash.near_duplicates(texts, "h", "body").select(F.col("id").alias("h"), "component").distinct()
    low = texts.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    least = low.join(groups, "h").groupBy("component").agg(F.min(F.struct("first.none", "first.id", "h")).alias("first"))
    names = scratch.write(least.select("first.id", "first.h"), "names")
    # The document travels as one value, so that none of its columns can clash with a name used here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("key"), of.alias("hash"))
    kept = whole.join(names, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["key", "hash"]).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_each),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Once a stage's result is written, its working tables and what it read are dropped."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        mark = len(Scratch.made)
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        Scratch.clear_since(mark)
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
