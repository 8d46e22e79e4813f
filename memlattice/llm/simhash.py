"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming verification, components.

Inputs and edge cases: a null, empty or blank text has no words and the fingerprint zero, which links like any other.
Repeated rows stay, each with the fingerprint of its text. A null id is carried along; it is never a component's name
unless the whole component has no id. Further columns of the input are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, connected_components, spanning, table

#: Members of a bucket that one cell compares are at most two groups of about this many.
CELL = 512


def fingerprint(text: bytes, words: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """64-bit SimHash of UTF-8 text, unsigned; ``step`` shingles at a time, so a long text needs no more memory."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not parts:
        return 0
    digest, joined = xxhash.xxh64_digest, b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, step):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + step], ends[k : k + step])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp: long, the 64 bits as a signed number) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(x.as_buffer().to_pybytes(), words, seed)) if x.is_valid else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def blocks_for(n: int, distance: int) -> int:
    """Into how many blocks to split 64 bits, so that chance meetings in a bucket stay few among n fingerprints.

    With b blocks, two fingerprints at ``distance`` or less agree in b - distance of them. Any b finds the same links;
    a larger one costs more keys for each fingerprint and leaves fewer chance pairs.
    """
    b = distance + 2
    while (b - distance) * (64 // b) < np.log2(max(n, 2)) + 1 and b < distance + 5:
        b += 1
    return b


def masks(b: int, distance: int) -> list[int]:
    bounds = [round(64 * i / b) for i in range(b + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:])]
    return [_signed(sum(c)) for c in combinations(parts, b - distance)]


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all of ``values`` (distinct) that Hamming links at ``distance`` or less join; a tree each."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    np.fill_diagonal(near, False)
    return spanning(near)


def link(fps: DataFrame, scratch: Scratch, distance: int = 4) -> DataFrame:
    """(a, b) verified links between the distinct values of ``fps.fp``, enough of them to join all that links join.

    Each fingerprint goes to the bucket of every choice of b - distance blocks. A bucket of more than CELL members is
    split into groups, and each pair of groups is one cell: no task holds more than two groups, and a cell returns a
    spanning forest of its verified links, so that a dense bucket of n members returns n - 1 rows and not n * n.
    """
    ms = masks(blocks_for(fps.count(), distance), distance)
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(ms)])).alias("x"))
    keys = keys.select("fp", "x.k", "x.v")
    many = keys.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cell = keys.join(many, ["k", "v"]).withColumn("c", F.ceil(F.col("n") / CELL).cast("int"))
    cell = cell.withColumn("g", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    cell = cell.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = cell.groupBy("k", "v", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            lists = b.column(0)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            for lo, hi in zip(at[:-1], at[1:]):
                v = flat[lo:hi]
                if hi - lo == 2:
                    pairs = [(0, 1)] if ((int(v[0]) ^ int(v[1])) & ((1 << 64) - 1)).bit_count() <= distance else []
                else:
                    pairs = forest(v.view(np.uint64), distance)
                left += [v[p] for p, _ in pairs]
                right += [v[q] for _, q in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    found = cell.select("fps").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id that links of ``distance`` or less reach.

    Equal fingerprints are one node, so a group of copies of any size costs one comparison.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, words, seed), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    comps = scratch.write(connected_components(link(nodes.select("fp"), scratch, distance), scratch), "comps")
    linked = nodes.join(comps, nodes.fp == comps.node).select("fp", "low", "comp")
    names = linked.groupBy("comp").agg(F.min("low").alias("name"))
    names = linked.join(names, "comp").select("fp", "name")
    names = scratch.write(nodes.join(names, "fp", "left").select("fp", F.coalesce("name", "low").alias("component")), "names")
    return rows.join(names, "fp").select("id", "fp", "component")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Query] = {"op2_simhash": op2_simhash}
