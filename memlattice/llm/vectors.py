"""Near-duplicate vectors by a forest of random-projection trees: recursive random splits with spill overlap, exact
cosine within leaves, links united into components.

Edge cases: a vector that is null, all zero or holds a null or a component that is not finite links with nothing, and so
does one without a label; such rows are returned with no links. Equal vectors of one label are one node, however many
they are, and link with each other. A null id is kept and never names a component that has an id. Only vectors of as
many components are compared. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Query, Scratch, connected_components, hash_sample, spanning, table

#: Trees; vectors that a leaf should hold for the commonest label; spill to each side of a split; vectors to fit on;
#: vectors of one group that a cell compares (with one other group).
TREES, LEAF, SPILL, SAMPLE, CELL = 8, 128, 0.03, 8192, 1024
#: A leaf's code is its tree's number, shifted by so much, and its place in heap order.
SHIFT = 54
Tree = tuple[np.ndarray, np.ndarray]  #: directions and bounds of the inner nodes, in heap order


def usable(x: Column) -> Column:
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(rng: np.random.Generator, dim: int) -> np.ndarray:
    d = rng.normal(size=dim)
    return d / np.linalg.norm(d)


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Splits of a tree: random directions, and bounds near the middle of what reaches a node."""
    inner = (1 << depth) - 1
    directions, bounds, reach = np.zeros((inner, x.shape[1])), np.zeros(inner), {0: np.arange(len(x))}
    for node in range(inner):
        rows = reach.pop(node)
        directions[node] = direction(rng, x.shape[1])
        p = x[rows] @ directions[node]
        bounds[node] = float(np.quantile(p, rng.uniform(0.4, 0.6))) if len(p) else 0.0
        reach[2 * node + 1], reach[2 * node + 2] = rows[p < bounds[node]], rows[p >= bounds[node]]
    return directions, bounds


def leaves(x: np.ndarray, tree: Tree, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaves): a row within ``spill`` of a bound goes to both sides. A row meets the splits on its path only."""
    rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
    directions, bounds = tree
    while len(nodes) and nodes[0] < len(bounds):  # all rows are on one level
        at = np.einsum("ij,ij->i", x[rows], directions[nodes]) - bounds[nodes]
        left, right = at < spill, at >= -spill
        rows = np.concatenate((rows[left], rows[right]))
        nodes = np.concatenate((2 * nodes[left] + 1, 2 * nodes[right] + 2))
    return rows, nodes


def forest(sample: np.ndarray, most: int, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> list[Tree]:
    """Trees deep enough that ``most`` vectors, those of the commonest label, come to ``leaf`` a leaf, or that a leaf
    has two rows of the sample; ``split_crowded`` goes on from there."""
    depth = max(0, min(int(np.ceil(np.log2(max(most, 1) / leaf))), int(np.log2(max(len(sample), 2))) - 1)) if len(sample) else 0
    return [grow(sample, depth, np.random.default_rng(seed + t)) for t in range(trees)]


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def met_before(codes: pa.Array, code: int) -> np.ndarray:
    """Which pairs of members also share a leaf with a smaller code, where they were compared already."""
    n, sizes, flat = len(codes), np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy(zero_copy_only=False)
    owner, earlier = np.repeat(np.arange(n), sizes), flat < code
    names, column, times = np.unique(flat[earlier], return_inverse=True, return_counts=True)
    shared = times[column] > 1
    held = np.zeros((n, len(names)), np.float32)
    held[owner[earlier][shared], column[shared]] = 1
    held = held[:, times > 1]
    return held @ held.T > 0 if held.shape[1] else np.zeros((n, n), bool)


def split_crowded(indexed: DataFrame, leaf: int, spill: float, scratch: Scratch) -> DataFrame:
    """``indexed`` (node, dim, label, v, m, codes) with the leaves that hold more than four times ``leaf`` vectors of a
    label split again by random directions, each at its own middle, level by level, until none does.

    A leaf that a split would not make smaller by a quarter, as near copies of one vector lie on both sides of any
    bound, stays as it is and is cut into cells. A round costs two shuffles of the rows in crowded leaves alone.
    """
    flat = indexed.select("node", "dim", "label", F.explode("codes").alias("code"), F.lit(False).alias("stuck"))
    vectors, r = indexed.select("node", "v"), 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, dims, p = b.column("code").to_numpy(), b.column("dim").to_numpy(), np.zeros(len(b))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(matrix(b.take(pa.array(at)).column("v")))
                names, which = np.unique(code[at], return_inverse=True)
                p[at] = np.einsum("ij,ij->i", x, np.stack([direction(np.random.default_rng(int(c)), int(dim)) for c in names])[which])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "dim", "label", "code")), pa.array(p)], names=["node", "dim", "label", "code", "p"])

    shape = T.StructType([*(flat.schema[c] for c in ("node", "dim", "label", "code")), T.StructField("p", T.DoubleType())])
    while True:
        sizes = flat.where("NOT stuck").groupBy("dim", "label", "code").count().groupBy("dim", "code").agg(F.max("count").alias("most"))
        crowded = scratch.write(sizes.where(F.col("most") > 4 * leaf).select("dim", "code"), f"split/crowded{r}")
        if crowded.isEmpty():
            break
        rows = flat.where("NOT stuck").join(crowded, ["dim", "code"]).join(vectors, "node").select("node", "dim", "label", "code", "v")
        rows = scratch.write(rows.mapInArrow(project, shape), f"split/rows{r}")
        middle = rows.groupBy("dim", "code").agg(F.percentile_approx("p", 0.5, 1000).alias("bound"))
        sides = rows.join(middle, ["dim", "code"]).withColumn("left", F.col("p") < F.col("bound") + spill).withColumn("right", F.col("p") >= F.col("bound") - spill)
        parts = sides.groupBy("dim", "code").agg(F.greatest(F.count_if("left"), F.count_if("right")).alias("larger"), F.count(F.lit(1)).alias("n"))
        sides = sides.join(parts.select("dim", "code", (F.col("larger") > 0.75 * F.col("n")).alias("stuck")), ["dim", "code"])
        place = F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1))
        below = F.array_compact(F.array(F.when(F.col("left"), F.col("code") + place + 1), F.when(F.col("right"), F.col("code") + place + 2)))
        new = sides.select("node", "dim", "label", F.explode(F.when(F.col("stuck"), F.array("code")).otherwise(below)).alias("code"), "stuck")
        rest = flat.join(crowded, ["dim", "code"], "left_anti").select(*new.columns)
        flat, r = scratch.write(rest.unionByName(new), f"split/flat{r}"), r + 1
    if not r:
        return indexed
    return scratch.write(indexed.drop("codes").join(flat.groupBy("node").agg(F.collect_set("code").alias("codes")), "node"), "resplit")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    The forest is fitted on a sample of SAMPLE vectors of one length and indexes every vector. A leaf is compared
    within one label, in cells of two groups of CELL at most, so a crowded leaf is many tasks. A pair counts in the
    first leaf that it shares, by code, so each link counts once; a cell returns its members' numbers of links and a
    spanning forest of them, never the links.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    v = F.col(vector_col)
    part = "float" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "double"
    plain = F.transform(v, lambda c: F.when(c == 0, 0).otherwise(c).cast(part))  # one zero, not two
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), plain.alias("v"), F.coalesce(usable(v) & F.col(label_col).isNotNull(), F.lit(False)).alias("ok"))
    rows = scratch.write(rows.withColumn("h", F.xxhash64("label", "v")), "rows")
    nodes = rows.where("ok").groupBy("h", "label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "nodes")
    sizes = nodes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n")).orderBy(F.desc("n")).limit(16).collect()
    models = {}
    for r in top:  # vectors of rarer lengths than the sixteen commonest start in one leaf
        got = hash_sample(nodes.where(F.col("dim") == r.dim), [F.col("node")], SAMPLE, r.n).select("node", "v").toArrow()
        x = matrix(got.column("v").combine_chunks()) if len(got) else np.zeros((0, r.dim))
        order = np.argsort(got.column("node").to_numpy())
        models[r.dim] = forest(unit(x[order]), r.most, trees, leaf)
    shared = spark.sparkContext.broadcast(models)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, owner, code = b.column("dim").to_numpy(), [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(matrix(b.take(pa.array(at)).column("v")))
                for t, tree in enumerate(shared.value.get(int(dim), [(np.zeros((0, dim)), np.zeros(0))])):
                    r, leaf_of = leaves(x, tree, spill)
                    owner.append(at[r])
                    code.append((t << SHIFT) + leaf_of)
            owner, code = np.concatenate(owner), np.concatenate(code)
            order = np.lexsort((code, owner))
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(b)))))
            codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))
            yield pa.RecordBatch.from_arrays([*b.columns, codes], names=[*b.schema.names, "codes"])

    src = nodes.select("node", "dim", "label", "v", "m")
    indexed = scratch.write(src.mapInArrow(index, T.StructType([*src.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])), "indexed")
    indexed = split_crowded(indexed, leaf, spill, scratch)
    placed = indexed.withColumn("code", F.explode("codes"))
    on = ["dim", "label", "code"]
    many = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("c", F.ceil(F.col("n") / CELL).cast("int"))
    cell = placed.join(scratch.write(many.drop("n"), "many"), on).withColumn("g", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = cell.groupBy(*on, F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j")).agg(F.collect_list(F.struct("node", "g", "m", "v", "codes")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                members = b.column("members")[k].values
                node, g = members.field("node").to_numpy(), members.field("g").to_numpy()
                x = unit(matrix(members.field("v")))
                cos = x @ x.T
                near = cos >= cosine
                p, q = np.nonzero(np.triu(np.abs(cos - cosine) < 1e-9, 1))  # the bound itself: one order of summation
                near[p, q] = near[q, p] = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                np.fill_diagonal(near, False)
                if b.column("i")[k].as_py() != b.column("j")[k].as_py():
                    near &= g[:, None] != g[None, :]  # the rest is another cell's
                if near.any():
                    near &= ~met_before(members.field("codes"), b.column("code")[k].as_py())
                links = near @ members.field("m").to_numpy().astype(np.float64)
                some = np.flatnonzero(links)
                tree = np.array(spanning(near), np.int64).reshape(-1, 2)
                a, z = np.concatenate((node[some], node[tree[:, 0]])), node[tree[:, 1]]
                other = pa.array(np.concatenate((np.zeros(len(some), np.int64), z)), mask=np.arange(len(a)) < len(some))
                yield pa.RecordBatch.from_arrays([pa.array(a), other, pa.array(np.concatenate((links[some], np.zeros(len(z)))).astype(np.int64))], names=["a", "b", "n"])

    found = scratch.write(cell.select("code", "i", "j", "members").mapInArrow(compare, "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others")).where("others > 0")
    comps = scratch.write(connected_components(found.where("b IS NOT NULL").select("a", "b"), scratch), "comps")
    full = nodes.select("node", "h", "label", "v", "low", "m").join(counts, "node", "left").join(comps, "node", "left")
    full = full.withColumn("comp", F.coalesce("comp", "node")).withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("m") - 1)
    full = scratch.write(full, "full")
    for used in ("nodes", "indexed", "split", "resplit", "many", "found", "cc", "comps"):
        scratch.drop(used)
    names = full.groupBy("comp").agg(F.min("low").alias("component_id"))
    full = full.join(names, "comp").select("h", "label", "v", "n_links", "component_id")
    out = rows.where("ok").join(full, ["h", "label", "v"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op9_embedding_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {"op9_embedding_near_dup": op9_embedding_near_dup}
