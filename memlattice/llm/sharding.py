"""Resharding by minimum-cost flow: old shard sizes and new capacities give the block transfers that move the fewest
bytes; only the shards that gain or lose a block are rewritten.

A block is a set of rows that move together: the rows of one hash value of the text, so copies of a text stay in one
shard. A block too large to fit in is split by a second hash of the text, and a text whose copies alone would pass a
shard's share by the id. What reaches the driver is one size for each block: their number is bounded by BLOCKS and the
number of shards, not by the rows.

Edge cases: a null text has no bytes (its checksum is that of the empty text) and is a block member like any other; a
null id is kept; repeated rows are kept, in the same shard. Further columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Query, Scratch, gapless_rank, table

BLOCKS, PARTS = 8192, 256
#: How far the moved bytes may pass the least.
SPARE = 0.004
Block = tuple[int, int, int]


def min_cost_flow(supply: Sequence[int], room: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (old, new) -> bytes that serve all ``supply`` within ``room`` at the least total of cost(old, new) a byte.

    Successive shortest augmenting paths over the bipartite graph source - old - new - sink.
    """
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, cap, price = [], [], []

    def edge(u: int, v: int, c: int, w: float) -> None:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(x)
            price.append(y)

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    pairs = {}
    for i in range(n):
        for j in range(m):
            pairs[i, j] = len(to)
            edge(i, n + j, sum(supply), cost(i, j))
    for j, x in enumerate(room):
        edge(n + j, sink, x, 0)
    while True:
        dist, by, queue, queued = {source: 0.0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in graph[u]:
                if cap[e] and (d := dist[u] + price[e]) < dist.get(to[e], float("inf")) - 1e-12:
                    dist[to[e]], by[to[e]] = d, e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in dist:
            break
        path, v = [], sink
        while v != source:
            path.append(by[v])
            v = to[by[v] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return {k: cap[e + 1] for k, e in pairs.items() if cap[e + 1]}


def outgoing(blocks: list[Block], sizes: dict[Block, int], amount: int) -> set[Block]:
    """Blocks of about ``amount`` bytes: the largest that still fit, then exchanges of one for one, or one put in or
    left out, for as long as these come closer."""
    chosen, left = set(), amount
    for b in sorted(blocks, key=lambda b: (-sizes[b], b)):
        if sizes[b] <= left:
            chosen.add(b)
            left -= sizes[b]
    while left:
        best, key = None, abs(left)
        inside, outside = sorted((sizes[b], b) for b in chosen), sorted((sizes[b], b) for b in blocks if b not in chosen)
        for size, b in [(0, None), *inside]:  # the other's block nearest to size + left
            k = bisect_left(outside, (size + left,))
            for other, o in [(0, None), *outside[max(k - 1, 0) : k + 1]]:
                if (x := abs(left - other + size)) < key:
                    best, key = (b, o, left - other + size), x
        if best is None:
            break
        chosen -= {best[0]}
        chosen |= {best[1]} - {None}
        left = best[2]
    return chosen


def rooms(sizes: dict[Block, int], old: dict[Block, int], shards: int) -> list[int]:
    """Capacities: equal shares, but for shards that hold a block larger than that, which get its size."""
    largest = [0] * shards
    for b, s in old.items():
        if s < shards:
            largest[s] = max(largest[s], sizes[b])
    fixed: set[int] = set()
    while len(fixed) < shards:
        left = max(sum(sizes.values()) - sum(largest[s] for s in fixed), 0)
        share, more = divmod(left, shards - len(fixed))
        new = {s for s in range(shards) if s not in fixed and largest[s] > share + 1}
        if not new:
            free = [s for s in range(shards) if s not in fixed]
            return [largest[s] if s in fixed else share + (free.index(s) < more) for s in range(shards)]
        fixed |= new
    return largest


def plan_transfers(sizes: dict[Block, int], old: dict[Block, int], shards: int) -> dict[Block, int]:
    """Block -> new shard. The flow says how many bytes leave each old shard and how many reach each new one. Whole
    blocks of that size leave; they are dealt to the shards that gain, and evened out among themselves, which moves no
    further byte; then blocks that left are exchanged with blocks that stayed, for as long as the moved bytes stay within
    a SPARE part of the least that the loads ask for."""
    held: dict[int, list[Block]] = defaultdict(list)
    for b in sorted(sizes):
        held[old[b]].append(b)
    supply = [sum(sizes[b] for b in held[i]) for i in range(max(held, default=-1) + 1)]
    room = rooms(sizes, old, shards)
    flow = min_cost_flow(supply, room, lambda i, j: float(i != j))
    gains = [sum(x for (i, k), x in flow.items() if k == j != i) for j in range(shards)]
    leave = set()
    for i in range(len(supply)):
        leave |= outgoing(held[i], sizes, sum(x for (k, j), x in flow.items() if k == i != j)) if i < shards else set(held[i])
    new = {b: s for b, s in old.items() if b not in leave}
    for b in sorted(leave, key=lambda b: (-sizes[b], b)):
        j = max(range(shards), key=lambda j: (gains[j], -j))
        new[b] = j
        gains[j] -= sizes[b]
    near = max(1, sum(sizes.values()) // shards // 1000)
    return exchanged(sizes, old, even_out(sizes, new, shards, near, leave), supply, shards, near)


def exchanged(sizes: dict[Block, int], old: dict[Block, int], new: dict[Block, int], supply: list[int], shards: int, near: int) -> dict[Block, int]:
    """Moves and exchanges between two shards, the fullest and the emptiest first, until all differ by ``near`` or none
    helps. Each brings the sum of squared loads down. A block that goes home, or is exchanged with one that left the same
    shard, costs few moved bytes or none; one is made only if all moved bytes then stay within a SPARE part of the least
    that the loads ask for: what each old shard has too much."""
    new, load, own = dict(new), [0] * shards, [set() for _ in range(shards)]
    for b, s in new.items():
        own[s].add(b)
        load[s] += sizes[b]
    asked = lambda s, n: max(0, supply[s] - n) if s < len(supply) else 0
    gone = sum(supply[shards:])  # of shards that are no more
    moved = sum(sizes[b] for b, s in new.items() if old[b] != s)
    least = gone + sum(asked(s, n) for s, n in enumerate(load))
    cost = lambda b, here, there: sizes[b] * ((old[b] != there) - (old[b] != here))

    def best(hi: int, lo: int) -> tuple[int, Block, Block | None] | None:
        gap, found, key = load[hi] - load[lo], None, load[hi] - load[lo]
        kinds: dict[int, list[tuple[int, Block]]] = {-1: [], 0: [], 1: []}  # by what a byte costs that goes the other way
        for b in own[lo]:
            kinds[(old[b] != hi) - (old[b] != lo)].append((sizes[b], b))
        for k in kinds.values():
            k.sort()
        for x in sorted(own[hi]):
            options: list[Block | None] = [None]
            for k in kinds.values():
                at = bisect_left(k, (sizes[x] - gap // 2,))
                options += [b for _, b in k[max(at - 1, 0) : at + 1]]
            for y in options:
                d = sizes[x] - (sizes[y] if y else 0)
                if abs(gap - 2 * d) >= key:
                    continue
                then = moved + cost(x, hi, lo) + (cost(y, lo, hi) if y else 0)
                need = least - asked(hi, load[hi]) - asked(lo, load[lo]) + asked(hi, load[hi] - d) + asked(lo, load[lo] + d)
                if then <= need * (1 + SPARE):
                    found, key = (d, x, y), abs(gap - 2 * d)
        return found

    while shards > 1:
        order = sorted(range(shards), key=lambda s: (load[s], s))
        hi, lo = order[-1], order[0]
        if load[hi] - load[lo] <= near:
            break
        pairs = [(hi, s) for s in order[:-1]] + [(s, lo) for s in order[:0:-1]]
        for a, c in pairs:
            if load[a] - load[c] > near // 2 and (found := best(a, c)):
                break
        else:
            break
        d, x, y = found
        for b, here, there in ((x, a, c), (y, c, a)):
            if b is not None:
                moved += cost(b, here, there)
                own[here].discard(b)
                own[there].add(b)
                new[b] = there
        least += asked(a, load[a] - d) + asked(c, load[c] + d) - asked(a, load[a]) - asked(c, load[c])
        load[a], load[c] = load[a] - d, load[c] + d
    return new


def even_out(sizes: dict[Block, int], new: dict[Block, int], shards: int, near: int, only: set[Block] | None = None) -> dict[Block, int]:
    """Moves and swaps between the fullest and the emptiest shard until they differ by ``near`` or none helps, which
    brings the sum of squared loads down each time. ``only``: the blocks that may be touched, and with them the shards
    that hold any."""
    load, own, new = [0] * shards, [set() for _ in range(shards)], dict(new)
    for b, s in new.items():
        load[s] += sizes[b]
        if only is None or b in only:
            own[s].add(b)
    able = [s for s in range(shards) if only is None or own[s]]
    while able:
        hi, lo = max(able, key=load.__getitem__), min(able, key=load.__getitem__)
        gap = load[hi] - load[lo]
        if gap <= near:
            break
        best, key = None, gap
        for b in own[hi]:
            if (x := abs(gap - 2 * sizes[b])) < key:
                best, key = (b, None), x
        if key > gap / 8:
            mine = sorted((sizes[b], b) for b in own[hi])
            others = sorted((sizes[b], b) for b in own[lo])
            k = 0
            for size, b in mine:  # the other's block nearest to size - gap / 2
                while k + 1 < len(others) and abs(gap - 2 * (size - others[k + 1][0])) <= abs(gap - 2 * (size - others[k][0])):
                    k += 1
                if others and (x := abs(gap - 2 * (size - others[k][0]))) < key:
                    best, key = (b, others[k][1]), x
        if best is None:
            break
        for b, a, c in ((best[0], hi, lo), (best[1], lo, hi)):
            if b is not None:
                own[a].discard(b)
                own[c].add(b)
                new[b] = c
                load[a] -= sizes[b]
                load[c] += sizes[b]
    return new


def reshard(docs: DataFrame, shards: int = 40, old_shards: int = 32, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot): shards of nearly equal bytes, reached from ``old_shards`` by
    the transfers of whole blocks nearest to the flow that moves the fewest bytes. A row's old shard is that of its
    block, ``block % old_shards``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(raw), F.lit(BLOCKS)).cast("int").alias("b0"), F.pmod(F.xxhash64(F.lit(1), raw), F.lit(PARTS)).cast("int").alias("h1"),
    )
    keys = scratch.write(keys, "keys")
    first = {r.b0: r.n for r in keys.groupBy("b0").agg(F.sum("size").alias("n")).collect()}
    share = max(1, sum(first.values()) // shards)
    large = [b for b, n in first.items() if n > share // 32]
    flag = spark.createDataFrame([(b,) for b in large], "b0 int")
    keys = keys.join(F.broadcast(flag.withColumn("l1", F.lit(True))), "b0", "left").withColumn("b1", F.when(F.col("l1"), F.col("h1")).otherwise(-1))
    second = {(r.b0, r.b1): r.n for r in keys.where("b1 >= 0").groupBy("b0", "b1").agg(F.sum("size").alias("n")).collect()}
    huge = {k: -(-32 * n // share) for k, n in second.items() if n > share}
    cuts = spark.createDataFrame([(*k, n) for k, n in huge.items()], "b0 int, b1 int, cuts int")
    keys = keys.join(F.broadcast(cuts), ["b0", "b1"], "left").withColumn("b2", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.coalesce("cuts", F.lit(1))).cast("int")).otherwise(-1))
    third = {(r.b0, r.b1, r.b2): r.n for r in keys.where("b2 >= 0").groupBy("b0", "b1", "b2").agg(F.sum("size").alias("n")).collect()}
    whole = set(first) - set(large)
    sizes = {(b, -1, -1): first[b] for b in whole} | {(*k, -1): n for k, n in second.items() if k not in huge} | third
    new = plan_transfers(sizes, {b: b[0] % old_shards for b in sizes}, shards)
    kind = T.StructType([T.StructField(c, T.IntegerType()) for c in ("b0", "b1", "b2", "shard")])
    plan = spark.createDataFrame([(*b, s) for b, s in new.items()], kind)
    placed = keys.join(F.broadcast(plan), ["b0", "b1", "b2"]).withColumn("old_shard", F.col("b0") % old_shards)
    placed = scratch.write(placed.select("doc_id", "size", "text_crc32", "old_shard", "shard"), "placed")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    return gapless_rank(placed, "shard", "slot", [F.col("doc_id"), F.col("text_crc32")], scratch, "starts", most)


def rewrite_affected(spark: SparkSession, docs: DataFrame, plan: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 1_000_000) -> DataFrame:
    """Writes the documents of each shard that gained or lost rows to ``out_dir``/shard=N, in order of their slots (to
    shard_=N and by slot_ where the documents have such columns themselves); returns the shards that stay as they are.
    ``plan``: what reshard() gave for ``docs``.

    A document is found by its id, null or not, and its text's checksum; rows that agree in both are dealt the slots of
    the plan in turn. A shard is written by as many tasks as it has times ``rows`` rows, each with its range of slots.
    """
    moved = plan.where("shard <> old_shard")
    touched = moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    turn = lambda *order: F.row_number().over(Window.partitionBy("_id", "_crc").orderBy(*order))
    places = plan.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot", (F.floor(F.col("slot") / rows)).alias("_part"))
    places = places.withColumn("_turn", turn("shard", "slot")).join(F.broadcast(touched), "shard", "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    full = docs.select(whole, F.col(f"`{id_col}`").cast("long").alias("_id"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("_crc"))
    full = full.withColumn("_turn", turn(F.xxhash64("_doc")))
    on = full["_id"].eqNullSafe(places["_id"]) & (full["_crc"] == places["_crc"]) & (full["_turn"] == places["_turn"])
    shard, slot = (n + "_" * (n in docs.columns) for n in ("shard", "slot"))
    out = full.join(places, on).select("_doc", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "_part")
    out = out.repartition(plan.count() // rows + 40, "_shard", "_part").sortWithinPartitions("_shard", "_slot")
    out = out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], F.col("_slot").alias(slot), F.col("_shard").alias(shard))
    out.write.mode("overwrite").partitionBy(shard).parquet(out_dir)
    return plan.select("shard").distinct().join(touched, "shard", "left_anti")


def op7_min_cost_sharding(spark, sf_dir: str) -> DataFrame:
    out = reshard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES: dict[str, Query] = {"op7_min_cost_sharding": op7_min_cost_sharding}
