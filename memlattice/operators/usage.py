"""Metering: daily rollups, idempotent ingest, rate limits, usage periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..sources.scratch import Scratch
from .scans import upsert


def daily(df: DataFrame, *keys: str, ts: str = "recorded_at", day: str | None = None) -> DataFrame:
    """Events a day and key; with ``day``, of that day alone (the filter is a range, so it reaches the scan)."""
    if day is not None:
        start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
        df = df.where((F.col(ts) >= start) & (F.col(ts) < F.timestamp_add("DAY", F.lit(1), start)))
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_events"))


def rerolled(old: DataFrame, events: DataFrame, *keys: str, day: str) -> DataFrame:
    """A rollup with one day counted anew; other days stay as they were."""
    return upsert(old, daily(events, *keys, day=day).select(*old.columns), [*keys, "day"])


def following(df: DataFrame, keys: list[str], at: str, tie: str, wait: int) -> DataFrame:
    """(id, next): for each row (its ``tie``, a unique long) the first row of the key that lies ``wait`` or more after
    it, by ``at`` (a long) and ``tie``; null where there is none.

    Rows and the moments asked for are sorted together, in slices of a key's time a 24th of ``wait`` long, so no key
    meets in one task; where a slice has no answer, it is the first row of the key's next slice that has any.
    """
    width = max(1, wait // 24)
    rows = df.select(*keys, F.col(at).alias("_at"), F.col(tie).alias("_id"))
    entry = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"))
    there = rows.select(*keys, F.col("_at").alias("_moment"), F.lit(0).alias("_asks"), "_id", entry.alias("_row"))
    asks = rows.select(*keys, (F.col("_at") + wait).alias("_moment"), F.lit(1).alias("_asks"), "_id", F.lit(None).cast("struct<at: bigint, id: bigint>").alias("_row"))
    both = there.unionByName(asks).withColumn("_slice", F.floor(F.col("_moment") / width))
    down = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_moment"), "_asks", F.desc("_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_next", F.last("_row", ignorenulls=True).over(down)).where("_asks = 1").select(*keys, "_slice", "_id", "_next")
    firsts = both.groupBy(*keys, "_slice").agg(F.min("_row").alias("_first"))  # null for slices that are only asked for
    later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_later", F.last("_first", ignorenulls=True).over(later)).select(*keys, "_slice", "_later")
    same = [found[c].eqNullSafe(firsts[c]) for c in (*keys, "_slice")]
    return found.join(firsts, reduce(lambda a, b: a & b, same)).select(F.col("_id").alias("id"), F.coalesce(F.col("_next.id"), F.col("_later.id")).alias("next"))


def first_within(df: DataFrame, keys: list[str], ts: str, hours: int, tie: str) -> DataFrame:
    """The rows that an idempotency key with a lifetime lets through: the first of each key, and the first that comes
    a lifetime or more after the one let through before. ``tie``: a unique long.

    Each row points to the row that would be let through next after it, so those let through are the ones that the
    pointers reach from a key's first row. Pointers are doubled: k rounds of joins, each written, follow 2^k pointers,
    for all keys at once and whatever the number of rows of a key.
    """
    scratch = Scratch(df.sparkSession, "pointers")
    micros = df.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    pointers = scratch.write(following(micros, keys, "_micros", tie, hours * 3_600_000_000).where("next IS NOT NULL"), "pointers0")
    first = micros.groupBy(*keys).agg(F.min(F.struct("_micros", tie)).alias("_first"))
    reached = scratch.write(first.select(F.col(f"_first.{tie}").alias("id")), "reached0")
    n, k = reached.count(), 0
    while True:
        k += 1
        more = reached.join(pointers, "id").select(F.col("next").alias("id"))
        reached = scratch.write(reached.unionByName(more).distinct(), f"reached{k}")
        n, before = reached.count(), n
        if n == before:
            break
        onward = pointers.select(F.col("id").alias("next"), F.col("next").alias("far"))
        pointers = scratch.write(pointers.join(onward, "next").select("id", F.col("far").alias("next")), f"pointers{k}")
        scratch.drop(f"pointers{k - 1}")
        scratch.drop(f"reached{k - 1}")
    return df.join(reached.select(F.col("id").alias("_kept")), F.col(tie) == F.col("_kept"), "left_semi")


def rate_limited(df: DataFrame, key: str, ts: str, tie: str, rate: int, burst: int) -> DataFrame:
    """``df`` (``tie``: a long id) with ``allowed``: a token bucket of whole seconds for each key, one token a request.

    Refused requests leave the bucket as it is. A bucket is full again burst / rate seconds after its last grant, so a
    key's requests are cut at such pauses; each run, of bounded length in time, is one fold.
    """
    full = -(-burst // rate) + 1
    second = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")
    w = Window.partitionBy(key).orderBy("_s", tie)
    runs = df.withColumn("_s", second)
    runs = runs.withColumn("_run", F.sum(F.when(F.col("_s") - F.lag("_s").over(w) >= full, 1).otherwise(0)).over(w))
    folded = F.expr(
        f"aggregate(sort_array(collect_list(struct(_s AS s, {tie} AS i))), "
        f"named_struct('at', CAST(NULL AS BIGINT), 'tokens', CAST({burst} AS BIGINT), 'ids', CAST(array() AS ARRAY<BIGINT>)), "
        f"(b, x) -> IF(b.at IS NULL OR least({burst}L, b.tokens + (x.s - b.at) * {rate}L) >= 1, "
        f"named_struct('at', x.s, 'tokens', IF(b.at IS NULL, {burst}L, least({burst}L, b.tokens + (x.s - b.at) * {rate}L)) - 1L, 'ids', array_append(b.ids, CAST(x.i AS BIGINT))), b), b -> b.ids)"
    )
    granted = runs.groupBy(key, "_run").agg(folded.alias("_ids")).select(F.explode("_ids").alias("_id")).withColumn("_ok", F.lit(True))
    return df.join(granted, F.col(tie) == F.col("_id"), "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_id", "_ok")


def tier_limits(tier: Column) -> Column:
    """(rate, burst) of a plan; unknown plans have the smallest."""
    out = F.struct(*[F.lit(x).alias(n) for n, x in zip(("rate", "burst"), D.RATE_TIERS["hobby"])])
    for name, (rate, burst) in D.RATE_TIERS.items():
        out = F.when(F.lower(tier) == name, F.struct(F.lit(rate).alias("rate"), F.lit(burst).alias("burst"))).otherwise(out)
    return out


def percent(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, used / limit * 100).otherwise(F.lit(0.0))
