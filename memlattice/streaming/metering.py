"""Structured Streaming forms of metering: rollup, idempotency, rate limits, dead letters."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import insert_new, upsert
from ..sources.scratch import Scratch, folder

#: Buckets of keys whose idempotency is kept together.
BUCKETS = 1024

EVENT = T.StructType([T.StructField(n, k) for n, k in (("event_id", T.LongType()), ("tenant_id", T.LongType()), ("actor_id", T.LongType()), ("event_type", T.StringType()), ("recorded_at", T.TimestampType()))])


def json_events(spark: SparkSession, path: str, schema: T.StructType = EVENT, files: int = 100) -> DataFrame:
    """A stream of JSON lines; what does not parse is kept in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.readStream.schema(full).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def daily_rollup(events: DataFrame, *keys: str, ts: str = "recorded_at", watermark: str | None = None) -> DataFrame:
    """Events a day and key. Without a watermark nothing is late and the state holds every day; with one, days older
    than it are final, their state goes and their late events are lost, as in a rollup of today only. In update mode,
    with ``upserted`` as the sink, a batch writes the days that it touches."""
    df = events.withWatermark(ts, watermark) if watermark else events
    out = df.groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(*keys, F.to_date("window.start").alias("day"), "n_events")


def arrival_time(events: DataFrame, ts: str = "recorded_at", arrived: str = "ingested_at") -> DataFrame:
    """Events without a time of their own count at their arrival."""
    return events.withColumn(ts, F.coalesce(ts, arrived))


def in_order(rows: Iterator[pd.DataFrame], first: int, then: int, least: int | None = None) -> list[np.ndarray]:
    """Two columns of a key's rows, by their places, as arrays in the order of the first and then the second. Nothing
    else of the rows is held, and nothing at all of those whose first is under ``least``."""
    pairs = ((x.iloc[:, first].to_numpy(), x.iloc[:, then].to_numpy()) for x in rows)
    parts = [(a, b) if least is None else (a[a >= least], b[a >= least]) for a, b in pairs]
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def idempotent(events: DataFrame, *keys: str, tie: str = "event_id", ts: str = "recorded_at", hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """(tie, keys): the first event of each key, and the first that comes its lifetime of ``hours`` or more after the
    one let through before. The time of the last accepted event is the key's state, so a key lives on over batches.

    Keys are dealt into ``BUCKETS`` by their hash, whose states are read and written as one each: what a batch costs
    beside its events is a few calls a bucket, not a key. A key leaves its bucket when the watermark passes the end of
    its lifetime, from when any event would be let through anyway. Events of a batch are taken in order of time; batches
    should be, too, but for ``late``: events later than that are dropped."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    life, kinds, names = hours * 3_600_000_000, dict(events.dtypes), [f"_k{n}" for n in range(len(keys))]
    ends = lambda last: -(-(last + life) // 1000)  # noqa: E731  in milliseconds

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("bucket", "last binary")

        def read(self) -> dict[tuple, int]:
            return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

        def write(self, last: dict[tuple, int]) -> None:
            """The bucket's state, with a timer for the key that goes first."""
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            if last:
                self.state.update((pickle.dumps(last),))
                self.handle.registerTimer(ends(min(last.values())))
            else:
                self.state.clear()

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            df, state, changed, kept = pd.concat([x.iloc[:, : 2 + len(names)] for x in rows], ignore_index=True), self.read(), False, []
            at, ids = df.iloc[:, 0].to_numpy(), df.iloc[:, 1].to_numpy()
            number, texts = np.zeros(len(df), np.int64), []
            for n in range(len(names)):
                codes, values = pd.factorize(df.iloc[:, 2 + n], use_na_sentinel=False)
                number = pd.factorize(number * len(values) + codes)[0]
                plain = [None if pd.isna(x) else x for x in values]
                texts.append([plain[c] for c in codes])
            order = np.lexsort((ids, at, number))
            cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                mine, key = order[lo:hi], tuple(x[order[lo]] for x in texts)
                times, last = at[mine], state.get(key)
                i = 0 if last is None else int(np.searchsorted(times, last + life))
                while i < len(times):
                    last = int(times[i])
                    kept.append((ids[mine[i]], *key))
                    i = max(i + 1, int(np.searchsorted(times, last + life)))
                if last != state.get(key):
                    state[key], changed = last, True
            if changed:
                self.write(state)
            if kept:
                columns = list(zip(*kept))
                yield pd.DataFrame({tie: columns[0], **{name: pd.Series(c, dtype=object) for name, c in zip(names, columns[1:])}})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            self.write({k: last for k, last in self.read().items() if ends(last) > now})
            return iter([])

        def close(self) -> None:
            pass

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    texts = [F.col(c).cast("string").alias(name) for c, name in zip(keys, names)]
    rows = events.withWatermark(ts, late).select(F.unix_micros(ts).alias("_at"), tie, *texts, bucket, ts)
    shape = ", ".join([f"{tie} {kinds[tie]}", *(f"{name} string" for name in names)])
    out = rows.groupBy("_bucket").transformWithStateInPandas(First(), shape, "append", "EventTime")
    return out.select(tie, *[F.col(name).cast(kinds[c]).alias(c) for c, name in zip(keys, names)])


def route(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: parsed rows to ``good``, corrupt ones to ``bad`` (a dead-letter table)."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good(batch.where("_corrupt IS NULL").drop("_corrupt"), number)
            bad(batch.where("_corrupt IS NOT NULL").select("_corrupt"), number)
        finally:
            batch.unpersist()

    return each


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Appends a batch as its own folder, which a batch that runs again overwrites."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_once(path: str, key: str = "event_id", day: str | None = None) -> Callable[[DataFrame, int], None]:
    """Appends a batch to a table by keys that it lacks. A batch that runs again after a failure overwrites its own
    folder, so it adds nothing twice. With ``day``, a date column that belongs to the key, the table is laid out by it
    and only the days of the batch are read. Any failure to read what is there fails the batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, at = folder(spark, path)
        old = batch.limit(0)
        if fs.exists(at):
            old = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") != number).drop("batch")
            if day:
                old = old.join(batch.select(day).distinct(), day, "left_semi").select(*batch.columns)
        out = insert_new(old, batch, key).write.mode("overwrite")
        (out.partitionBy(day) if day else out).parquet(f"{path}/batch={number}")

    return write


def retained(spark: SparkSession, path: str, most: int) -> list[int]:
    """Keeps about the ``most`` latest rows of a table of batches: drops, oldest first, the batches without which that
    many are left, and returns their numbers. As with an approximate limit on a log's length, a batch is kept whole."""
    newer = Window.orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))  # one row a batch
    old = [r.batch for r in sizes.withColumn("newer", F.sum("n").over(newer)).where(F.col("newer") >= most).collect()]
    for number in old:
        fs, at = folder(spark, f"{path}/batch={number}")
        fs.delete(at, True)
    return sorted(old)


def token_bucket(requests: DataFrame, key: str, request: str, ts: str, rate: int, burst: int, late: str = "0 seconds") -> DataFrame:
    """(key, request, allowed) of a stream of requests: a bucket of whole seconds for each key, kept as state until the
    watermark is so far on that the bucket is full again. Requests of a batch are taken in order of time; refused ones
    leave the bucket as it is; those later than ``late`` are dropped."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    full = -(-burst // rate)

    class Bucket(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("bucket", "at long, tokens long")

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            at, tokens = self.state.get() if self.state.exists() else (None, burst)
            seconds, ids = in_order(rows, 0, 1)
            allowed, before = np.zeros(len(ids), bool), at
            for i, s in enumerate(seconds.tolist()):
                have = burst if at is None else min(burst, tokens + (s - at) * rate)
                if have >= 1:
                    at, tokens, allowed[i] = s, have - 1, True
            if at is not None:
                self.state.update((at, tokens))
            if at != before:
                for old in self.handle.listTimers():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer((at + full) * 1000)
            yield pd.DataFrame({key: pd.Series([k[0]] * len(ids), dtype=object), request: ids, "allowed": allowed})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    kinds = dict(requests.dtypes)
    shape = f"{key} {kinds[key]}, {request} {kinds[request]}, allowed boolean"
    rows = requests.withWatermark(ts, late).select(F.floor(F.unix_micros(ts) / 1_000_000).cast("long").alias("_second"), request, key, ts)
    return rows.groupBy(key).transformWithStateInPandas(Bucket(), shape, "append", "EventTime")


def upserted(path: str, keys: list[str], day: str = "day") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for an aggregate in update mode: the batch's totals take the place of those with the same
    ``keys`` and ``day`` in a table laid out by day. Only the days of the batch are read and written, so a batch costs
    what it touches, and one that runs again after a failure writes the same totals again."""

    def write(batch: DataFrame, number: int) -> None:
        spark, scratch = batch.sparkSession, Scratch(batch.sparkSession, "upsert")
        fs, at = folder(spark, path)
        fresh = scratch.write(batch, "fresh")
        if fs.exists(at):
            old = spark.read.schema(batch.schema).parquet(path).join(fresh.select(day).distinct(), day, "left_semi")
            fresh = scratch.write(upsert(old.select(*batch.columns), fresh, [*keys, day]), "merged")
        fresh.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        scratch.drop()

    return write


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and gives its result as a table of the shared folder: batches side by side
    in append mode, the last one in complete mode."""
    root = Scratch(stream.sparkSession, name).root
    write = append_batches(f"{root}/out") if mode == "append" else lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out")
    finish(stream, write, f"{root}/state", mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def finish(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> list[dict]:
    """Runs a stream over what there is now; ``state``: where it goes on from. Returns the progress of its batches."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def fed(parts: list[DataFrame], root: str, run: Callable[[DataFrame], object], first: int = 0) -> None:
    """Writes each part in turn below ``root``, from the number ``first`` on, and has ``run`` take the stream of all up
    to there, so that each part is a batch, and a restart, of its own."""
    for k, part in enumerate(parts, first):
        part.write.parquet(f"{root}/in/{k}")
        run(part.sparkSession.readStream.schema(part.schema).parquet(f"{root}/in/*"))


def in_turn(parts: list[DataFrame], root: str, files: int = 8) -> DataFrame:
    """A stream whose batches are the parts in turn, about: each is written as ``files`` files below ``root``, and a
    batch takes so many."""
    for k, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{root}/in/{k}")
    return parts[0].sparkSession.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in/*")
