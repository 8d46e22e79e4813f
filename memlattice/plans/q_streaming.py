"""Streams run to the end of what there is, as tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import views as V
from ..sources.eventlog import EventLog
from ..sources.scratch import Scratch
from ..streaming import metering as S
from ..streaming.memories import sequential
from .q_matching import BLOCK
from .q_usage import BUCKET, IDEMPOTENT
from .registry import query

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream(spark, sf):
    """The events table as a stream; watermarks need a zoned time."""
    s = spark.readStream.schema(EVENTS).parquet(f"{sf}/events.parquet*")
    return s.select("event_id", (F.col("user_id") % 10).alias("tenant_id"), F.col("user_id").alias("actor_id"), "event_type", F.col("ts").cast("timestamp").alias("recorded_at"))


@query("SELECT user_id % 10 AS tenant_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events FROM events GROUP BY ALL")
def stream_rollup(spark, sf):
    """The daily rollup by a stream in complete mode, which loses nothing that is late."""
    out = S.drain(S.daily_rollup(stream(spark, sf), "tenant_id", "event_type"), "rollup", "complete")
    return out.select("tenant_id", "event_type", F.col("day").cast("string").alias("day"), "n_events")


def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


WEEKS = [f"2024-01-{d:02} 00:00:00" for d in (8, 15, 22, 29)]


def weeks(spark, sf):
    """The events in five parts, a week each, as the stream has them."""
    rows = V.load(spark, sf, "events")
    between = [rows.where(F.lit(True) if lo is None else F.col("ts") >= V.at(lo)).where(F.lit(True) if hi is None else F.col("ts") < V.at(hi)) for lo, hi in zip([None, *WEEKS], [*WEEKS, None])]
    return [x.select("event_id", (F.col("user_id") % 10).alias("tenant_id"), F.col("user_id").alias("actor_id"), "event_type", F.col("ts").cast("timestamp").alias("recorded_at")) for x in between]


@query(IDEMPOTENT)
def stream_idempotent(spark, sf):
    """Idempotency keys as keyed state over five batches, a week of events each; the rule of idempotent_ingest."""
    state_store(spark)
    root = Scratch(spark, "once").root
    once = S.idempotent(S.in_turn(weeks(spark, sf), root), "actor_id", "event_type", late="8 days")
    S.finish(once, S.append_batches(f"{root}/out"), f"{root}/state")
    return spark.read.parquet(f"{root}/out").select(F.col("event_id").alias("id"), "actor_id", "event_type")


@query("SELECT user_id % 10 AS tenant_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events FROM events GROUP BY ALL")
def stream_rollup_upsert(spark, sf):
    """The daily rollup in update mode over five batches, each with events of every day, so that most are late: totals
    are upserted into a table laid out by day."""
    root, keys = Scratch(spark, "rollup").root, ["tenant_id", "event_type"]
    rows = [V.load(spark, sf, "events").where(F.col("event_id") % 5 == k) for k in range(5)]
    rows = [x.select((F.col("user_id") % 10).alias("tenant_id"), "event_type", F.col("ts").cast("timestamp").alias("recorded_at")) for x in rows]
    S.finish(S.daily_rollup(S.in_turn(rows, root), *keys), S.upserted(f"{root}/out", keys), f"{root}/state", "update")
    out = spark.read.parquet(f"{root}/out")
    return out.select("tenant_id", "event_type", F.col("day").cast("string").alias("day"), "n_events")


@query(f"""WITH e AS (SELECT event_type, ts < TIMESTAMP '{WEEKS[1]}' AS old FROM events)
SELECT event_type, CASE WHEN old THEN 1 ELSE 2 END AS run, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT 'kept', 3, count(*) FILTER (WHERE NOT old) FROM e""")
def event_log(spark, sf):
    """A log that one stream writes and another reads: two weeks, then, from its own offset on, three more. The log is
    to keep as many events as these three weeks have, and drops older segments when it is written."""
    spark.dataSource.register(EventLog)
    root, parts = Scratch(spark, "log").root, weeks(spark, sf)
    total, most = (sum(x.count() for x in some) for some in (parts, parts[2:]))

    def sent(s):
        w = s.writeStream.format("eventlog").option("path", f"{root}/log").option("writer", "meter").option("maxLength", most)
        w.option("checkpointLocation", f"{root}/sent").trigger(availableNow=True).start().awaitTermination()

    def log(reader):
        return reader.format("eventlog").schema(parts[0].schema).option("path", f"{root}/log").load()

    for run, some in ((1, range(2)), (2, range(2, 5))):
        S.fed([parts[k] for k in some], root, sent, first=some[0])
        S.finish(log(spark.readStream), S.append_batches(f"{root}/read/run={run}"), f"{root}/state")
    read = spark.read.parquet(f"{root}/read").groupBy("event_type", F.col("run").cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    n = F.count(F.lit(1))
    kept = log(spark.read).agg(F.when(n < total, F.least(n, F.lit(most))).otherwise(n).cast("long").alias("n"))
    return read.unionByName(kept.select(F.lit("kept").alias("event_type"), F.lit(3).alias("run"), "n"))


@query(None)
def stream_dedup(spark, sf):
    """A user's memories of a kind in turn, as a stream of five batches with what is stored as state: the decisions of
    dedup_sequential."""
    state_store(spark)
    root, m = Scratch(spark, "memories").root, V.memories(spark, sf).select("id", *BLOCK, "title", "content")
    cut = F.floor(5 * F.col("id") / (F.lit(1) + m.agg(F.max("id")).scalar()))
    S.fed([m.where(cut == k) for k in range(5)], root, lambda s: S.finish(sequential(s, BLOCK, "id", "content", "title"), S.append_batches(f"{root}/out"), f"{root}/state"))
    return spark.read.parquet(f"{root}/out").drop("batch")


@query("""SELECT strftime(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 HOUR ELSE ts END, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_arrival(spark, sf):
    """A stream of lines of which every third has no time of its own and counts at its arrival, 30 hours later."""
    root, e = Scratch(spark, "arrivals").root, V.load(spark, sf, "events")
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ts = F.col("ts").cast("timestamp")
    line = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, when(ts)).alias("recorded_at"), when(ts + F.expr("INTERVAL 30 HOURS")).alias("ingested_at")))
    e.select(line.alias("value")).write.text(f"{root}/in")
    shape = T.StructType([*S.EVENT.fields, T.StructField("ingested_at", T.TimestampType())])
    events = S.arrival_time(S.json_events(spark, f"{root}/in", shape).where("_corrupt IS NULL"))
    S.finish(events.select("event_type", "recorded_at"), S.append_batches(f"{root}/out"), f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(BUCKET)
def stream_token_bucket(spark, sf):
    """Rate limits as keyed state; the same rule as rate_limit_bucket."""
    state_store(spark)
    quick = F.timestamp_seconds(F.floor((F.unix_seconds("recorded_at") - 1704067200) / 36000) + 1704067200)
    s = stream(spark, sf).withColumn("at", quick)
    out = S.drain(S.token_bucket(s, "actor_id", "event_id", "at", 2, 4), "bucket")
    return out.select(F.col("event_id").alias("id"), "actor_id", "allowed")


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 > 0 GROUP BY event_type
UNION ALL SELECT 'dead letter', count(*) FROM events WHERE event_id % 10 = 0""")
def dead_letters(spark, sf):
    """A stream of lines, sent twice over, in which every tenth is broken: what parses is appended once a key, the rest
    goes to the dead letters."""
    root = Scratch(spark, "lines").root
    e = V.load(spark, sf, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", F.col("user_id").alias("actor_id"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("recorded_at"))))
    for k in range(2):
        e.where("event_id % 10 > 0" if k else "true").select(line.alias("value")).write.text(f"{root}/in/{k}")
    events = S.json_events(spark, f"{root}/in/*", files=16).withColumn("day", F.to_date("recorded_at"))
    each = S.route(S.append_once(f"{root}/good", day="day"), S.append_batches(f"{root}/dead"))
    events.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    good = spark.read.parquet(f"{root}/good").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(spark.read.parquet(f"{root}/dead").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead letter").alias("event_type"), "n"))
