"""Streams give what the batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from memlattice.streaming import metering as S

SF = "/root/testdata/sf0.001"


def test_token_bucket_stream_equals_batch(spark):
    q = entry.queries()
    rows = lambda n: {r.id: r.allowed for r in q[n](spark, SF).collect()}
    assert rows("rate_limit_bucket") == rows("stream_token_bucket")


def test_token_bucket_refills(spark):
    from memlattice.operators.usage import rate_limited

    t = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 0, 0, 0, 0, 1, 1, 1, 9)]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(t)], "id long, k string, ts timestamp_ntz")
    got = [r.allowed for r in rate_limited(df, "k", "ts", "id", 2, 4).orderBy("id").collect()]
    assert got == [True] * 4 + [False, True, True, False, True]


def test_dead_letters_and_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id": 1, "event_type": "view"}\n{"event_id": 1, "event_type": "view"}\n{broken\n')
    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")
    each = S.route(S.append_once(out), lambda b, n: b.write.mode("append").text(dead))
    events = S.json_events(spark, str(tmp_path / "in"))
    for k in ("one", "two"):  # two checkpoints: the second run replays the batch
        events.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / k)).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 1 and spark.read.text(dead).count() == 2


def test_arrival_time(spark):
    df = spark.createDataFrame([(None, datetime(2024, 1, 1)), (datetime(2023, 1, 1), datetime(2024, 1, 1))], "recorded_at timestamp, ingested_at timestamp")
    assert [r.y for r in S.arrival_time(df).select(F.year("recorded_at").alias("y")).collect()] == [2024, 2023]


def test_a_key_is_let_through_again_after_its_lifetime(spark, tmp_path):
    """Over several batches: the same as the batch operator on all of them."""
    from memlattice.operators.usage import first_within

    hours = [[0, 5, 23], [24, 30, 47], [48, 49, 200]]
    rows = [[(100 * k + i, "k", datetime(2024, 1, 1) + timedelta(hours=h)) for i, h in enumerate(hs)] for k, hs in enumerate(hours)]
    shape = "event_id long, key string, recorded_at timestamp"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r.event_id for r in S.drain(S.idempotent(s, "key"), "t").collect()}
    whole = spark.createDataFrame([r for part in rows for r in part], "event_id long, key string, recorded_at timestamp_ntz")
    assert got == {r.event_id for r in first_within(whole, ["key"], "recorded_at", 24, "event_id").collect()} == {0, 100, 200, 202}


def test_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(5):
        S.append_batches(path)(spark.range(10), n)
    assert S.retained(spark, path, 25) == [0, 1] and spark.read.parquet(path).count() == 30


def test_append_once_fails_when_the_table_cannot_be_read(spark, tmp_path):
    import pytest

    bad = tmp_path / "out" / "batch=0"
    bad.mkdir(parents=True)
    (bad / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        S.append_once(str(tmp_path / "out"))(spark.createDataFrame([(1,)], "event_id long"), 1)


def hourly(spark, tmp_path, parts):
    """A stream of batches of (event_id, key, hour)."""
    shape = "event_id long, key string, recorded_at timestamp"
    frames = [spark.createDataFrame([(i, k, datetime(2024, 1, 1) + timedelta(hours=h)) for i, k, h in part], shape).coalesce(1) for part in parts]
    return S.in_turn(frames, str(tmp_path), 1)


def rows_of_state(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_state_of_keys_goes_after_their_lifetime(spark, tmp_path):
    """Many keys of the first day are forgotten once a later day's watermark has passed them."""
    parts = [[(k, f"k{k}", k % 5) for k in range(50)], [(100, "k0", 12), (101, "late", 13)], [(200, "other", 100)], [(300, "k0", 130)]]
    out = []
    progress = S.finish(S.idempotent(hourly(spark, tmp_path, parts), "key"), lambda b, n: out.extend(r.event_id for r in b.collect()), str(tmp_path / "state"))
    assert sorted(out) == [*range(50), 101, 200, 300]
    seen = rows_of_state(progress)
    assert max(seen) >= 50 and seen[-1] <= 6  # values and timers of the keys that are left


def test_full_buckets_are_forgotten(spark, tmp_path):
    parts = [[(k, f"k{k}", 0) for k in range(40)], [(100, "x", 1)], [(101, "x", 2)]]
    progress = S.finish(S.token_bucket(hourly(spark, tmp_path, parts), "key", "event_id", "recorded_at", 2, 4), S.append_batches(str(tmp_path / "out")), str(tmp_path / "state"))
    assert max(rows_of_state(progress)) >= 40 and rows_of_state(progress)[-1] <= 6
    assert spark.read.parquet(str(tmp_path / "out")).where("allowed").count() == 42


def test_upsert_leaves_other_days_alone(spark, tmp_path):
    """A batch writes the days that it touches; the other days' files stay as they are. A repeated batch changes nothing."""
    shape, path = "tenant_id long, n_events long, day date", str(tmp_path / "out")
    day = lambda d: datetime(2024, 1, d).date()
    files = lambda: {f"{f.parent.name}/{f.name}": f.stat().st_mtime_ns for f in (tmp_path / "out").glob("day=*/*.parquet")}
    each = S.upserted(path, ["tenant_id"])
    each(spark.createDataFrame([(1, 5, day(1)), (2, 7, day(1)), (1, 1, day(2))], shape), 0)
    first = files()
    for _ in range(2):
        each(spark.createDataFrame([(1, 6, day(1)), (1, 9, day(3))], shape), 1)
    got = {(r.tenant_id, r.day.day): r.n_events for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 6, (2, 1): 7, (1, 2): 1, (1, 3): 9}
    assert len(first.items() & files().items()) == 1


def test_sequential_dedup_as_a_stream(spark):
    """The stream's decisions over five batches are those of the batch form."""
    q = entry.queries()
    rows = lambda n: {r.id: (r.decision, r.match) for r in q[n](spark, SF).collect()}
    assert rows("stream_dedup") == rows("dedup_sequential")


def test_sequential_dedup_merges_over_batches(spark, tmp_path):
    from memlattice.operators import matching as M
    from memlattice.streaming.memories import sequential

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    said = ["I like green tea in the morning", "I like green tea in the mornings!", "i like green tea in the morning", None, "", "Another thing", "I like green tea in the mornings! Yes"]
    rows = spark.createDataFrame([(k, k % 2 * 0, f"t{k % 2}" if k > 3 else None, t) for k, t in enumerate(said)], "id long, user long, title string, text string")
    want = {r.id: (r.decision, r.match) for r in M.sequential_dedup(rows, ["user"], "id", "text", "title").collect()}
    root = str(tmp_path)
    S.fed([rows.where(F.floor(F.col("id") / 2) == k) for k in range(4)], root, lambda s: S.finish(sequential(s, ["user"], "id", "text", "title"), S.append_batches(f"{root}/out"), f"{root}/state"))
    got = {r.id: (r.decision, r.match) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == want and {d for d, _ in got.values()} == {"store", "merge", "discard"}


def test_event_log(spark, tmp_path):
    """Offsets, a bounded batch, a start at the end, retention, and a commit that is repeated."""
    from memlattice.sources import eventlog as E

    spark.dataSource.register(E.EventLog)
    log, shape = str(tmp_path / "log"), "n long, word string"
    frame = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("n"), F.lit("w").alias("word")).coalesce(1)

    def sent(s, **options):
        s.writeStream.format("eventlog").options(path=log, writer="w", **options).option("checkpointLocation", str(tmp_path / "sent")).trigger(availableNow=True).start().awaitTermination()

    def read(name, **options):
        s = spark.readStream.format("eventlog").schema(shape).options(path=log, **options).load()
        S.finish(s, S.append_batches(str(tmp_path / name)), str(tmp_path / f"{name}-state"))
        there = tmp_path / name
        return sorted(r.n for r in spark.read.parquet(str(there)).collect()) if there.exists() else []

    S.fed([frame(0, 10), frame(10, 20)], str(tmp_path / "in"), sent)
    assert [(a, b) for a, b, _ in E.segments(log)] == [(0, 10), (10, 20)]
    assert read("all") == list(range(20)) and read("new", start="latest") == []
    S.fed([frame(20, 30)], str(tmp_path / "in"), lambda s: sent(s, maxLength=15), first=2)
    assert read("all") == list(range(30)) and read("new", start="latest") == list(range(20, 30))
    assert [(a, b) for a, b, _ in E.segments(log)] == [(10, 20), (20, 30)]  # whole segments, 15 events or more
    assert spark.read.format("eventlog").schema(shape).option("path", log).load().count() == 20

    reader = E.LogStreamReader(log, "earliest", 5)
    assert reader.initialOffset() == {"offset": 10} and reader.latestOffset() == {"offset": 20}
    reader.partitions({"offset": 10}, {"offset": 20})
    assert reader.latestOffset() == {"offset": 30} and [(p.skip, p.most) for p in E.parts(log, 15, 25)] == [(5, 5), (0, 5)]

    writer = E.LogWriter(log, "other", 0)
    staged = lambda lo: writer.write(iter(frame(lo, lo + 3).toArrow().to_batches()))
    first = staged(30)
    writer.commit([first, None], 7)
    writer.commit([staged(30)], 7)  # the batch runs again
    assert [(a, b) for a, b, _ in E.segments(log)][-1] == (30, 33) and len(list((tmp_path / "log" / "staged").glob("*.parquet"))) == 0
    writer.abort([staged(50)], 8)
    assert len(E.segments(log)) == 3


def test_keys_share_the_calls_of_their_bucket(spark, tmp_path, monkeypatch):
    """state is read and written by buckets, whatever the number of keys; null keys are keys."""
    monkeypatch.setattr(S, "BUCKETS", 2)
    parts = [[(k, f"k{k}" if k % 9 else None, 2 * k) for k in range(40)], [(100 + k, f"k{k}" if k % 9 else None, 40 + 2 * k) for k in range(40)]]
    out, last, want = [], {}, set()
    progress = S.finish(S.idempotent(hourly(spark, tmp_path, parts), "key", late="9 days"), lambda b, n: out.extend((r.event_id, r.key) for r in b.collect()), str(tmp_path / "state"))
    for part in parts:
        for i, k, h in sorted(part, key=lambda r: (r[2], r[0])):
            if k not in last or h - last[k] >= 24:
                last[k] = h
                want.add((i, k))
    assert set(out) == want and len(out) == len(want)
    assert max(rows_of_state(progress)) <= 4 < len(last)  # a value and a timer for each bucket
