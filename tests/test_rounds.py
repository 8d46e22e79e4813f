"""Walks, idempotency over long keys, supersession, edges, attributes, table functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlattice.operators import graph as G
from memlattice.operators import ingest as I
from memlattice.operators import matching as M
from memlattice.operators import usage as U
from memlattice.sources.scratch import Scratch


def let_through(times, life):
    out, last = [], None
    for i, t in sorted(enumerate(times), key=lambda x: (x[1], x[0])):
        if last is None or t - last >= life:
            out.append(i)
            last = t
    return out


def test_a_key_without_a_pause(spark):
    """200000 events of one key, 97 seconds apart: none meets all others in a task, and each is let through in turn."""
    n, life = 200_000, 24 * 3600
    df = spark.range(n).select(F.col("id").alias("event"), F.lit("k").alias("key"), F.timestamp_add("SECOND", (F.col("id") * 97).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("at"))
    got = [r.event for r in U.first_within(df, ["key"], "at", 24, "event").select("event").orderBy("event").collect()]
    assert got == let_through([i * 97 for i in range(n)], life)


def test_many_keys_ties_and_gaps(spark):
    from random import Random

    r = Random(3)
    rows = [(i, r.choice("abcd"), r.choice([0, 5, 24, 24, 48, 47, 100, 500, r.randrange(600)])) for i in range(400)] + [(1000, None, 1), (1001, None, 2)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, k, start + timedelta(hours=h)) for i, k, h in rows], "id long, key string, at timestamp_ntz")
    got = {x.id for x in U.first_within(df, ["key"], "at", 24, "id").collect()}
    want = set()
    for k in (*"abcd", None):
        own = sorted((h, i) for i, key, h in rows if key == k)
        want |= {own[j][1] for j in let_through([h for h, _ in own], 24)}
    assert got == want
    assert U.first_within(df.limit(0), ["key"], "at", 24, "id").count() == 0


def test_a_level_has_no_node_of_an_earlier_one(spark, monkeypatch):
    """A hub's edges are joined once: the levels together have each node once."""
    pairs = [("hub", f"n{i}") for i in range(50)] + [(f"n{i}", f"n{i + 1}") for i in range(49)] + [("n49", "far"), ("far", "farther"), ("farther", "end")]
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "source string, target string, relationship string")
    levels, plain = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: levels.append(plain(self, df, name)) or levels[-1])
    got = {r.id: r.depth for r in G.reach(edges, spark.createDataFrame([("hub",)], "id string"), 9).collect()}
    assert got == {"hub": 0, **{f"n{i}": 1 for i in range(50)}, "far": 2, "farther": 3, "end": 4}
    assert [x.count() for x in levels] == [1, 50, 1, 1, 1, 0]  # ends with the first that is empty


def test_each_contradiction_is_written(spark):
    rows = [(1, "o", 7, "old one", 0.5), (2, "o", 7, "old two", 0.5), (3, "o", 7, "new", 0.9), (4, "o", 8, "newer", 0.9)]
    start, now = datetime(2024, 1, 1), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    m = spark.createDataFrame([(*r, start) for r in rows], "id long, organization_id string, user_id long, content string, importance double, valid_from timestamp_ntz")
    pairs = spark.createDataFrame([(3, 1), (4, 1), (3, 2)], "new_id long, old_id long")
    links = spark.createDataFrame([(3, "e1"), (3, "e2"), (3, "e2"), (1, "e9")], "memory_id long, entity_id string")
    v, closed, audit, edges = M.superseded(m, pairs, links, now)
    assert {(r.memory_id, r.superseded_by, r.content) for r in v.collect()} == {(1, 3, "old one"), (1, 4, "old one"), (2, 3, "old two")}
    assert sorted(r.id for r in closed.collect()) == [1, 2]
    assert {(r.target_id, r.by_id, r.old_content, r.new_content, r.actor_id) for r in audit.collect()} == {(1, 3, "old one", "new", 7), (1, 4, "old one", "newer", 8), (2, 3, "old two", "new", 7)}
    assert sorted((r.old_id, r.source, r.target) for r in edges.collect()) == [(1, "e1", "e1"), (1, "e2", "e2"), (2, "e1", "e1"), (2, "e2", "e2")]


def test_edges_stay_within_the_tenant(spark):
    kind = "id long, organization_id string, title string, edges array<struct<source: string, target: string, relationship: string, organization_id: string>>"
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    rows, edges = I.with_edges(spark.createDataFrame([(1, "a", "t", [("x", "y", "r", "a")]), (2, "a", "t", None)], kind), "edges", now)
    assert rows.count() == 2 and "edges" not in rows.columns and [tuple(r) for r in edges.collect()] == [(1, "x", "y", "r", "a")]
    for bad in ("b", None):
        _, edges = I.with_edges(spark.createDataFrame([(1, "a", "t", [("x", "y", "r", bad)])], kind), "edges", now)
        with pytest.raises(Exception, match="tenant mismatch"):
            edges.collect()


def test_the_last_of_each_field_stays(spark):
    df = spark.createDataFrame([("e", 2, {"a": "2", "b": "2"}), ("e", 1, {"a": "1", "c": "1"}), ("e", 3, None), ("f", 1, {})], "k string, id long, data map<string, string>")
    assert [(r.k, r.data) for r in M.structured_attributes(df, "k", "data").collect()] == [("e", {"a": "2", "b": "2", "c": "1"})]


def test_a_provider_as_a_table_function(spark):
    I.register_extractor(spark, "halves", lambda said: [(x, "fact") for x in said.split("|") if x])
    spark.createDataFrame([(1, "a|b"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in spark.sql("SELECT id, idx, content FROM texts, LATERAL halves(t) ORDER BY id, idx").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b")]
    assert list(I.by_rules("I love tea. We work! Then what? I plan to go")) == [("I love tea.", "preference"), ("We work!", "project"), ("Then what?", "fact"), ("I plan to go", "goal")]
