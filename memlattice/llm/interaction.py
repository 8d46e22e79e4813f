"""Filter interaction audit: what each of five filters removes, in every order that they can be applied in.

Four filters look at a text alone; the fifth fails a text that a smaller id has as well. Equal texts are found by
sorting: rows are dealt by ranges of (fingerprint, id), sorted by fingerprint, whole text and id, and compared with the
row before. A run of equal texts at the edge of its range may go on in the next one, so the smallest ids of such runs
(two a range, but for colliding fingerprints) are merged by their whole texts. The text is no part of the ranges'
bounds, as bounds pass through the driver.

A row's failures are a mask of five bits. Masks are counted by part, which is additive, and each of the 600 pairs of an
order and a step is a sum of these 32 counters.

Edge cases: a null text is an empty one, without words, and fails the first filter; a null language is the empty part. A
row without an id is smaller than none and none is smaller than it, so it neither fails the fifth filter nor makes
others fail it; nor do rows that repeat an id, among themselves. Labels that repeat an id count by their largest value,
null labels for nothing. Texts of any length are read whole. Further columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, table
from .lines import let

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: Each order and step, with the bit of the step's filter and the bits of those before it.
STEPS = [{"filter_order": "".join(o), "step": k + 1, "own": BIT[f], "before": sum(BIT[x] for x in o[:k])} for o in permutations(FILTERS) for k, f in enumerate(o)]


def failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    few = lambda w: F.when(F.size(w) < 100, BIT["A"]).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), BIT["B"]).otherwise(0)
    upper = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"), BIT["C"]).otherwise(0)
    return let(words, few) + upper + F.when(text.rlike(r"[#$%&*|]"), BIT["D"]).otherwise(0)


KIND = "at int, run long, id long, part string, fails int, again boolean, fp long, fp2 long, text binary"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range (at, fp, fp2, text, id, part, fails): each row with the number of its run of equal texts and
    ``again``, whether the run began with a smaller id. Then, with a text, the runs that share a fingerprint with the
    range's first or last row and the id that each began with."""
    key = text = first = at = None  # of the row before: fingerprint and text; the id that its run began with
    run, head_key = -1, None
    head: list[tuple] = []
    tail: list[tuple] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        at = b.column("at")[0].as_py()
        fp, fp2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "fp2"))
        keys = np.stack([fp, fp2], axis=1)
        body, ids = b.column("text"), b.column("id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        num = ids.fill_null(0).to_numpy(zero_copy_only=False)
        same_key, same = np.zeros(n, bool), np.zeros(n, bool)
        same_key[1:] = (keys[1:] == keys[:-1]).all(axis=1)
        same[1:] = same_key[1:] & pc.equal(body.slice(1), body.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same_key[0] = key is not None and bool((keys[0] == key).all())
        same[0] = same_key[0] and body[0].as_py() == text
        runs = run + np.cumsum(~same)
        began = np.maximum.accumulate(np.where(same, -1, np.arange(n)))  # the row of this batch that the run began with
        low = np.where(began >= 0, num[began], 0 if first is None else first)
        no_low = np.where(began >= 0, none[began], first is None)
        again = ~none & ~no_low & (num > low)
        if head_key is None:
            head_key = keys[0].copy()
        for k in np.flatnonzero(~same & (keys == head_key).all(axis=1)).tolist():
            head.append((int(runs[k]), *map(int, keys[k]), ids[k].as_py(), body[k].as_py()))
        last = (keys == keys[-1]).all(axis=1)
        if not (last[0] and same_key[0]):
            tail = []
        for k in np.flatnonzero(~same & last).tolist():
            tail.append((int(runs[k]), *map(int, keys[k]), ids[k].as_py(), body[k].as_py()))
        key, text, run = keys[-1].copy(), body[n - 1].as_py(), int(runs[-1])
        first = None if no_low[-1] else int(low[-1])
        yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(runs, pa.int64()), ids, b.column("part"), b.column("fails"), pa.array(again), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["at", "run", "id", "part", "fails", "again", "fp", "fp2", "text"])
    edges = sorted({r: r for r in (*head, *tail)}.values(), key=lambda r: r[0])
    if edges:
        run_, fp_, fp2_, id_, text_ = zip(*edges)
        m = len(edges)
        yield pa.RecordBatch.from_arrays([pa.array([at] * m, pa.int32()), pa.array(run_, pa.int64()), pa.array(id_, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.array(fp_, pa.int64()), pa.array(fp2_, pa.int64()), pa.array(text_, pa.binary())], names=["at", "run", "id", "part", "fails", "again", "fp", "fp2", "text"])


def masks(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails) for each row: the bits of all five filters. The text is shuffled once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"), F.xxhash64(F.lit(1), text).alias("fp2"))
    dealt = src.repartitionByRange("fp", "fp2", "id").sortWithinPartitions("fp", "fp2", "text", F.asc_nulls_last("id"))
    dealt = dealt.select(F.spark_partition_id().alias("at"), "fp", "fp2", F.col("text").cast("binary").alias("text"), "id", "part", failures(F.col("text")).cast("int").alias("fails"))
    found = scratch.write(dealt.mapInArrow(compared, KIND), "compared")
    edges = found.where("text IS NOT NULL").groupBy("fp", "fp2", "text").agg(F.min("id").alias("low"), F.collect_list(F.struct("at", "run")).alias("runs"))
    edges = edges.select("low", F.inline("runs"))
    rows = found.where("text IS NULL").join(F.broadcast(edges), ["at", "run"], "left")  # two runs a range
    again = F.coalesce(F.col("id") > F.col("low"), "again", F.lit(False))
    return rows.select("id", "part", (F.col("fails") + F.when(again, BIT["E"]).otherwise(0)).alias("fails"))


def counters(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): how many rows of a part have a mask, and how many of these each label."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("quality").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("good = 1 OR toxic = 1")
    one = lambda c: F.count(F.when(F.col(c) == 1, 1)).alias(c)
    return marked.join(known, "id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): the filters'
    effect in each part (language), order and step; shapley is what the step's filter removes, summed over all orders."""
    scratch = Scratch(docs.sparkSession, "interaction")
    counted = scratch.write(counters(masks(docs, scratch), labels), "counters")
    steps = F.from_json(F.lit(json.dumps(STEPS)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    each = counted.select("part", "fails", "n", "good", "toxic", F.inline(steps))
    fails, own, before = F.col("fails"), F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total("n", ~own & ~before).alias("kept"), total("n", own & ~before).alias("removed"), total("n", own & before).alias("redundant"),
        total("n", fails == F.col("own")).alias("unique_fails"), total("good", own & ~before).alias("good_lost"), total("toxic", own & ~before).alias("toxic_lost"),
        F.sum(F.when(own, F.col("n") * F.expr("120 DIV bit_count(fails)")).otherwise(0)).cast("long").alias("shapley"),
    )


def op11_filter_interaction(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {"op11_filter_interaction": op11_filter_interaction}

SQL = {
    "op11_filter_interaction": r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
  FROM documents
), known AS (
  SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id
), marked AS (
  SELECT part, coalesce(good = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(docs.doc_id > low, false) AS e
  FROM docs LEFT JOIN known USING (doc_id)
), counted AS (
  SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM marked GROUP BY ALL
), letter AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [p.k, q.k, r.k, s.k, t.k] AS ks FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), steps AS (SELECT ks, step, ks[step] AS own, ks[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
each AS (
  SELECT part, good, toxic, n, ks, step, own, fails[own] AS f,
         list_bool_or(list_prepend(false, list_transform(before, lambda k: fails[k]))) AS b,
         len(list_filter(fails, lambda x: x)) AS many
  FROM counted, steps
), main AS (
  SELECT part, array_to_string(list_transform(ks, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step, own,
         coalesce(sum(n) FILTER (NOT f AND NOT b), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (f AND NOT b), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (f AND b), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (f AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (f AND NOT b AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (f AND NOT b AND toxic), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY part, ks, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM main
"""
}
