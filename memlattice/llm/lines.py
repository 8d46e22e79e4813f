"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the last two line hashes decides where a boundary lies, so that a line put in or left out moves the
boundaries near it only. From each boundary a chunk runs to the next one that is two lines away or more. A chunk that
occurs more than once anywhere is removed but for its first occurrence (smallest id, then hash of the text, then
place), after comparing bytes: hashes only bring candidates together. As the boundaries at the ends of a repeated
passage depend on the lines around it, what was matched is then extended line by line, before and after, for as long as
the lines are equal, byte for byte, to those around the first occurrence.

A line goes only if an equal one stands at an earlier place, in a document or text before it or further up, so one copy
of each passage stays.

Edge cases: a null text stays null, an empty one empty. A single repeated line stays, however long it is, unless it
stands next to a repeated chunk in both places; a repeated chunk goes however short it is, but not if it is blank. A
text whose chunks all occur earlier becomes empty. Rows that share an id and a text keep the same lines; rows without
an id come after all others. Further columns are kept as they are by ``clean``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Query, Scratch, table

#: Of SHARE[1] places, SHARE[0] are boundaries; lines that a match is extended by on each side, at most: a passage with
#: no boundary in so many lines is one in 4^12.
SHARE, REACH = (3, 4), 12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often and within whatever lambdas it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(text: Column) -> Column:
    """Array of chunks (pos: the first line, from 0; n: how many lines; k: a hash of theirs)."""

    def cuts(hs: Column) -> Column:
        """The first lines of chunks, and the number of lines as the last cut."""
        rolled = lambda i: F.xxhash64(F.element_at(hs, i - 1), F.element_at(hs, i))
        inner = F.filter(F.sequence(F.lit(2), F.greatest(F.size(hs) - 1, F.lit(2))), lambda i: (i < F.size(hs)) & (F.pmod(rolled(i), F.lit(SHARE[1])) < SHARE[0]))
        return F.concat(F.array(F.lit(0)), inner, F.array(F.size(hs)))

    def spans(hs: Column, at: Column) -> Column:
        where = lambda i: F.element_at(at, F.least(i + 1, F.size(at)))
        end = lambda a, i: F.when(where(i + 1) >= a + 2, where(i + 1)).otherwise(where(i + 2))
        one = lambda a, i: let(end(a, i), lambda b: F.struct(a.alias("pos"), (b - a).alias("n"), F.xxhash64(F.slice(hs, a + 1, b - a)).alias("k")))
        return F.filter(F.transform(at, one), lambda c: c["n"] > 1)

    return let(F.transform(split_lines(text), lambda x: F.xxhash64(x)), lambda hs: let(cuts(hs), lambda at: spans(hs, at)))


def place(prefix: str = "") -> Column:
    """An occurrence's place in the order of all texts; rows without an id come last."""
    return F.struct(F.col(f"{prefix}id").isNull().alias("none"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}h").alias("h"), F.col(f"{prefix}pos").alias("pos"))


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (keys, lo, hi) with intervals that overlap or touch as one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.when(F.col("lo") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def matches(whole: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h, f_id, f_h, shift, lo, hi): runs of lines of the document (id, h) that equal, byte for byte, the lines
    ``shift`` further up of the document (f_id, f_h), which come first.

    Hashes are counted and matched first, so that only chunks that may repeat are formed as text, and groups of equal
    chunks are reduced before they are shuffled. The joins are sort-merge joins at every size: no side is bounded.
    """
    src = scratch.write(whole.select("id", "h", F.explode(chunks(F.col("text"))).alias("c")).select("id", "h", "c.*"), "chunks")
    many = scratch.write(src.groupBy("k").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k"), "many")
    found = src.join(many.hint("merge"), "k", "left_semi").groupBy(F.col("id").alias("of"), F.col("h").alias("hash")).agg(F.collect_set(F.struct("pos", "n", "k")).alias("cs"))
    found = whole.join(scratch.write(found, "found").hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")))
    body = lambda c: F.struct(c["pos"].alias("pos"), c["n"].alias("n"), c["k"].alias("k"), F.array_join(F.slice(F.col("lines"), c["pos"] + 1, c["n"]), "\n").alias("body"))
    found = found.select("id", "h", "cs", split_lines(F.col("text")).alias("lines")).select("id", "h", F.explode(F.transform("cs", body)).alias("c"))
    found = scratch.write(found.select("id", "h", "c.*").where(F.col("body").rlike(r"\S")), "candidates")
    first = found.groupBy("k", "body").agg(F.min(place()).alias("f"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    first = scratch.write(first, "first")  # with a shuffle of its own, the join's large groups can be split
    again = found.join(first.hint("merge"), ["k", "body"]).where(place() > F.col("f"))
    again = again.select("id", "h", F.col("f.id").alias("f_id"), F.col("f.h").alias("f_h"), (F.col("pos") - F.col("f.pos")).alias("shift"), F.col("pos").alias("lo"), (F.col("pos") + F.col("n")).alias("hi"))
    return scratch.write(merged(again.distinct(), ["id", "h", "f_id", "f_h", "shift"]), "runs")


def extended(runs: DataFrame, whole: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h, lo, hi): the runs with the lines before and after them that are equal in both documents.

    Only the lines around a run are read, once for each place that is asked for, however many runs ask for it.
    """
    at = runs.select("id", "h", "lo", "hi").unionByName(runs.select(F.col("f_id").alias("id"), F.col("f_h").alias("h"), (F.col("lo") - F.col("shift")).alias("lo"), (F.col("hi") - F.col("shift")).alias("hi")))
    asked = scratch.write(at.groupBy(F.col("id").alias("of"), F.col("h").alias("hash")).agg(F.collect_set(F.struct("lo", "hi")).alias("asked")), "asked")
    docs = whole.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")))
    docs = docs.select("id", "h", "asked", split_lines(F.col("text")).alias("lines"))
    up = lambda r: F.reverse(F.slice(F.col("lines"), F.greatest(r["lo"] - REACH, F.lit(0)) + 1, F.least(r["lo"], F.lit(REACH))))
    down = lambda r: F.slice(F.col("lines"), r["hi"] + 1, F.lit(REACH))
    around = docs.select("id", "h", F.explode(F.transform("asked", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), up(r).alias("up"), down(r).alias("down")))).alias("a"))
    around = scratch.write(around.select("id", "h", "a.*").distinct(), "around")
    own = around.toDF("o_id", "o_h", "o_lo", "o_hi", "up", "down")
    theirs = around.toDF("t_id", "t_h", "t_lo", "t_hi", "t_up", "t_down")
    both = runs.join(own.hint("merge"), F.expr("id <=> o_id AND h = o_h AND lo = o_lo AND hi = o_hi"))
    both = scratch.write(both.select("id", "h", "f_id", "f_h", "lo", "hi", (F.col("lo") - F.col("shift")).alias("f_lo"), (F.col("hi") - F.col("shift")).alias("f_hi"), "up", "down"), "sides")
    both = both.join(theirs.hint("merge"), F.expr("f_id <=> t_id AND f_h = t_h AND f_lo = t_lo AND f_hi = t_hi"))

    def alike(a: str, b: str) -> Column:
        """How many lines are equal from the run on."""
        equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        return F.when(F.array_position(equal, False) > 0, F.array_position(equal, False) - 1).otherwise(F.size(equal)).cast("int")

    return both.select("id", "h", (F.col("lo") - alike("up", "t_up")).alias("lo"), (F.col("hi") + alike("down", "t_down")).alias("hi"))


def repeated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lo, hi): the lines to remove, from lo up to hi, of the document of this id and hash of text; a document's
    ranges neither overlap nor touch."""
    whole = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return merged(extended(matches(whole, scratch), whole, scratch).distinct(), ["id", "h"])


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "_removed_lines") -> DataFrame:
    """``docs`` with ``text_col`` cleaned and a column ``count_col``: how many lines went."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated(docs, scratch, id_col, text_col)
    gone = gone.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"))
    gone = scratch.write(gone, "gone")
    for used in ("chunks", "many", "found", "candidates", "first", "runs", "asked", "around", "sides"):
        scratch.drop(used)
    # The document travels as one value, so that none of its columns can clash with a name used here.
    text = F.col(f"`{text_col}`")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("key"), F.xxhash64(text).alias("hash"))
    wide = whole.join(gone.hint("merge"), F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    body = F.col("doc").getField(text_col)

    def rest(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["hi"]))
        ends = F.concat(F.transform("gone", lambda g: g["lo"]), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    left = let(split_lines(body), rest)
    count = F.aggregate("gone", F.lit(0), lambda n, g: n + g["hi"] - g["lo"])
    kept = [(F.when(F.col("gone").isNull(), body).otherwise(left) if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return wide.select(*kept, F.coalesce(count, F.lit(0)).cast("long").alias(count_col))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_removed_lines").alias("removed_lines"))


QUERIES: dict[str, Query] = {"op10_line_dedup": op10_line_dedup}
