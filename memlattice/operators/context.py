"""Context assembly: sections, token budgets, rendering; compression, clusters and dream questions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import text


def shares(total: Column | int, weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Each category's part of ``total`` tokens: the whole tokens of its proportion, and of those that are then left
    one for each of the first categories."""
    weights = weights or D.BUDGET
    total = F.lit(total).cast("long") if isinstance(total, int) else total
    parts = [F.floor(total * F.lit(float(w)) / F.lit(float(sum(weights.values())))) for w in weights.values()]
    left = total - sum(parts, F.lit(0))
    return {c: (part + (left > k).cast("long")).alias(c) for k, (c, part) in enumerate(zip(weights, parts))}


def category(kind: Column) -> Column:
    return text.choose(kind, D.CATEGORY, "facts")


def section(kind: Column) -> Column:
    return text.choose(kind, D.SECTION, "relevant_memories")


def valid(df: DataFrame) -> DataFrame:
    return df.where("NOT is_archived AND valid_to IS NULL")


def sections(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, section, n, ids): a request's memories by section, most important first."""
    s = df.withColumn("section", section(F.col("memory_type")))
    return s.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id"))).alias("_m")).select(*keys, "section", "n", F.col("_m.id").alias("ids"))


def pack_prefix(df: DataFrame, most: int, per: str, *order: Column) -> DataFrame:
    """Items of each ``per`` in order until the first that would overflow; ``used``: tokens up to and with an item."""
    w = Window.partitionBy(per).orderBy(*order)
    used = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max(F.when(F.col("used") > most, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).withColumn("_over", over).where("_over = 0").drop("_over")


def _greedy(items: Column, budget: Column) -> Column:
    """(used, ids) of a fold that takes each item that still fits, in order of (o, id), and skips the others."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fits = lambda s, x: s["used"] + x["tokens"] <= budget
    return F.aggregate(
        items, start,
        lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), F.array_append(s["ids"], x["id"])).otherwise(s["ids"]).alias("ids")),
    )


def pack_greedy(df: DataFrame, per: str, total: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(per, ids, usage): items (id, category, tokens, relevance) of each request within its budget.

    First each category takes, most relevant first, what fits into its share, skipping what does not; then what is
    unused goes to the rest of all categories in the same way. Both are folds over a request's own items.
    """
    item = F.struct((-F.col("relevance")).alias("o"), F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"))
    by = df.groupBy(per, "category").agg(F.sort_array(F.collect_list(item)).alias("items"))
    share = F.lit(0).cast("long")
    for c, part in shares(total, weights).items():
        share = F.when(F.col("category") == c, part).otherwise(share)
    first = by.withColumn("got", _greedy(F.col("items"), share))
    first = first.withColumn("rest", F.filter("items", lambda x: ~F.array_contains(F.col("got.ids"), x["id"])))
    whole = first.groupBy(per).agg(F.flatten(F.collect_list("got.ids")).alias("a"), F.sum("got.used").alias("used"), F.sort_array(F.flatten(F.collect_list("rest"))).alias("rest"))
    second = whole.withColumn("more", _greedy(F.col("rest"), F.lit(total).cast("long") - F.col("used")))
    return second.select(per, F.sort_array(F.concat("a", F.col("more.ids"))).alias("ids"), (F.col("used") + F.col("more.used")).alias("used"))


def bullet(kind: Column, title: Column, content: Column, score: Column) -> Column:
    return F.concat(F.lit("- ["), kind, F.lit("] "), title, F.lit(": "), content, F.lit(" (score: "), F.format_string("%.3f", score), F.lit(")"))


#: Headings of a prompt's sections, in order.
HEADINGS = {"active_projects": "Active Projects", "preferences": "Preferences", "goals": "Goals", "recent_events": "Recent Events", "relevant_memories": "Relevant Memories"}


def prompt(df: DataFrame, per: str) -> DataFrame:
    """(per, prompt): each request's memories under their sections' headings, most important first; goals with their
    state and importance, others with their kind, content and score. Sections without memories are left out."""
    place = text.choose(section(F.col("memory_type")), {s: k for k, s in enumerate(HEADINGS)})
    line = F.when(F.col("memory_type") == "goal", goal_line(F.col("title"), F.col("memory_state"), F.col("importance"))).otherwise(bullet(F.col("memory_type"), F.col("title"), F.col("content"), F.col("importance")))
    rows = df.select(per, place.alias("place"), F.struct((-F.col("importance")).alias("o"), "id", line.alias("line")).alias("l"))
    parts = rows.groupBy(per, "place").agg(F.array_join(F.sort_array(F.collect_list("l")).getField("line"), "\n").alias("lines"))
    heading = text.choose(F.col("place"), dict(enumerate(HEADINGS.values())))
    parts = parts.select(per, F.struct("place", F.concat(F.lit("## "), heading, F.lit("\n"), "lines").alias("body")).alias("p"))
    return parts.groupBy(per).agg(F.array_join(F.sort_array(F.collect_list("p")).getField("body"), "\n\n").alias("prompt"))


def goal_line(description: Column, status: Column, progress: Column) -> Column:
    return F.format_string("- %s [%s] (%.0f%%)", description, status, progress * 100)


def compress(df: DataFrame, key: str, least: int = 20) -> DataFrame:
    """(key, summary_text, key_facts, confidence, source_memory_count) for keys with ``least`` memories or more: the
    first two fifths of their joined contents, and ten titles, in order of id."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("source_memory_count"), F.sort_array(F.collect_list(F.struct("id", "title", "content"))).alias("ms")).where(F.col("source_memory_count") >= least)
    whole = F.array_join(F.col("ms.content"), " ")
    cut = F.greatest(F.lit(1), F.floor(F.length(whole) * F.lit(0.4).cast("double")).cast("int"))
    return g.select(key, F.left(whole, cut).alias("summary_text"), F.slice(F.col("ms.title"), 1, 10).alias("key_facts"), F.lit(0.7).alias("confidence"), "source_memory_count", F.lit(False).alias("is_stale"))


def clusters(df: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """(keys, member) of clusters with ``least`` members or more; smaller ones dissolve."""
    n = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(n)).where(F.col("_n") >= least).select(*keys, F.col("id").alias("member"))


def question(name: Column) -> Column:
    return F.format_string("What do we know about %s?", name)


def utility_delta(confidence: Column) -> Column:
    return F.when(confidence >= 0.5, 0.05).otherwise(-0.05)


def mark_stale(summaries: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``summaries`` with is_stale set for the keys whose sources changed."""
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return summaries.join(hit, key, "left").withColumn("is_stale", F.col("is_stale") | F.coalesce("_hit", F.lit(False))).drop("_hit")
