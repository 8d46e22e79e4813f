"""Similarity matches: duplicates, entities, contradictions.

Matches are sought within a block (tenant, user, kind) by a lossless similarity join, so that the similarity itself is
computed for few pairs. ``batch`` functions hold each incoming row against the snapshot; ``sequential_dedup`` lets
each row see what the rows before it left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.similarity import Texts
from ..functions.text import choose, strip
from . import simjoin


def best_match(incoming: DataFrame, existing: DataFrame, block: list[str], key: str, text: str, least: float, summary: str | None = None, earlier: bool = False, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``incoming`` with match and similarity: the existing row most similar to it, the smaller id of equals; null
    where none is similar by ``least`` or more, and never a row with similarity 0. With ``summary``, a column of
    ``existing``, the greater of the similarities to its text and to its text and summary counts. ``earlier``: only
    rows with a smaller key are candidates. ``similarity``: an expression or UDF (incoming, candidate) -> 0 to 1 in place
    of the built-in ratio; it is then computed for every pair of a block."""
    theirs = existing.select(*block, key, text, *([F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in (text, summary)]).alias("_longer")] if summary else []))
    sides = [text, "_longer"] if summary else [text]
    tables = [existing] if summary is None else [theirs.select(*block, key, F.col(c).alias(text)) for c in sides]
    if similarity is None and earlier:
        pairs = [best_earlier(incoming, tables, block, key, text, least)]
    elif similarity is None:
        pairs = [matched(incoming, x, block, key, text, least) for x in tables]
    else:
        both = incoming.select(*block, key, text).join(theirs.select(*block, F.col(key).alias("match"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(sides)]), block)
        both = both.where(F.col("match") < F.col(key) if earlier else F.col(key) != F.col("match"))
        pairs = [both.select(key, "match", similarity(F.col(text), F.col(f"_{i}")).alias("similarity")) for i in range(len(sides))]
    found = reduce(DataFrame.unionByName, pairs).where((F.col("similarity") >= least) & (F.col("similarity") > 0))
    top = found.groupBy(key).agg(F.min(F.struct((-F.col("similarity")).alias("far"), "match")).alias("_best"))
    top = top.select(key, F.col("_best.match").alias("match"), (-F.col("_best.far")).alias("similarity"))
    return incoming.join(top, key, "left")


def matched(incoming: DataFrame, existing: DataFrame, block: list[str], key: str, text: str, least: float) -> DataFrame:
    """(key, match, similarity): for each incoming row and each like text of another row, the smallest key with it."""
    left, ours = simjoin.texts(incoming, block, key, text)
    right, owners = (left, ours) if existing is incoming else simjoin.texts(existing, block, key, text)
    pairs = ours.withColumnRenamed("node", "left_node").join(simjoin.similar(left, right, block, least), "left_node")
    # a row is not its own match; the text may have another row
    second = owners.where("_key > node").groupBy(F.col("node").alias("right_node")).agg(F.min("_key").alias("second"))
    pairs = pairs.join(second, "right_node", "left").withColumn("match", F.when(F.col("right_node") == F.col("_key"), F.col("second")).otherwise(F.col("right_node")))
    return pairs.where("match IS NOT NULL").select(F.col("_key").alias(key), "match", F.col("ratio").alias("similarity"))


def best_earlier(incoming: DataFrame, existing: list[DataFrame], block: list[str], key: str, text: str, least: float) -> DataFrame:
    """(key, match, similarity): for each incoming row the best of the like texts of rows with a smaller key, by any of
    the tables ``existing``. Which one that is only changes with the key where a text is more alike than all that come
    before it, so each text has a short list of those, and no row meets all of its like texts."""
    left, ours = simjoin.texts(incoming, block, key, text)
    rights = [left if x is incoming else simjoin.texts(x, block, key, text)[0] for x in existing]
    pairs = reduce(DataFrame.unionByName, [simjoin.similar(left, x, block, least, earlier=True, best=True) for x in rights])
    pairs = pairs.groupBy("left_node", "right_node").agg(F.max("ratio").alias("ratio"))
    before = F.max("ratio").over(Window.partitionBy("left_node").orderBy("right_node").rowsBetween(Window.unboundedPreceding, -1))
    steps = pairs.withColumn("_before", before).where("_before IS NULL OR ratio > _before")
    steps = steps.groupBy("left_node").agg(F.sort_array(F.collect_list(F.struct(F.col("right_node").alias("match"), F.col("ratio").alias("similarity")))).alias("_steps"))
    found = ours.join(steps, ours.node == steps.left_node)
    found = found.withColumn("_best", F.try_element_at(F.filter("_steps", lambda x: x["match"] < F.col("_key")), F.lit(-1)))
    return found.where("_best IS NOT NULL").select(F.col("_key").alias(key), "_best.match", "_best.similarity")


def dedup_decision(similarity: Column) -> Column:
    return F.when(similarity > D.DUPLICATE_ABOVE, "discard").when(similarity >= D.MERGE_FROM, "merge").otherwise("store")


def merged_content(existing: Column, incoming: Column) -> Column:
    old, new = strip(existing), strip(incoming)
    return F.when((new != "") & ~F.contains(old, new), strip(F.concat(old, F.lit("\n\n"), new))).otherwise(old)


def merged_tags(existing: Column, incoming: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(existing, none), F.coalesce(incoming, none)))


def merged_data(existing: Column, incoming: Column) -> Column:
    """Maps united, the incoming value of a common key; keys in order."""
    keys = F.array_sort(F.array_union(F.map_keys(existing), F.map_keys(incoming)))
    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(incoming[k], existing[k]))), existing, incoming)


def entity_type(name: Column, kind: Column) -> Column:
    """By words within the name (also within longer words), else by the memory's kind."""
    low = F.lower(name)
    return F.when(low.rlike("|".join(D.TECHNOLOGY_WORDS)), "technology").when(low.rlike("|".join(D.COMPANY_WORDS)), "company").otherwise(choose(kind, D.ENTITY_OF_TYPE, "topic"))


def contradictions(new: DataFrame, current: DataFrame, block: list[str], detect: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """(new_id, old_id): all current rows of a block with a similar title and another content; with ``detect``, those
    for which it holds, given (title, content) of the new and the current row. Titles are matched once for each two
    different ones, and contents are compared by their digests."""
    if detect is not None:
        a = new.select(*block, F.col("id").alias("new_id"), F.col("title").alias("_a"), F.col("content").alias("_ac"))
        b = current.select(*block, F.col("id").alias("old_id"), F.col("title").alias("_b"), F.col("content").alias("_bc"))
        pairs = a.join(b, block).where(F.col("new_id") != F.col("old_id"))
        return pairs.where(detect(F.col("_a"), F.col("_ac"), F.col("_b"), F.col("_bc"))).select("new_id", "old_id")
    left, ours = simjoin.texts(new, block, "id", "title")
    right, theirs = (left, ours) if new is current else simjoin.texts(current, block, "id", "title")
    pairs = simjoin.similar(left, right, block, D.CONTRADICTION_FROM)
    digest = lambda x, of: x.select(F.col("id").alias(of), F.sha2(strip(F.col("content")), 256).alias(f"_{of}"))
    pairs = pairs.join(ours.select(F.col("_key").alias("new_id"), F.col("node").alias("left_node")), "left_node")
    pairs = pairs.join(theirs.select(F.col("_key").alias("old_id"), F.col("node").alias("right_node")), "right_node").where("new_id <> old_id")
    pairs = pairs.join(digest(new, "new_id"), "new_id").join(digest(current, "old_id"), "old_id")
    return pairs.where("_new_id <> _old_id").select("new_id", "old_id")


def supersede(current: DataFrame, pairs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(version rows, closed memories, audit rows) of contradicted memories; the smallest new id is what replaces one."""
    last = pairs.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("superseded_by"))
    hit = current.join(last, "id")
    versions = hit.select(F.col("id").alias("memory_id"), "superseded_by", "content", "importance", "valid_from", now.alias("valid_to"))
    closed = hit.select("id", now.alias("valid_to"))
    audit = hit.select(F.lit("supersede").alias("operation"), F.col("id").alias("target_id"), F.col("superseded_by").alias("by_id"), now.alias("created_at"))
    return versions, closed, audit


def superseded(current: DataFrame, pairs: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(version rows, closed memories, audit rows, edges) of contradictions, ``pairs`` (new_id, old_id): a version, an
    audit row with both contents and, for each entity of the new memory (``links``: memory_id, entity_id), an edge to
    itself for each pair; a memory is closed once. Give pairs that were written: they are read four times."""
    old = current.select(F.col("id").alias("old_id"), "content", "importance", "valid_from")
    both = pairs.join(old, "old_id")
    versions = both.select(F.col("old_id").alias("memory_id"), F.col("new_id").alias("superseded_by"), "content", "importance", "valid_from", now.alias("valid_to"))
    closed = pairs.select(F.col("old_id").alias("id")).distinct().select("id", now.alias("valid_to"))
    new = current.select(F.col("id").alias("new_id"), "organization_id", F.col("user_id").alias("actor_id"), F.col("content").alias("new_content"))
    audit = both.join(new, "new_id").select("organization_id", "actor_id", F.lit("memory_superseded").alias("operation"), F.col("old_id").alias("target_id"), F.col("new_id").alias("by_id"), F.col("content").alias("old_content"), "new_content", now.alias("created_at"))
    edges = pairs.join(links.select(F.col("memory_id").alias("new_id"), "entity_id").distinct(), "new_id")
    edges = edges.select("old_id", "new_id", F.col("entity_id").alias("source"), F.col("entity_id").alias("target"), F.lit("superseded_by").alias("relationship"))
    return versions, closed, audit, edges


class Stored:
    """A block's stored memories, in the order in which they were stored: [key, title, text]. What bounds leave of them
    is matched with a new one (``functions.similarity``)."""

    SPACE = " \t\n\r\f\v"

    def __init__(self, rows: Iterable[tuple[int, str, str]] = ()):
        self.rows = [[k, head, body] for k, head, body in rows]
        self.texts = Texts(self.whole(head, body) for _, head, body in self.rows)
        self.matcher = SequenceMatcher(None)

    @classmethod
    def whole(cls, head: str, body: str) -> str:
        return f"{head.strip(cls.SPACE)}\n{body.strip(cls.SPACE)}".strip(cls.SPACE).lower()

    def take(self, key: int, head: str, body: str) -> tuple[str, int | None]:
        """(decision, key of the match) for a new memory, which is stored or merged accordingly: a merge adds its text
        to the stored one, and its title if that has none."""
        new, best, at = self.whole(head, body), 0.0, None
        for i in self.texts.reach(new, D.MERGE_FROM).tolist():  # less than that is no match
            self.matcher.set_seqs(new, self.texts.texts[i])
            if (s := self.matcher.ratio()) >= D.MERGE_FROM and s > best:
                best, at = s, i
        if at is None:
            self.rows.append([key, head, body])
            self.texts.extend([new])
            return "store", None
        match, title, text = self.rows[at]
        if best > D.DUPLICATE_ABOVE:
            return "discard", match
        old, add = text.strip(self.SPACE), body.strip(self.SPACE)
        old = f"{old}\n\n{add}".strip(self.SPACE) if add and add not in old else old
        self.rows[at] = [match, title or head, old]
        self.texts.replace(at, self.whole(title or head, old))
        return "merge", match


def sequential_dedup(incoming: DataFrame, block: list[str], key: str, text: str, title: str | None = None) -> DataFrame:
    """(block, key, decision, match): each row of a block, in order of its key, against those stored before it, by the
    whole of title and text. ``streaming.memories.sequential`` does it batch by batch, with what is stored as state."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stored, out = Stored(), []
        for r in rows.sort_values(key).to_dict("records"):
            decision, match = stored.take(r[key], (r[title] or "") if title else "", r[text] or "")
            out.append({**{b: r[b] for b in block}, key: r[key], "decision": decision, "match": match})
        return pd.DataFrame(out).astype({"match": "Int64"})

    kinds = dict(incoming.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in block), f"{key} {kinds[key]}", "decision string", "match long"])
    return incoming.select(*block, key, text, *([title] if title else [])).groupBy(*block).applyInPandas(run, schema)


def entity_attributes(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, contents): distinct contents by the attribute that their kind goes to, in order of id."""
    kind = choose(F.col("memory_type"), {"fact": "facts", "preference": "preferences", "relationship": "relationships"}, "observations")
    g = df.groupBy(key, kind.alias("attribute")).agg(F.sort_array(F.collect_list(F.struct("id", "content"))).alias("ms"))
    return g.select(key, "attribute", F.array_distinct(F.col("ms.content")).alias("contents"))


def structured_attributes(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, data): the maps ``data`` of a key's rows united in order of id, the last value of each field."""
    fields = df.select(key, "id", F.explode(data).alias("_field", "_value")).groupBy(key, "_field").agg(F.max_by("_value", "id").alias("_value"))
    return fields.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_field", "_value")))).alias(data))


def entity_summary(df: DataFrame, key: str, most: int = 500) -> DataFrame:
    """(key, summary): contents in order of id, one a line unless contained already, cut at each step."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", strip(F.col("content")).alias("content")))).alias("ms"))
    step = lambda s, c: F.when(s == "", F.left(c, F.lit(most))).when((c != "") & ~F.contains(s, c), F.left(F.concat(s, F.lit("\n"), c), F.lit(most))).otherwise(s)
    return g.select(key, F.aggregate(F.col("ms.content"), F.lit(""), step).alias("summary"))
