"""Decay, reflection, flags, entity status."""

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import lifecycle as L
from ..operators.scans import affected, apply_changes
from ..sources import views as V
from .ctes import GOA, MEM, age, strip
from .registry import query

NOW = V.ORDERS_NOW
STEP = f"""CASE WHEN is_pinned THEN memory_state WHEN memory_state = 'active' AND {age("seen_at", NOW)} >= 30 THEN 'warm' WHEN memory_state = 'warm' AND {age("seen_at", NOW)} >= 90 THEN 'cold'
  WHEN memory_state = 'cold' AND {age("seen_at", NOW)} >= 180 THEN 'archived' ELSE memory_state END"""


@query(f"WITH {GOA} SELECT id, memory_state, {STEP} AS new_state FROM goa")
def decay_transition(spark, sf):
    return L.decayed(V.goals(spark, sf), F.col("seen_at"), V.at(NOW)).select("id", "memory_state", "new_state")


@query(f"WITH {GOA}, d AS (SELECT *, {STEP} AS new_state FROM goa WHERE NOT is_pinned AND NOT is_archived) SELECT memory_state, count(*) AS processed, count(*) FILTER (WHERE new_state <> memory_state) AS updated FROM d GROUP BY memory_state")
def decay_summary(spark, sf):
    g = L.decay_candidates(V.goals(spark, sf).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")))
    d = L.decayed(g, F.col("seen_at"), V.at(NOW))
    return d.groupBy("memory_state").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("new_state") != F.col("memory_state")).alias("updated"))


MSTEP = STEP.replace("seen_at", "coalesce(last_accessed_at, updated_at, created_at)").replace(NOW, "2024-06-01")


@query(f"WITH {MEM} SELECT id, {MSTEP} AS new_state FROM mem WHERE NOT is_pinned AND NOT is_archived AND valid_to IS NULL")
def decay_batch(spark, sf):
    """Ages count from the last access, else the last update, else creation."""
    seen = scoring.last_seen(F.col("last_accessed_at"), F.col("updated_at"), F.col("created_at"))
    return L.decayed(L.decay_candidates(V.memories(spark, sf)), seen, V.at("2024-06-01 00:00:00")).select("id", "new_state")


@query(f"WITH {MEM} SELECT id, CASE WHEN memory_state IN ('warm', 'cold') THEN 'active' ELSE memory_state END AS memory_state FROM mem")
def reactivate(spark, sf):
    return V.memories(spark, sf).select("id", scoring.reactivate(F.col("memory_state")).alias("memory_state"))


@query(f"WITH {GOA} SELECT id, 'cold' AS new_state, round(greatest(0.0, importance - 0.3), 6) AS new_importance FROM goa WHERE memory_type = 'goal' AND NOT is_pinned AND NOT is_archived AND {age('seen_at', NOW)} >= 180")
def dormant_goals(spark, sf):
    g = V.goals(spark, sf).where("NOT is_pinned AND NOT is_archived").where(L.dormant(F.col("memory_type"), F.col("seen_at"), V.at(NOW)))
    return L.reflected(g, F.col("seen_at"), V.at(NOW)).select("id", "new_state", F.round("new_importance", 6).alias("new_importance"))


@query(f"SELECT min(doc_id) AS id, count(*) AS n_merged FROM documents GROUP BY lower({strip('text')})")
def merge_exact_duplicates(spark, sf):
    d = V.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower(text.strip(F.col("text"))).alias("k"))
    return d.groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_merged")).drop("k")


@query(f"WITH {MEM} SELECT id, organization_id FROM mem QUALIFY row_number() OVER (PARTITION BY organization_id, lower({strip('content')}) ORDER BY id) = 1")
def merged_memories(spark, sf):
    return L.merge_exact(V.memories(spark, sf), "content", "organization_id").select("id", "organization_id")


FLAGS = {"pin": ("is_pinned", True, 10, 0), "unpin": ("is_pinned", False, 10, 1), "archive": ("is_archived", True, 10, 2), "restore": ("is_archived", False, 10, 3), "delete": (None, None, 10, 4)}


def flag_log(df):
    rows = []
    for n, (op, (column, value, m, r)) in enumerate(FLAGS.items()):
        pick = lambda c: F.lit(value if c == column else None).cast("boolean").alias(c)  # noqa: B023, E731
        rows.append(df.where(F.col("id") % m == r).select("id", F.lit(n).alias("seq"), F.lit(op).alias("kind"), F.lit("delete" if op == "delete" else "update").alias("op"), pick("is_pinned"), pick("is_archived")))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


@query(f"WITH {MEM} SELECT id, CASE id % 10 WHEN 0 THEN true WHEN 1 THEN false ELSE is_pinned END AS is_pinned, CASE id % 10 WHEN 2 THEN true WHEN 3 THEN false ELSE is_archived END AS is_archived FROM mem WHERE id % 10 <> 4")
def flag_changes(spark, sf):
    """Pin, unpin, archive, restore and delete as a change log, applied."""
    base = V.memories(spark, sf).select("id", "is_pinned", "is_archived")
    return apply_changes(base, flag_log(base).drop("kind"))


@query(f"WITH {MEM} SELECT op, count(*) AS n_rows FROM (SELECT ['pin', 'unpin', 'archive', 'restore', 'delete'][id % 10 + 1] AS op FROM mem WHERE id % 10 < 5) GROUP BY op")
def flag_change_counts(spark, sf):
    base = V.memories(spark, sf).select("id", "is_pinned", "is_archived")
    return affected(base, flag_log(base).drop("op").withColumnRenamed("kind", "op"))


STATUS = f"""{GOA}, c AS (SELECT 'customer:' || user_id AS id, ['active', 'inactive', 'archived'][user_id % 3 + 1] AS status, max(seen_at) AS updated FROM goa GROUP BY user_id)"""


def customers(spark, sf):
    return V.goals(spark, sf).groupBy("user_id").agg(F.max("seen_at").alias("updated")).select(F.concat(F.lit("customer:"), "user_id").alias("id"), V.pick(["active", "inactive", "archived"], F.col("user_id") % 3).alias("status"), "updated")


@query(f"WITH {STATUS} SELECT id, status, CASE WHEN status = 'active' AND updated <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'inactive' ELSE status END AS new_status FROM c")
def stale_entities(spark, sf):
    c = customers(spark, sf)
    return c.select("id", "status", F.when(L.stale(F.col("status"), F.col("updated"), V.at(NOW)), "inactive").otherwise(F.col("status")).alias("new_status"))


@query(f"""WITH {STATUS}, t AS (SELECT id, status, unnest(['active', 'inactive', 'archived']) AS wanted FROM c)
SELECT id, status, wanted, (status = 'active' AND wanted = 'inactive' OR status = 'inactive' AND wanted IN ('active', 'archived')) AS legal FROM t""")
def status_transition(spark, sf):
    c = customers(spark, sf).withColumn("wanted", F.explode(F.array(*map(F.lit, ["active", "inactive", "archived"]))))
    return c.select("id", "status", "wanted", L.legal_move(F.col("status"), F.col("wanted")).alias("legal"))


@query(f"WITH {MEM} SELECT id, CASE WHEN id % 6 = 0 THEN '2025-01-01' ELSE strftime(coalesce(last_accessed_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') END AS accessed FROM mem")
def touch_accessed(spark, sf):
    base = V.memories(spark, sf).select("id", "last_accessed_at")
    log = base.where("id % 6 = 0").select("id", F.lit(1).alias("seq"), F.lit("update").alias("op"), V.at("2025-01-01 00:00:00").alias("last_accessed_at"))
    out = apply_changes(base, log)
    return out.select("id", F.date_format(F.coalesce("last_accessed_at", V.at("1970-01-01 00:00:00")), "yyyy-MM-dd").alias("accessed"))


@query("WITH s AS (SELECT DISTINCT conv_id AS id FROM conversations) SELECT id, CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 'ended now' WHEN id % 7 = 0 THEN 'open' ELSE 'ended before' END AS state FROM s")
def session_end(spark, sf):
    """Ending changes only sessions that are open."""
    s = V.sessions(spark, sf).select("id", F.when(F.col("ended_at").isNull(), "open").otherwise("ended before").alias("state"))
    log = s.where("state = 'open' AND id % 2 = 0").select("id", F.lit(1).alias("seq"), F.lit("update").alias("op"), F.lit("ended now").alias("state"))
    return apply_changes(s, log)
