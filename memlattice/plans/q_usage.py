"""Sessions, feedback, metering and dashboards."""

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.text import iso
from ..operators import usage as U
from ..operators.scans import page
from ..sources import views as V
from .ctes import MEM, MET, SES, iso as siso
from .registry import query

DAY = "2024-01-10"


@query(f"WITH {MET} SELECT tenant_id, actor_id, event_type, strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS n_events FROM met WHERE recorded_at >= TIMESTAMP '{DAY}' AND recorded_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY GROUP BY ALL")
def usage_daily_rollup(spark, sf):
    """One day's rollup, as the five-minute job makes it."""
    return U.daily(V.meter_events(spark, sf), "tenant_id", "actor_id", "event_type", day=DAY).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {MET} SELECT tenant_id, actor_id, event_type, strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS n_events FROM met GROUP BY ALL")
def usage_full_rollup(spark, sf):
    return U.daily(V.meter_events(spark, sf), "tenant_id", "actor_id", "event_type").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {MET} SELECT tenant_id, event_type, strftime(recorded_at, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE id % 2 = 0 OR recorded_at >= TIMESTAMP '{DAY}' AND recorded_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY) AS n_events FROM met GROUP BY ALL HAVING n_events > 0""")
def usage_daily_upsert(spark, sf):
    """An old rollup of half the events, with one day counted anew over all of them."""
    m = V.meter_events(spark, sf)
    out = U.rerolled(U.daily(m.where("id % 2 = 0"), "tenant_id", "event_type"), m, "tenant_id", "event_type", day=DAY)
    return out.withColumn("day", F.col("day").cast("string"))


@query(f"WITH {MET}, t AS (SELECT count(*) AS total FROM met WHERE tenant_id = 3) SELECT id, event_type, round(units, 6) AS units, total FROM met, t WHERE tenant_id = 3 ORDER BY recorded_at DESC, id LIMIT 50 OFFSET 50")
def usage_event_page(spark, sf):
    """A page, and how many rows all pages have."""
    m = V.meter_events(spark, sf).where("tenant_id = 3")
    rows = page(m, F.desc("recorded_at"), F.col("id"), offset=50, limit=50)
    return rows.select("id", "event_type", F.round("units", 6).alias("units"), m.agg(F.count(F.lit(1))).scalar().alias("total"))


PERIODS = f"""{MET}, per AS (SELECT tenant_id, CAST(day(recorded_at) AS BIGINT) // 10 AS period, sum(units) AS used, count(*) AS requests, tenant_id % 4 <> 1 AS open FROM met GROUP BY ALL),
org AS (SELECT CAST(n_nationkey AS BIGINT) AS tenant_id FROM nation)"""


def tenants(spark, sf):
    """Nations stand for the tenants, more than have events."""
    return V.load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tenant_id"))


def periods(spark, sf):
    m = V.meter_events(spark, sf)
    return m.groupBy("tenant_id", F.floor(F.dayofmonth("recorded_at") / 10).alias("period")).agg(F.sum("units").alias("used"), F.count(F.lit(1)).alias("requests")).withColumn("open", F.col("tenant_id") % 4 != 1)


@query(f"""WITH {PERIODS}, l AS (SELECT * FROM per WHERE open QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY period DESC) = 1)
SELECT o.tenant_id, coalesce(period, 0) AS period, round(coalesce(used, 0.0), 4) AS used, coalesce(requests, 0) AS requests FROM org o LEFT JOIN l USING (tenant_id)""")
def usage_period_latest(spark, sf):
    """The latest open period of each tenant; zeros where there is none."""
    p = periods(spark, sf).where("open")
    last = p.groupBy("tenant_id").agg(*[F.max_by(c, "period").alias(c) for c in ("used", "requests")], F.max("period").alias("period"))
    z = lambda c, v: F.coalesce(c, F.lit(v))
    return tenants(spark, sf).join(last, "tenant_id", "left").select("tenant_id", z("period", 0).cast("long").alias("period"), F.round(z("used", 0.0), 4).alias("used"), z("requests", 0).cast("long").alias("requests"))


@query(f"""WITH {PERIODS} SELECT CAST(tenant_id AS BIGINT) AS tenant_id, period, status FROM (
  SELECT tenant_id, period, CASE WHEN open AND tenant_id % 3 = 0 AND period = 2 THEN 'closed' WHEN open THEN 'open' ELSE 'closed' END AS status FROM per
  UNION ALL SELECT tenant_id, 9, 'open' FROM org WHERE tenant_id % 3 = 0)""")
def webhook_period_upsert(spark, sf):
    """A renewal closes the period in hand and opens a new one for the tenant its customer id stands for."""
    p = periods(spark, sf).select("tenant_id", F.col("period").cast("long").alias("period"), F.when(F.col("open"), "open").otherwise("closed").alias("status"))
    orgs = tenants(spark, sf).withColumn("customer", F.concat(F.lit("cus_"), "tenant_id"))
    hooks = orgs.where("tenant_id % 3 = 0").select("customer")
    hit = orgs.join(hooks, "customer").select("tenant_id")
    closed = p.where("period = 2").join(hit, "tenant_id").select("tenant_id", "period", F.lit("closed").alias("status"))
    opened = hit.select("tenant_id", F.lit(9).cast("long").alias("period"), F.lit("open").alias("status"))
    return U.upsert(p, closed.unionByName(opened), ["tenant_id", "period"])


IDEMPOTENT = f"""WITH RECURSIVE {MET}, k AS (SELECT id, actor_id, event_type, recorded_at FROM met),
walk AS (SELECT actor_id, event_type, min(recorded_at) AS t FROM k GROUP BY ALL
  UNION ALL SELECT actor_id, event_type, t FROM (SELECT w.actor_id, w.event_type, min(k.recorded_at) AS t FROM walk w JOIN k ON k.actor_id = w.actor_id AND k.event_type = w.event_type AND k.recorded_at >= w.t + INTERVAL 24 HOUR GROUP BY ALL))
SELECT min(k.id) AS id, k.actor_id, k.event_type FROM k JOIN walk w ON k.actor_id = w.actor_id AND k.event_type = w.event_type AND k.recorded_at = w.t GROUP BY k.actor_id, k.event_type, k.recorded_at"""


@query(IDEMPOTENT)
def idempotent_ingest(spark, sf):
    """The events that a key of (actor, type) lets through when it lives for a day."""
    m = V.meter_events(spark, sf)
    return U.first_within(m, ["actor_id", "event_type"], "recorded_at", 24, "id").select("id", "actor_id", "event_type")


BUCKET = """WITH RECURSIVE m AS (SELECT event_id AS id, user_id AS actor_id, date_diff('second', TIMESTAMP '2024-01-01', ts) // 36000 AS s FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY s, id) AS n FROM m),
f AS (SELECT actor_id, n, id, true AS allowed, s AS since, CAST(3 AS BIGINT) AS tokens FROM o WHERE n = 1
  UNION ALL SELECT o.actor_id, o.n, o.id, least(4, f.tokens + (o.s - f.since) * 2) >= 1,
    CASE WHEN least(4, f.tokens + (o.s - f.since) * 2) >= 1 THEN o.s ELSE f.since END,
    CASE WHEN least(4, f.tokens + (o.s - f.since) * 2) >= 1 THEN least(4, f.tokens + (o.s - f.since) * 2) - 1 ELSE f.tokens END
  FROM f JOIN o ON o.actor_id = f.actor_id AND o.n = f.n + 1)
SELECT id, actor_id, allowed FROM f"""


@query(BUCKET)
def rate_limit_bucket(spark, sf):
    """Requests of each actor, ten hours as one second, against the smallest plan of two a second with a burst of four."""
    m = V.meter_events(spark, sf)
    quick = F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", V.at("2024-01-01 00:00:00"), F.col("recorded_at")) / 36000).cast("int"), V.at("2024-01-01 00:00:00"))
    return U.rate_limited(m.withColumn("at", quick), "actor_id", "at", "id", 2, 4).select("id", "actor_id", "allowed")


@query("SELECT t AS tier, CAST(r AS INTEGER) AS rate, CAST(b AS INTEGER) AS burst, count(*) AS n FROM (SELECT *, ['Hobby', 'solo_pro', 'TEAM', 'scale', 'other'][c_custkey % 5 + 1] AS t FROM customer) JOIN (VALUES ('hobby', 10, 20), ('solo_pro', 50, 100), ('team', 250, 500), ('scale', 1000, 2000), ('other', 10, 20)) v(n, r, b) ON n = lower(t) GROUP BY ALL")
def rate_tiers(spark, sf):
    c = V.load(spark, sf, "customer").withColumn("tier", V.pick(["Hobby", "solo_pro", "TEAM", "scale", "other"], F.col("c_custkey") % 5))
    return c.groupBy("tier", U.tier_limits(F.col("tier")).alias("l")).agg(F.count(F.lit(1)).alias("n")).select("tier", "l.rate", "l.burst", "n")


@query(f"WITH {MET} SELECT tenant_id, event_type AS classification, strftime(recorded_at, '%Y-%m-%d') AS day, round(sum(units), 4) AS units, count(*) AS requests, CAST(sum(target_id) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(units * 0.002), 4) AS cost FROM met GROUP BY ALL")
def usage_daily_sums(spark, sf):
    m = V.meter_events(spark, sf)
    return m.groupBy("tenant_id", F.col("event_type").alias("classification"), F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("units"), 4).alias("units"), F.count(F.lit(1)).alias("requests"), F.sum("target_id").alias("tokens"), F.sum("bytes").alias("bytes"), F.round(F.sum(F.col("units") * 0.002), 4).alias("cost"))


@query(f"WITH {MET} SELECT tenant_id, count(*) AS used, round(count(*) / 2500.0 * 100, 6) AS percent FROM met GROUP BY tenant_id")
def usage_percent(spark, sf):
    m = V.meter_events(spark, sf).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("used"))
    return m.withColumn("percent", F.round(U.percent(F.col("used"), F.lit(2500.0)), 6))


@query(f"WITH {MET} SELECT event_type || ':' || (200 + 100 * (target_id % 4)) AS counter, count(*) AS n FROM met GROUP BY ALL")
def telemetry_counts(spark, sf):
    return V.meter_events(spark, sf).groupBy(F.concat_ws(":", "event_type", (200 + F.col("target_id") % 4 * 100).cast("string")).alias("counter")).agg(F.count(F.lit(1)).alias("n"))


FB = f"""{MET}, fb AS (SELECT target_id AS memory_id, CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'click' THEN 'used' WHEN 'purchase' THEN 'used' WHEN 'error' THEN 'ignored' END AS signal FROM met),
n AS (SELECT memory_id, count(*) FILTER (WHERE signal = 'retrieved') AS retrieved, count(*) FILTER (WHERE signal = 'used') AS used, count(*) FILTER (WHERE signal = 'ignored') AS ignored FROM fb GROUP BY memory_id)"""


def feedback(spark, sf):
    signal = text.choose(F.col("event_type"), {"view": "retrieved", "click": "used", "purchase": "used", "error": "ignored"})
    m = V.meter_events(spark, sf).select(F.col("target_id").alias("memory_id"), signal.alias("signal"))
    return m.groupBy("memory_id").agg(*[F.count_if(F.col("signal") == s).alias(s) for s in ("retrieved", "used", "ignored")])


@query(f"WITH {FB} SELECT memory_id, retrieved, used, ignored FROM n")
def feedback_counts(spark, sf):
    return feedback(spark, sf)


@query(f"WITH {FB} SELECT memory_id, round(CASE WHEN retrieved > 0 THEN least(greatest(used, 0) / retrieved, 1.0) ELSE 0.0 END, 6) AS utility FROM n")
def utility_score(spark, sf):
    return feedback(spark, sf).select("memory_id", F.round(scoring.utility(F.col("used"), F.col("retrieved")), 6).alias("utility"))


@query(f"""WITH {FB}, s AS (SELECT *, (memory_id % 20) / 20.0 AS score, CASE WHEN memory_id % 3 = 0 THEN 0 ELSE used END AS u FROM n)
SELECT memory_id, CAST(round(CASE WHEN ignored >= 10 AND u = 0 THEN greatest(0.0, score - 0.1) WHEN retrieved >= 10 AND least(u / retrieved, 1.0) > 0.8 THEN least(1.0, score + 0.05) ELSE score END, 6) AS DOUBLE) AS adjusted FROM s""")
def feedback_adjust(spark, sf):
    n = feedback(spark, sf).withColumn("score", F.col("memory_id") % 20 / 20.0).withColumn("u", F.when(F.col("memory_id") % 3 == 0, 0).otherwise(F.col("used")))
    return n.select("memory_id", F.round(scoring.feedback_adjust(F.col("score"), F.col("retrieved"), F.col("u"), F.col("ignored")), 6).alias("adjusted"))


@query(f"WITH {SES}, {MEM} SELECT s.id, s.user_id, count(m.id) AS n_memories, coalesce(string_agg(m.id, ',' ORDER BY m.id), '') AS memory_ids FROM ses s LEFT JOIN mem m ON m.session_id = s.id GROUP BY s.id, s.user_id")
def session_inspect(spark, sf):
    """Sessions with what was remembered in them; 0 for those with nothing."""
    m = V.memories(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    s = V.sessions(spark, sf)
    out = s.join(m, s.id == m.session_id, "left")
    return out.select("id", "user_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_memories"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("memory_ids"))


@query(f"WITH {SES}, {MEM} SELECT s.id, {siso('s.started_at')} AS started_at, count(m.id) AS n_memories, {siso('min(m.created_at)')} AS first_memory, {siso('max(m.created_at)')} AS newest_memory FROM ses s LEFT JOIN mem m ON m.session_id = s.id GROUP BY s.id, s.started_at")
def session_detail(spark, sf):
    m = V.memories(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    s = V.sessions(spark, sf)
    return s.join(m, s.id == m.session_id, "left").select("id", iso(F.col("started_at")).alias("started_at"), F.coalesce("n", F.lit(0)).cast("long").alias("n_memories"), iso(F.col("first")).alias("first_memory"), iso(F.col("last")).alias("newest_memory"))


@query("SELECT conv_id AS session_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def session_messages(spark, sf):
    """A conversation's messages in order."""
    c = V.load(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("m"))
    g = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    return g.select("session_id", "n", F.array_join(F.col("ms.m"), ",").alias("messages"))


@query(f"WITH {MEM} SELECT organization_id, count(*) AS total, count(*) FILTER (WHERE memory_state = 'active') AS active, count(DISTINCT memory_type) AS n_types, round(avg(importance), 6) AS avg_importance FROM mem GROUP BY organization_id")
def dashboard_stats(spark, sf):
    return V.memories(spark, sf).groupBy("organization_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("memory_state") == "active").alias("active"), F.count_distinct("memory_type").alias("n_types"), F.round(F.avg("importance"), 6).alias("avg_importance"))
