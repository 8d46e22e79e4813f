"""Point reads, pages, predicates, result shapes and mutations."""

from pyspark.sql import functions as F

from ..functions import vector
from ..functions.text import iso
from ..operators import ingest as I
from ..operators import lifecycle as L
from ..operators import scans as S
from ..sources import jsonl
from ..sources import views as V
from ..sources.scratch import Scratch
from .ctes import LNK, ENT, MEM, MET, SES, VER, iso as siso
from .registry import query

BRIEF = ["id", "organization_id", "user_id", "memory_type", "memory_state", "title", "importance"]
COLS = ", ".join(BRIEF)


@query(f"WITH {MEM} SELECT {COLS}, content FROM mem WHERE organization_id = 'en' AND id = 34")
def point_lookup(spark, sf):
    return S.scoped(V.memories(spark, sf), "en").where("id = 34").select(*BRIEF, "content")


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'en' ORDER BY id LIMIT 100 OFFSET 100")
def tenant_page(spark, sf):
    return S.page(S.scoped(V.memories(spark, sf), "en"), F.col("id"), offset=100, limit=100).select(*BRIEF)


@query(f"WITH {MEM} SELECT count(*) > 0 AS found FROM mem WHERE organization_id = 'de' AND id = 109")
def exists_lookup(spark, sf):
    return S.scoped(V.memories(spark, sf), "de").where("id = 109").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'en' AND user_id = 7 ORDER BY id LIMIT 100")
def memories_by_user(spark, sf):
    return S.page(S.scoped(V.memories(spark, sf), "en").where("user_id = 7"), F.col("id")).select(*BRIEF)


@query(f"WITH {ENT} SELECT id, kind, name FROM ent WHERE user_id = 7 ORDER BY id LIMIT 100")
def entities_by_user(spark, sf):
    return S.page(V.entities(spark, sf).where("user_id = 7"), F.col("id")).select("id", "kind", "name")


@query(f"WITH {SES} SELECT id, {siso('started_at')} AS started_at FROM ses WHERE user_id = 7 ORDER BY ses.started_at DESC, id LIMIT 100")
def sessions_by_user(spark, sf):
    return S.page(V.sessions(spark, sf).where("user_id = 7"), F.desc("started_at"), F.col("id")).select("id", iso(F.col("started_at")).alias("started_at"))


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'en' AND user_id < 10 AND memory_type = 'goal'")
def memories_by_type(spark, sf):
    return S.scoped(V.memories(spark, sf), "en").where("user_id < 10 AND memory_type = 'goal'").select(*BRIEF)


@query(f"WITH {ENT} SELECT id, kind, name FROM ent WHERE user_id < 10 AND kind = 'supplier'")
def entities_by_type(spark, sf):
    return V.entities(spark, sf).where("user_id < 10 AND kind = 'supplier'").select("id", "kind", "name")


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'fr' AND memory_state = 'warm'")
def memories_by_state(spark, sf):
    return S.scoped(V.memories(spark, sf), "fr").where("memory_state = 'warm'").select(*BRIEF)


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'en' AND memory_state = 'active' AND NOT is_pinned ORDER BY id LIMIT 500")
def unpinned_by_state(spark, sf):
    return S.page(S.scoped(V.memories(spark, sf), "en").where("memory_state = 'active' AND NOT is_pinned"), F.col("id"), limit=500).select(*BRIEF)


@query(f"WITH {MEM} SELECT {COLS}, session_id FROM mem WHERE session_id = 5")
def memories_by_session(spark, sf):
    return V.memories(spark, sf).where("session_id = 5").select(*BRIEF, "session_id")


@query(f"WITH {MEM} SELECT {COLS} FROM mem WHERE organization_id = 'en' AND valid_to IS NULL")
def current_truths(spark, sf):
    return S.scoped(V.memories(spark, sf), "en").where("valid_to IS NULL").select(*BRIEF)


@query(f"WITH {ENT} SELECT id, kind, name FROM ent WHERE name = 'Customer#000000042'")
def entity_by_name(spark, sf):
    """At most one row; a second one would be an error."""
    return S.only_one(V.entities(spark, sf).where("name = 'Customer#000000042'").select("id", "kind", "name"), "entity of that name")


AUDIT = f"id, actor_id, event_type, target_id, {siso('recorded_at')} AS recorded_at"


def audit(df, limit=100):
    return S.page(df, F.desc("recorded_at"), F.col("id"), limit=limit).select("id", "actor_id", "event_type", "target_id", iso(F.col("recorded_at")).alias("recorded_at"))


@query(f"WITH {MET} SELECT {AUDIT} FROM met WHERE actor_id = 42 ORDER BY met.recorded_at DESC, id LIMIT 100")
def audit_by_actor(spark, sf):
    return audit(V.meter_events(spark, sf).where("actor_id = 42"))


@query(f"WITH {MET} SELECT {AUDIT} FROM met WHERE target_id = 3 ORDER BY met.recorded_at DESC, id LIMIT 100")
def audit_by_target(spark, sf):
    return audit(V.meter_events(spark, sf).where("target_id = 3"))


@query(f"WITH {MET} SELECT {AUDIT} FROM met WHERE event_type = 'error' ORDER BY met.recorded_at DESC, id LIMIT 100")
def audit_by_operation(spark, sf):
    return audit(V.meter_events(spark, sf).where("event_type = 'error'"))


@query(f"WITH {MET} SELECT {AUDIT} FROM met WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def audit_range(spark, sf):
    """Both ends belong to the range."""
    rows = V.meter_events(spark, sf).where(F.col("recorded_at").between(V.at("2024-01-05 00:00:00"), V.at("2024-01-06 00:00:00")))
    return rows.select("id", "actor_id", "event_type", "target_id", iso(F.col("recorded_at")).alias("recorded_at"))


@query(f"WITH {SES} SELECT id, user_id, turns FROM ses WHERE ended_at IS NULL")
def active_sessions(spark, sf):
    return V.sessions(spark, sf).where("ended_at IS NULL").select("id", "user_id", "turns")


@query("SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email FROM customer WHERE lower(replace(c_name, '#', '.')) || '@example.com' = 'customer.000000042@example.com' OR c_custkey = 7")
def account_lookup(spark, sf):
    """By e-mail address or by id."""
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    rows = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), mail.alias("email"))
    return rows.where("email = 'customer.000000042@example.com' OR id = 7")


KEYS = """keys AS (SELECT c_custkey AS id, 'mk_live_' || c_name AS token, CASE WHEN c_custkey % 9 = 0 THEN 1 END AS revoked FROM customer),
hashed AS (SELECT id, sha256(token) AS token_hash, left(token, 16) AS prefix, revoked FROM keys)"""


def api_keys(spark, sf):
    token = F.concat(F.lit("mk_live_"), "c_name")
    return V.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.sha2(token, 256).alias("token_hash"), F.left(token, F.lit(16)).alias("prefix"), F.when(F.col("c_custkey") % 9 == 0, 1).alias("revoked"))


@query(f"WITH {KEYS} SELECT id, token_hash, prefix FROM hashed WHERE token_hash = sha256('mk_live_Customer#000000005') AND revoked IS NULL")
def api_key_lookup(spark, sf):
    rows = api_keys(spark, sf).where((F.col("token_hash") == F.sha2(F.lit("mk_live_Customer#000000005"), 256)) & F.col("revoked").isNull())
    return rows.select("id", "token_hash", "prefix")


@query(f"WITH {KEYS} SELECT id, token_hash, prefix FROM hashed WHERE revoked IS NULL")
def api_keys_active(spark, sf):
    return api_keys(spark, sf).where("revoked IS NULL").select("id", "token_hash", "prefix")


def listed(df, user=None, kind=None, state=None, pinned=None, archived=None):
    """The optional predicates of the list endpoint."""
    eq = lambda c, v: None if v is None else F.col(c) == v
    return df.where(S.every(eq("user_id", user), eq("memory_type", kind), eq("memory_state", state), eq("is_pinned", pinned), eq("is_archived", archived)))


@query(f"WITH {MEM} SELECT {COLS}, is_pinned, is_archived, {siso('created_at')} AS created_at FROM mem WHERE memory_state = 'active' AND NOT is_archived ORDER BY mem.created_at DESC, id LIMIT 50 OFFSET 10")
def memory_list(spark, sf):
    rows = S.page(listed(V.memories(spark, sf), state="active", archived=False), F.desc("created_at"), F.col("id"), offset=10, limit=50)
    return rows.select(*BRIEF, "is_pinned", "is_archived", iso(F.col("created_at")).alias("created_at"))


@query(f"WITH {MEM} SELECT id, memory_type AS type, title, content, importance, memory_state AS state, tags[1] AS first_tag, {siso('created_at')} AS created_at, {siso('valid_to')} AS valid_to FROM mem WHERE organization_id = 'es'")
def memory_detail(spark, sf):
    """The detail shape: renamed, times as text."""
    m = S.scoped(V.memories(spark, sf), "es")
    return m.select("id", F.col("memory_type").alias("type"), "title", "content", "importance", F.col("memory_state").alias("state"), F.col("tags")[0].alias("first_tag"), iso(F.col("created_at")).alias("created_at"), iso(F.col("valid_to")).alias("valid_to"))


@query(f"""WITH {MEM}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS n FROM mem)
SELECT user_id, id, CASE WHEN is_archived THEN 'archived' WHEN valid_to IS NOT NULL THEN 'superseded' ELSE 'created' END AS event_type,
  {siso('created_at')} AS timestamp, title, memory_type, memory_state FROM t WHERE n <= 50""")
def memory_timeline(spark, sf):
    """The last fifty events of each user."""
    kind = F.when(F.col("is_archived"), "archived").when(F.col("valid_to").isNotNull(), "superseded").otherwise("created")
    w = S.Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    m = V.memories(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 50")
    return m.select("user_id", "id", kind.alias("event_type"), iso(F.col("created_at")).alias("timestamp"), "title", "memory_type", "memory_state")


@query(f"""WITH {VER} SELECT m.id, m.title, count(v.memory_id) AS n_versions,
  coalesce(string_agg(v.version || ':' || {siso('v.valid_from')}, ',' ORDER BY v.valid_from DESC), '') AS versions
FROM mem m LEFT JOIN ver v ON v.memory_id = m.id AND v.organization_id = m.organization_id GROUP BY m.id, m.title""")
def memory_explain(spark, sf):
    """A memory with its versions, newest first."""
    v = V.versions(spark, sf).groupBy("memory_id", "organization_id").agg(F.sort_array(F.collect_list(F.struct("valid_from", "version")), asc=False).alias("vs"))
    m = V.memories(spark, sf)
    out = m.join(v, (m.id == v.memory_id) & (m.organization_id == v.organization_id), "left")
    text = F.array_join(F.transform("vs", lambda x: F.concat_ws(":", x["version"].cast("string"), iso(x["valid_from"]))), ",")
    return out.select("id", "title", F.coalesce(F.size("vs"), F.lit(0)).cast("long").alias("n_versions"), F.coalesce(text, F.lit("")).alias("versions"))


@query(f"WITH {VER} SELECT memory_id, version, content, round(importance, 6) AS importance FROM ver QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY valid_from DESC) = 1")
def version_latest(spark, sf):
    out = S.latest(V.versions(spark, sf), "memory_id", F.desc("valid_from"))
    return out.select("memory_id", "version", "content", F.round("importance", 6).alias("importance"))


@query("SELECT conv_id AS id, turn, role, text AS content FROM conversations WHERE conv_id = 3")
def observation_get(spark, sf):
    return V.load(spark, sf, "conversations").where("conv_id = 3").select(F.col("conv_id").alias("id"), "turn", "role", F.col("text").alias("content"))


@query(f"WITH {SES} SELECT id, user_id, {siso('started_at')} AS started_at, {siso("coalesce(ended_at, TIMESTAMP '0001-01-01')")} AS ended_at FROM ses WHERE user_id % 10 = 3 ORDER BY ses.started_at DESC, id LIMIT 100")
def observation_sessions(spark, sf):
    """Open sessions end at the zero time."""
    rows = S.page(V.sessions(spark, sf).where("user_id % 10 = 3"), F.desc("started_at"), F.col("id"))
    return rows.select("id", "user_id", iso(F.col("started_at")).alias("started_at"), iso(F.coalesce("ended_at", V.at("0001-01-01 00:00:00"))).alias("ended_at"))


NEW = "new AS (SELECT id + 900 AS id, organization_id, user_id, title FROM mem)"


@query(f"WITH {MEM}, {NEW} SELECT id, organization_id, user_id, title FROM new WHERE id NOT IN (SELECT id FROM mem)")
def upsert_ignore(spark, sf):
    """Rows to append when a key that is there already is left as it is."""
    base = V.memories(spark, sf).select("id", "organization_id", "user_id", "title")
    return S.insert_new(base, base.withColumn("id", F.col("id") + 900))


@query(f"""WITH {MEM} SELECT id, CASE WHEN id % 10 = 1 THEN 'cold' ELSE memory_state END AS memory_state, CASE WHEN id % 15 = 1 THEN true ELSE is_pinned END AS is_pinned
FROM mem WHERE id % 7 <> 3""")
def update_delete(spark, sf):
    """The table after a log of updates and deletes."""
    base = V.memories(spark, sf).select("id", "memory_state", "is_pinned")
    i = F.col("id")
    log = base.select("id", F.explode(F.array(*[
        F.when(i % 10 == 1, F.struct(F.lit(1).alias("seq"), F.lit("update").alias("op"), F.lit("warm").alias("memory_state"), F.lit(None).cast("boolean").alias("is_pinned"))),
        F.when(i % 10 == 1, F.struct(F.lit(2).alias("seq"), F.lit("update").alias("op"), F.lit("cold").alias("memory_state"), F.lit(None).cast("boolean").alias("is_pinned"))),
        F.when(i % 15 == 1, F.struct(F.lit(3).alias("seq"), F.lit("update").alias("op"), F.lit(None).cast("string").alias("memory_state"), F.lit(True).alias("is_pinned"))),
        F.when(i % 7 == 3, F.struct(F.lit(4).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("memory_state"), F.lit(None).cast("boolean").alias("is_pinned"))),
    ])).alias("c")).where("c IS NOT NULL").select("id", "c.*")
    return S.apply_changes(base, log)


SCOPES = "['read', 'write', 'readonly', 'admin'][c_custkey % 4 + 1]"


@query(f"SELECT c_custkey AS id, {SCOPES} IN ('read', 'admin') AS may_read, c_custkey % 6 = c_custkey % 3 AS own_tenant FROM customer")
def scope_check(spark, sf):
    """Keys that may read (a scope that only holds the letters does not count), and requests within their tenant."""
    i = F.col("c_custkey")
    k = V.load(spark, sf, "customer").withColumn("scopes", F.array(V.pick(["read", "write", "readonly", "admin"], i % 4)))
    return k.select(i.alias("id"), S.has_scope(F.col("scopes"), "read").alias("may_read"), S.same_tenant(i % 6, i % 3).alias("own_tenant"))


@query(f"WITH {MEM} SELECT id, memory_type, sha256(regexp_replace(title || chr(10) || content, '^\\s+|\\s+$', '', 'g')) AS digest FROM mem")
def embedding_text(spark, sf):
    """What would be embedded of each memory."""
    m = V.memories(spark, sf)
    return m.select("id", "memory_type", F.sha2(vector.embedding_text(F.col("title"), F.col("content")), 256).alias("digest"))


@query(f"WITH {MEM} SELECT id + 100000 AS id, memory_type, 'active' AS memory_state, false AS is_pinned, importance, '2025-06-01T00:00:00' AS valid_from FROM mem WHERE length(title) > 0")
def persist_memories(spark, sf):
    """Scored memories as new rows of the memory table, all of them valid or none written."""
    m = V.memories(spark, sf).where(F.length("title") > 0).select((F.col("id") + 100000).alias("id"), "organization_id", "user_id", "memory_type", "source_type", "title", "content", "importance")
    valid = I.valid_memory(F.col("memory_type"), F.col("source_type"), F.col("title"))
    rows = I.persisted(I.create_many(m, F.when(valid, F.array()).otherwise(F.array(F.lit("invalid")))), V.at(V.DOCS_NOW))
    return rows.select("id", "memory_type", "memory_state", "is_pinned", "importance", iso(F.col("valid_from")).alias("valid_from"))


@query(f"""WITH {MEM}, {LNK} SELECT 'memory' AS row_of, id + 100000 AS id, memory_type AS detail FROM mem WHERE length(title) > 0
UNION ALL SELECT DISTINCT 'edge', id + 100000, entity_id || ' mentions ' || organization_id FROM mem JOIN lnk ON memory_id = id WHERE length(title) > 0""")
def persist_with_edges(spark, sf):
    """Scored memories and the edges that come with them, each to a table of its own."""
    edge = F.struct(F.col("entity_id").alias("source"), F.col("organization_id").alias("target"), F.lit("mentions").alias("relationship"), "organization_id")
    m = V.memories(spark, sf).where(F.length("title") > 0)
    found = m.join(V.links(spark, sf).distinct(), F.col("id") == F.col("memory_id")).groupBy("id").agg(F.collect_list(edge).alias("edges"))
    m = m.join(found, "id", "left").select((F.col("id") + 100000).alias("id"), "organization_id", "user_id", "memory_type", "source_type", "title", "content", "importance", "edges")
    rows, edges = I.with_edges(m, "edges", V.at(V.DOCS_NOW))
    out = rows.select(F.lit("memory").alias("row_of"), "id", F.col("memory_type").alias("detail"))
    return out.unionByName(edges.select(F.lit("edge").alias("row_of"), F.col("memory_id").alias("id"), F.concat_ws(" ", "source", "relationship", "target").alias("detail")))


@query("""SELECT CAST(conv_id % 50 AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_messages, sha256(string_agg(role || chr(9) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def observation_export(spark, sf):
    """Conversations as observations, exported as JSON lines and read back."""
    path, c = f"{Scratch(spark, 'export').root}/lines", V.load(spark, sf, "conversations")
    said = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    o = c.groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    jsonl.export(o.select((F.col("conv_id") % 50).cast("string").alias("user_id"), F.lit("1").alias("organization_id"), F.col("conv_id").cast("string").alias("session_id"), "messages"), path)
    back, _ = jsonl.read_observations(spark, path)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\t"), m["content"])), "\n")
    return back.select("user_id", "session_id", F.size("messages").cast("long").alias("n_messages"), F.sha2(lines, 256).alias("digest"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 6 = 1 THEN 'again' ELSE event_type END AS event_type FROM events WHERE event_id % 3 > 0""")
def buffer_replay(spark, sf):
    """What was not delivered goes to the dead letters, some of it twice; replayed, each event comes once, as it was last."""
    path = f"{Scratch(spark, 'buffer').root}/dead"
    e = V.load(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    jsonl.flush(e, e.where("id % 3 = 0"), path)
    jsonl.flush(e.where("id % 6 = 1").withColumn("event_type", F.lit("again")), e.limit(0), path, size=1 << 16)
    return jsonl.replay(spark, path, e.schema)


@query(f"WITH {SES}, r AS (SELECT DISTINCT conv_id * 3 AS id FROM conversations) SELECT r.id, id % 50 AS user_id, '2025-06-01T00:00:00' AS started_at FROM r WHERE id NOT IN (SELECT id FROM ses)")
def session_create(spark, sf):
    """Sessions that requests open; those that are there already stay as they are."""
    asked = V.load(spark, sf, "conversations").select((F.col("conv_id") * 3).alias("id"), (F.col("conv_id") * 3 % 50).alias("user_id"))
    new = L.created_sessions(asked, V.sessions(spark, sf), V.at(V.DOCS_NOW))
    return new.select("id", "user_id", iso(F.col("started_at")).alias("started_at"))


@query(f"""WITH {MEM} SELECT 'memory:' || op AS event_type, count(*) AS n FROM (SELECT ['pin', 'unpin', 'archive', 'restore', 'delete', 'read', 'touch'][id % 7 + 1] AS op FROM mem) WHERE op NOT IN ('read', 'touch') GROUP BY op
UNION ALL SELECT CASE WHEN n = 1 THEN 'observation:created' ELSE 'observation:batch' END, count(*) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY ALL""")
def meter_event_kinds(spark, sf):
    """What metering counts a log of operations under; reads are not metered."""
    m = V.memories(spark, sf).select(V.pick(["pin", "unpin", "archive", "restore", "delete", "read", "touch"], F.col("id") % 7).alias("op"))
    o = V.load(spark, sf, "conversations").groupBy("conv_id").count().select(F.when(F.col("count") == 1, "created").otherwise("batch").alias("op"))
    both = I.metered(m, "memory").unionByName(I.metered(o, "observation"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
