"""Duplicates, entity resolution, contradictions, merged values."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import iso
from ..operators import matching as M
from ..sources import views as V
from ..sources.scratch import Scratch
from .ctes import GOA, LNK, MEM, similarities, strip, iso as siso
from .registry import query


@query(f"WITH {MEM} SELECT id, sha256({strip(strip('title') + ' || chr(10) || ' + strip('content'))}) AS digest FROM mem")
def comparison_text(spark, sf):
    return V.memories(spark, sf).select("id", F.sha2(text.comparison_text(F.col("title"), F.col("content")), 256).alias("digest"))


BLOCK = ["organization_id", "user_id", "memory_type"]


@query(None)
def dedup_decision(spark, sf):
    """Every memory of a tenant, user and kind is incoming, those with a smaller id are there: discard, merge or store,
    by the most similar of the block."""
    m = V.memories(spark, sf).select("id", *BLOCK, text.comparison_text(F.col("title"), F.col("content")).alias("t"))
    out = M.best_match(m, m, BLOCK, "id", "t", 0.85, earlier=True)
    return out.select("id", "match", F.round("similarity", 6).alias("similarity"), M.dedup_decision(F.col("similarity")).alias("decision"))


@query(None)
def dedup_sequential(spark, sf):
    """A user's memories of a kind in turn, every one against those stored before it."""
    return M.sequential_dedup(V.memories(spark, sf), BLOCK, "id", "content", "title")


PARTS = """prt AS (SELECT p_partkey AS id, p_brand AS kind, p_size % 10 AS owner, lower(p_name) AS name, lower(p_name || ' ' || p_type) AS whole FROM part),
prs AS (SELECT m.id, e.id AS match, m.whole AS a, unnest([e.name, e.whole]) AS b FROM prt m JOIN prt e ON e.kind = m.kind AND e.owner = m.owner AND e.id < m.id),
par AS (SELECT * FROM prs WHERE 2.0 * least(len(a), len(b)) >= 0.5 * (len(a) + len(b)))"""


@query(f"""WITH RECURSIVE {PARTS}, {similarities("par")}, best AS (SELECT id, match, max(ratio) AS similarity FROM par JOIN sim USING (a, b) WHERE ratio >= 0.5 GROUP BY id, match),
top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match) = 1)
SELECT id, match, round(similarity, 6) AS similarity, CASE WHEN similarity > 0.8 THEN 'link' ELSE 'create' END AS decision FROM prt LEFT JOIN top USING (id)""")
def entity_resolution(spark, sf):
    """Every part as a mention against the parts before it as entities of the same owner and kind, by their names or
    names and summaries: linked above 0.8, else created."""
    p = V.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), (F.col("p_size") % 10).alias("owner"), "p_name", "p_type")
    mentions = p.select("id", "kind", "owner", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    entities = p.select("id", "kind", "owner", F.col("p_name").alias("name"), F.col("p_type").alias("summary"))
    out = M.best_match(mentions, entities, ["kind", "owner"], "id", "name", 0.5, summary="summary", earlier=True)
    linked = F.coalesce(F.col("similarity") > 0.8, F.lit(False))
    return out.select("id", "match", F.round("similarity", 6).alias("similarity"), F.when(linked, "link").otherwise("create").alias("decision"))


CURRENT = f"""{MEM}, con AS (SELECT m.id AS new_id, o.id AS old_id, lower(m.title) AS a, lower(o.title) AS b FROM mem m JOIN mem o ON o.organization_id = m.organization_id AND o.user_id = m.user_id AND o.memory_type = m.memory_type AND o.id <> m.id
  WHERE m.valid_to IS NULL AND o.valid_to IS NULL AND {strip("m.content")} <> {strip("o.content")} AND 2.0 * least(len(m.title), len(o.title)) >= 0.8 * (len(m.title) + len(o.title))),
{similarities("con")}, hit AS (SELECT new_id, old_id FROM con JOIN sim USING (a, b) WHERE ratio >= 0.8)"""


def contradicted(spark, sf):
    m = V.memories(spark, sf).where("valid_to IS NULL")
    rows = m.select("id", *BLOCK, "title", "content")
    return m, M.contradictions(rows, rows, BLOCK)


@query(f"WITH RECURSIVE {CURRENT} SELECT new_id, old_id FROM hit")
def truth_contradictions(spark, sf):
    """Pairs of current memories of one tenant, user and kind with like titles and other contents."""
    return contradicted(spark, sf)[1]


@query(f"""WITH RECURSIVE {CURRENT}, {LNK}, n AS (SELECT 'version' AS row_of, old_id AS id, new_id AS by_id, {siso("valid_from")} AS since, sha256(content) AS detail FROM hit JOIN mem ON id = old_id)
SELECT * FROM n UNION ALL SELECT DISTINCT 'closed', old_id, CAST(NULL AS BIGINT), '2025-06-01T00:00:00', CAST(NULL AS VARCHAR) FROM hit
UNION ALL SELECT 'audit', old_id, new_id, '2025-06-01T00:00:00', sha256(o.content) || '/' || sha256(w.content) FROM hit JOIN mem o ON o.id = old_id JOIN mem w ON w.id = new_id
UNION ALL SELECT 'edge', old_id, new_id, '2025-06-01T00:00:00', entity_id FROM hit JOIN (SELECT DISTINCT * FROM lnk) ON memory_id = new_id""")
def truth_maintenance(spark, sf):
    """What detected contradictions write: a version, an audit row with both contents and edges of the new memory's
    entities for each, and the closed memories."""
    m, pairs = contradicted(spark, sf)
    pairs = Scratch(spark, "contradictions").write(pairs, "pairs")
    v, closed, audit, edges = M.superseded(m, pairs, V.links(spark, sf), V.at(V.DOCS_NOW))
    one = lambda df, kind, id_, by, since, detail: df.select(F.lit(kind).alias("row_of"), F.col(id_).alias("id"), by.alias("by_id"), iso(since).alias("since"), detail.alias("detail"))
    digest = lambda c: F.sha2(F.col(c), 256)
    rows = one(v, "version", "memory_id", F.col("superseded_by"), F.col("valid_from"), digest("content"))
    rows = rows.unionByName(one(closed, "closed", "id", F.lit(None).cast("long"), F.col("valid_to"), F.lit(None).cast("string")))
    rows = rows.unionByName(one(audit, "audit", "target_id", F.col("by_id"), F.col("created_at"), F.concat(digest("old_content"), F.lit("/"), digest("new_content"))))
    return rows.unionByName(one(edges, "edge", "old_id", F.col("new_id"), V.at(V.DOCS_NOW), F.col("source")))


@query(f"""WITH {MEM}, par AS (SELECT a.id AS new_id, b.id AS old_id FROM mem a JOIN mem b ON a.id = b.id + 550 AND b.valid_to IS NULL), s AS (SELECT old_id, min(new_id) AS new_id FROM par GROUP BY old_id)
SELECT 'closed' AS row_of, old_id AS id, CAST(NULL AS BIGINT) AS by_id FROM s UNION ALL SELECT 'audit', old_id, new_id FROM s""")
def supersession_rows(spark, sf):
    """The closed memories and audit rows of given pairs."""
    _, closed, audit = M.supersede(*given(spark, sf), V.at(V.DOCS_NOW))
    out = closed.where(F.col("valid_to") == V.at(V.DOCS_NOW)).select(F.lit("closed").alias("row_of"), "id", F.lit(None).cast("long").alias("by_id"))
    return out.unionByName(audit.where("operation = 'supersede'").select(F.lit("audit").alias("row_of"), F.col("target_id").alias("id"), "by_id"))


def given(spark, sf):
    m = V.memories(spark, sf)
    return m, m.select(F.col("id").alias("new_id")).join(m.where("valid_to IS NULL").select(F.col("id").alias("old_id")), F.col("new_id") == F.col("old_id") + 550)


PAIRS = "par AS (SELECT a.id AS new_id, b.id AS old_id FROM mem a JOIN mem b ON a.id = b.id + 550 AND b.valid_to IS NULL)"


@query(f"WITH {MEM}, {PAIRS} SELECT old_id AS memory_id, min(new_id) AS superseded_by, any_value({siso('m.valid_from')}) AS valid_from, '2025-06-01T00:00:00' AS valid_to FROM par JOIN mem m ON m.id = old_id GROUP BY old_id")
def truth_supersession(spark, sf):
    """The versions written when given pairs supersede."""
    v, _, _ = M.supersede(*given(spark, sf), V.at(V.DOCS_NOW))
    return v.select("memory_id", "superseded_by", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"))


TOKEN = "['Python guide', 'Vincent', 'ACME Corp', 'garden', 'fastapi app'][id % 5 + 1]"


@query(f"WITH {MEM}, n AS (SELECT id, memory_type, {TOKEN} AS name FROM mem) SELECT id, name, CASE WHEN regexp_matches(lower(name), 'python|redis|postgres|fastapi') THEN 'technology' WHEN regexp_matches(lower(name), 'inc|llc|corp|company') THEN 'company' ELSE CASE memory_type WHEN 'project' THEN 'project' WHEN 'preference' THEN 'preference' WHEN 'goal' THEN 'goal' WHEN 'skill' THEN 'skill' WHEN 'relationship' THEN 'person' ELSE 'topic' END END AS entity_type FROM n")
def infer_entity_type(spark, sf):
    m = V.memories(spark, sf).withColumn("name", V.pick(["Python guide", "Vincent", "ACME Corp", "garden", "fastapi app"], F.col("id") % 5))
    return m.select("id", "name", M.entity_type(F.col("name"), F.col("memory_type")).alias("entity_type"))


@query(f"""WITH {MEM}, p AS (SELECT b.id, a.content AS new, b.content AS old, a.tags AS t, b.tags AS u FROM mem a JOIN mem b ON a.id = b.id + 500),
s AS (SELECT id, {strip('new')} AS new, {strip('old')} AS old, t, u FROM p)
SELECT id, sha256(CASE WHEN new <> '' AND NOT contains(old, new) THEN {strip("old || chr(10) || chr(10) || new")} ELSE old END) AS digest,
  array_to_string(u || list_filter(t, lambda x: NOT list_contains(u, x)), ',') AS tags, CASE WHEN id % 2 = 0 THEN 'a=1,b=2,c=3' ELSE 'a=1,b=1' END AS data FROM s""")
def merge_values(spark, sf):
    """What a merge leaves: content once, tags in order of appearance, data with the incoming values."""
    m = V.memories(spark, sf)
    a = m.select((F.col("id") - 500).alias("id"), F.col("content").alias("new"), F.col("tags").alias("t"))
    p = m.select("id", F.col("content").alias("old"), F.col("tags").alias("u")).join(a, "id")
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")))
    data = M.merged_data(old, new)
    return p.select("id", F.sha2(M.merged_content(F.col("old"), F.col("new")), 256).alias("digest"), F.array_join(M.merged_tags(F.col("u"), F.col("t")), ",").alias("tags"), F.array_join(F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("data"))


ATTR = "CASE memory_type WHEN 'fact' THEN 'facts' WHEN 'preference' THEN 'preferences' WHEN 'relationship' THEN 'relationships' ELSE 'observations' END"


@query(f"""WITH {GOA}, {LNK}, l AS (SELECT entity_id, {ATTR} AS attribute, memory_state || '/' || memory_type AS content, min(id) AS first FROM lnk JOIN goa ON id = memory_id GROUP BY ALL)
SELECT entity_id, attribute, string_agg(content, ',' ORDER BY first) AS contents FROM l GROUP BY ALL""")
def entity_attributes(spark, sf):
    l, g = V.links(spark, sf), V.goals(spark, sf)
    m = l.join(g, l.memory_id == g.id).withColumn("content", F.concat_ws("/", "memory_state", "memory_type"))
    return M.entity_attributes(m, "entity_id").select("entity_id", "attribute", F.array_join("contents", ",").alias("contents"))


@query(f"""WITH {MEM}, {LNK}, l AS (SELECT DISTINCT entity_id, m.* FROM lnk JOIN mem m ON id = memory_id),
c AS (SELECT entity_id, {ATTR} AS attribute, content, min(id) AS first FROM l GROUP BY ALL),
d AS (SELECT entity_id, id, unnest(['state', 'kind_' || id % 3, source_type]) AS k, unnest([memory_state, memory_type, 'seen']) AS v FROM l WHERE id % 4 > 0),
f AS (SELECT entity_id, k, max_by(v, id) AS v FROM d GROUP BY ALL)
SELECT entity_id, attribute, sha256(string_agg(content, chr(0) ORDER BY first)) AS value FROM c GROUP BY ALL
UNION ALL SELECT entity_id, 'structured_data', string_agg(k || '=' || v, ',' ORDER BY k) FROM f GROUP BY entity_id""")
def entity_state(spark, sf):
    """The contents of an entity's memories by attribute, and their structured data folded in order, the last of each
    field; every fourth memory has none."""
    l, m = V.links(spark, sf).distinct(), V.memories(spark, sf)
    data = F.create_map(F.lit("state"), "memory_state", F.concat(F.lit("kind_"), F.col("id") % 3), "memory_type", "source_type", F.lit("seen"))
    m = l.join(m.withColumn("data", F.when(F.col("id") % 4 > 0, data)), F.col("memory_id") == F.col("id"))
    kinds = M.entity_attributes(m, "entity_id").select("entity_id", "attribute", F.sha2(F.array_join("contents", "\0"), 256).alias("value"))
    folded = M.structured_attributes(m, "entity_id", "data")
    pairs = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return kinds.unionByName(folded.select("entity_id", F.lit("structured_data").alias("attribute"), pairs.alias("value")))


@query(f"""WITH RECURSIVE {MEM}, o AS (SELECT user_id, {strip("content")} AS c, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM mem),
f AS (SELECT user_id, n, left(c, 500) AS s FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, CASE WHEN f.s = '' THEN left(o.c, 500) WHEN o.c <> '' AND NOT contains(f.s, o.c) THEN left(f.s || chr(10) || o.c, 500) ELSE f.s END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, s AS summary FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def entity_summary(spark, sf):
    """A fold in order of id: appended unless contained, cut to 500 characters at each step."""
    return M.entity_summary(V.memories(spark, sf), "user_id")
