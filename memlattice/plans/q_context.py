"""Context sections and budgets, prompts, compression, clusters, dream questions."""

from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import text
from ..operators import context as C
from ..sources import views as V
from .ctes import ENT, GOA, LNK, MEM, case, strip, terms
from .registry import query

CAT = case("memory_type", D.CATEGORY, "'facts'")
SEC = case("memory_type", D.SECTION, "'relevant_memories'")
TOKENS = f"CAST(CASE WHEN {strip('content')} = '' THEN 1 ELSE len(string_split_regex({strip('content')}, '\\s+')) END AS BIGINT)"
OK = "NOT is_archived AND valid_to IS NULL"


@query(f"WITH {MEM} SELECT id, memory_type, {CAT} AS category FROM mem")
def category_map(spark, sf):
    return V.memories(spark, sf).select("id", "memory_type", C.category(F.col("memory_type")).alias("category"))


@query(f"WITH {MEM} SELECT id, {TOKENS} AS words, CAST(octet_length(encode(content)) // 4 AS BIGINT) AS quarter_bytes FROM mem")
def token_estimates(spark, sf):
    return V.memories(spark, sf).select("id", text.word_tokens(F.col("content")).alias("words"), text.byte_tokens(F.col("content")).alias("quarter_bytes"))


@query(f"WITH {MEM} SELECT user_id, {SEC} AS section, count(*) AS n, string_agg(id, ',' ORDER BY importance DESC, id) AS ids FROM mem WHERE {OK} GROUP BY ALL")
def context_sections(spark, sf):
    """Every user's valid memories by section, most important first."""
    return C.sections(C.valid(V.memories(spark, sf)), "user_id").select("user_id", "section", "n", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {MEM}, i AS (SELECT user_id, id, CAST(octet_length(encode(content)) // 4 AS BIGINT) AS tokens, importance FROM mem WHERE {OK}),
u AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS used FROM i WINDOW w AS (PARTITION BY user_id ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING))
SELECT user_id, id, used FROM u WHERE used <= 4000""")
def context_pack_prefix(spark, sf):
    """Stops at the first item that overflows."""
    i = C.valid(V.memories(spark, sf)).select("user_id", "id", "importance", text.byte_tokens(F.col("content")).alias("tokens"))
    return C.pack_prefix(i, 4000, "user_id", F.desc("importance"), F.col("id")).select("user_id", "id", "used")


@query(f"WITH {MEM} SELECT user_id, sum(octet_length(encode(content)) // 4) > 4000 AS truncated FROM mem WHERE {OK} GROUP BY user_id")
def context_truncated(spark, sf):
    """Whether the prefix budget left anything out."""
    i = C.valid(V.memories(spark, sf)).groupBy("user_id").agg(F.sum(text.byte_tokens(F.col("content"))).alias("n"))
    return i.select("user_id", (F.col("n") > 4000).alias("truncated"))


SHARES = {c: round(1000 * w) for c, w in D.BUDGET.items()}
GREEDY = f"""WITH RECURSIVE {MEM}, i AS (SELECT user_id, id, {CAT} AS category, {TOKENS} AS tokens, importance FROM mem WHERE {OK}),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY importance DESC, id) AS n, CASE category {" ".join(f"WHEN '{c}' THEN {v}" for c, v in SHARES.items())} END AS share FROM i),
f AS (SELECT user_id, category, n, id, tokens, importance, tokens <= share AS took, CASE WHEN tokens <= share THEN tokens ELSE 0 END AS used FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.category, o.n, o.id, o.tokens, o.importance, f.used + o.tokens <= o.share, f.used + CASE WHEN f.used + o.tokens <= o.share THEN o.tokens ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.category = f.category AND o.n = f.n + 1),
s AS (SELECT user_id, CAST(sum(tokens) FILTER (WHERE took) AS BIGINT) AS used FROM f GROUP BY user_id),
r AS (SELECT f.user_id, id, tokens, row_number() OVER (PARTITION BY f.user_id ORDER BY importance DESC, id) AS n, 1000 - coalesce(s.used, 0) AS room FROM f JOIN s USING (user_id) WHERE NOT took),
g AS (SELECT user_id, n, id, tokens <= room AS took, room - CASE WHEN tokens <= room THEN tokens ELSE 0 END AS room FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.id, r.tokens <= g.room, g.room - CASE WHEN r.tokens <= g.room THEN r.tokens ELSE 0 END FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1),
a AS (SELECT user_id, id, tokens FROM f WHERE took UNION ALL SELECT g.user_id, g.id, i.tokens FROM g JOIN i USING (id) WHERE took)"""


def packed(spark, sf):
    i = C.valid(V.memories(spark, sf)).select("user_id", "id", C.category(F.col("memory_type")).alias("category"), text.word_tokens(F.col("content")).alias("tokens"), F.col("importance").alias("relevance"))
    return C.pack_greedy(i, "user_id", 1000)


@query(GREEDY + " SELECT u.user_id, coalesce(string_agg(a.id, ',' ORDER BY a.id), '') AS ids, coalesce(CAST(sum(a.tokens) AS BIGINT), 0) AS used FROM (SELECT DISTINCT user_id FROM i) u LEFT JOIN a ON a.user_id = u.user_id GROUP BY u.user_id")
def context_pack_greedy(spark, sf):
    """Skips what overflows, by category, then over all."""
    return packed(spark, sf).select("user_id", F.array_join("ids", ",").alias("ids"), "used")


@query(GREEDY + f" SELECT user_id, {CAT} AS category, CAST(sum(a.tokens) AS BIGINT) AS used FROM a JOIN mem USING (user_id, id) GROUP BY ALL")
def context_token_usage(spark, sf):
    """What each category uses after both passes."""
    ids = packed(spark, sf).select("user_id", F.explode("ids").alias("id"))
    m = V.memories(spark, sf).join(ids, ["user_id", "id"])
    return m.groupBy("user_id", C.category(F.col("memory_type")).alias("category")).agg(F.sum(text.word_tokens(F.col("content"))).alias("used"))


SHARED = ", ".join(f"('{c}', {w}, {k})" for k, (c, w) in enumerate(D.BUDGET.items()))


@query(f"""WITH t AS (SELECT conv_id AS id, sum(length(text)) // 4 AS total FROM conversations GROUP BY conv_id), w(category, weight, k) AS (VALUES {SHARED}),
p AS (SELECT id, total, category, k, CAST(floor(total * weight::DOUBLE / {sum(D.BUDGET.values())}::DOUBLE) AS BIGINT) AS part FROM t, w),
s AS (SELECT *, total - sum(part) OVER (PARTITION BY id) AS rest FROM p)
SELECT id, category, CAST(part + CASE WHEN rest > k THEN 1 ELSE 0 END AS BIGINT) AS budget FROM s""")
def budget_allocation(spark, sf):
    """A budget for each conversation, as many tokens as it has: of what the proportions leave, the first categories get
    one each."""
    c = V.load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg((F.floor(F.sum(F.length("text")) / 4)).alias("total"))
    parts = F.array(*[F.struct(F.lit(k).alias("category"), part.alias("budget")) for k, part in C.shares(F.col("total")).items()])
    return c.select("id", F.inline(parts))


@query(f"""WITH {MEM}, l AS (SELECT user_id, string_agg('- [' || memory_type || '] ' || title || ': ' || content || ' (score: ' || printf('%.3f', importance) || ')', chr(10) ORDER BY importance DESC, id) AS body FROM mem WHERE {OK} AND {SEC} = 'relevant_memories' GROUP BY user_id)
SELECT user_id, '## Relevant Memories' || chr(10) || body AS prompt FROM l""")
def prompt_rendering(spark, sf):
    """The memories section of a system prompt."""
    m = C.valid(V.memories(spark, sf)).where(C.section(F.col("memory_type")) == "relevant_memories")
    line = C.bullet(F.col("memory_type"), F.col("title"), F.col("content"), F.col("importance"))
    g = m.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id", line.alias("line")))).alias("ls"))
    return g.select("user_id", F.concat(F.lit("## Relevant Memories\n"), F.array_join(F.col("ls.line"), "\n")).alias("prompt"))


HEAD = " ".join(f"WHEN '{s}' THEN '{k}'" for k, s in enumerate(C.HEADINGS))


@query(f"""WITH {MEM}, l AS (SELECT user_id, CASE {SEC} {HEAD} END AS place, string_agg(CASE WHEN memory_type = 'goal' THEN printf('- %s [%s] (%.0f%%)', title, memory_state, importance * 100)
  ELSE '- [' || memory_type || '] ' || title || ': ' || content || ' (score: ' || printf('%.3f', importance) || ')' END, chr(10) ORDER BY importance DESC, id) AS body FROM mem WHERE {OK} GROUP BY ALL)
SELECT user_id, string_agg('## ' || ['{"', '".join(C.HEADINGS.values())}'][CAST(place AS INTEGER) + 1] || chr(10) || body, chr(10) || chr(10) ORDER BY place) AS prompt FROM l GROUP BY user_id""")
def prompt_sections(spark, sf):
    """All sections of a system prompt."""
    return C.prompt(C.valid(V.memories(spark, sf)), "user_id")


@query(f"WITH {MEM} SELECT id, printf('- %s [%s] (%d%%)', title, memory_state, CAST(id % 101 AS INTEGER)) AS line FROM mem WHERE memory_type = 'goal'")
def goal_lines(spark, sf):
    m = V.memories(spark, sf).where("memory_type = 'goal'")
    return m.select("id", C.goal_line(F.col("title"), F.col("memory_state"), (F.col("id") % 101).cast("double") / 100).alias("line"))


@query(f"""WITH {MEM}, g AS (SELECT user_id, count(*) AS n, string_agg(content, ' ' ORDER BY id) AS body, list(title ORDER BY id) AS titles FROM mem GROUP BY user_id HAVING count(*) >= 20)
SELECT user_id, left(body, greatest(1, CAST(floor(length(body) * CAST(0.4 AS DOUBLE)) AS INTEGER))) AS summary_text, array_to_string(titles[1:10], '|') AS key_facts, n AS source_memory_count FROM g""")
def compression_summary(spark, sf):
    """A user's memories in short, from twenty on."""
    c = C.compress(V.memories(spark, sf), "user_id")
    return c.select("user_id", "summary_text", F.array_join("key_facts", "|").alias("key_facts"), "source_memory_count")


@query(f"WITH {MEM} SELECT user_id, memory_state, organization_id, id AS member FROM mem QUALIFY count(*) OVER (PARTITION BY user_id, memory_state, organization_id) >= 3")
def cluster_membership(spark, sf):
    return C.clusters(V.memories(spark, sf), "user_id", "memory_state", "organization_id")


@query(f"WITH {ENT}, {LNK}, {GOA}, c AS (SELECT entity_id, avg(importance) AS confidence FROM lnk JOIN goa ON id = memory_id GROUP BY entity_id) SELECT e.id, 'What do we know about ' || e.name || '?' AS question, CASE WHEN confidence >= 0.5 THEN 0.05 ELSE -0.05 END::DOUBLE AS delta FROM ent e JOIN c ON c.entity_id = e.id WHERE confidence < 0.5")
def dream_gaps(spark, sf):
    """Open questions about entities that memories say little about."""
    l = V.links(spark, sf)
    g = V.goals(spark, sf)
    so_far = C.Window.partitionBy("entity_id").orderBy("memory_id").rowsBetween(C.Window.unboundedPreceding, C.Window.currentRow)
    c = l.join(g, l.memory_id == g.id).select("entity_id", F.sum("importance").over(so_far).alias("total"), F.count(F.lit(1)).over(so_far).alias("n"))
    c = c.groupBy("entity_id").agg((F.max_by("total", "n") / F.max("n")).alias("confidence"))  # added in order: a mean of 0.5 depends on it
    e = V.entities(spark, sf)
    out = e.join(c, e.id == c.entity_id).where("confidence < 0.5")
    return out.select("id", C.question(F.col("name")).alias("question"), C.utility_delta(F.col("confidence")).alias("delta"))


@query(f"WITH {MEM}, d AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM mem WHERE last_accessed_at < TIMESTAMP '2025-06-01'), t AS (SELECT * FROM d WHERE n <= 50) SELECT user_id, count(*) AS memory_count, string_agg(id, ',' ORDER BY id) FILTER (WHERE n <= 10) AS first_ids FROM t GROUP BY user_id")
def dream_log(spark, sf):
    """Up to fifty memories of each user that were seen before now, and the first ten of them."""
    w = C.Window.partitionBy("user_id").orderBy("id")
    d = V.memories(spark, sf).where(F.col("last_accessed_at") < V.at(V.DOCS_NOW)).withColumn("n", F.row_number().over(w)).where("n <= 50")
    g = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("memory_count"), F.sort_array(F.collect_list("id")).alias("ids"))
    return g.select("user_id", "memory_count", F.array_join(F.slice("ids", 1, 10), ",").alias("first_ids"))


@query(f"""WITH {MEM}, c AS (SELECT user_id, count(*) AS n FROM mem GROUP BY user_id), s AS (SELECT DISTINCT user_id FROM mem WHERE id % 31 = 0)
SELECT c.user_id, n, s.user_id IS NOT NULL AS is_stale FROM c LEFT JOIN s ON s.user_id = c.user_id""")
def compression_stale(spark, sf):
    """Summaries of users whose memories changed since."""
    m = V.memories(spark, sf)
    made = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("is_stale", F.lit(False))
    return C.mark_stale(made, m.where("id % 31 = 0"), "user_id").select("user_id", "n", "is_stale")


@query(f"""WITH {MEM}, t AS (SELECT id, {terms('title')} AS a, {terms('content')} AS b, {terms("array_to_string(tags, ' ')")} AS c FROM mem)
SELECT id, CAST(len(a) AS BIGINT) AS n_a, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS BIGINT) AS n_b,
  CAST(len(list_filter(c, lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x))) AS BIGINT) AS n_c FROM t""")
def weighted_terms(spark, sf):
    """The search vector that is kept with a memory: how many terms have each weight."""
    w = text.weighted_terms(F.col("title"), F.col("content"), F.col("tags"))
    m = V.memories(spark, sf).select("id", w.alias("w"))
    n = lambda k: F.size(F.filter("w", lambda t: t["weight"] == k)).cast("long")
    return m.select("id", n("A").alias("n_a"), n("B").alias("n_b"), n("C").alias("n_c"))
