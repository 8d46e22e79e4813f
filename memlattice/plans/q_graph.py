"""Walks, subgraphs and entity links."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import views as V
from .ctes import EDG, ENT, GOA, LNK
from .registry import query

SEEDS = ["customer:5", "supplier:3"]
WALK = f"""RECURSIVE {EDG}, both_ AS (SELECT source AS a, target AS b FROM edg UNION ALL SELECT target, source FROM edg),
walk AS (SELECT unnest(['customer:5', 'supplier:3']) AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = id WHERE depth < 2),
near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def seeds(spark):
    return spark.createDataFrame([(x,) for x in SEEDS], "id string")


@query(f"WITH {WALK} SELECT id, depth FROM near")
def graph_bfs_nodes(spark, sf):
    return G.reach(V.edges(spark, sf), seeds(spark), 2)


@query("WITH " + WALK.replace("depth < 2", "depth < 5") + " SELECT id, depth FROM near")
def graph_bfs_deep(spark, sf):
    """As far as five steps: every node is taken up once, at its least depth."""
    return G.reach(V.edges(spark, sf), seeds(spark), 5)


@query(f"WITH {WALK}, {LNK} SELECT DISTINCT memory_id FROM lnk WHERE entity_id IN (SELECT id FROM near)")
def graph_memory_ids(spark, sf):
    return G.linked_memories(V.links(spark, sf), G.reach(V.edges(spark, sf), seeds(spark), 2))


OWN = f"""RECURSIVE {ENT}, {EDG}, both_ AS (SELECT source AS a, target AS b FROM edg UNION ALL SELECT target, source FROM edg),
own AS (SELECT id FROM ent WHERE user_id = 7 ORDER BY id LIMIT 200),
walk AS (SELECT id, 0 AS depth FROM own UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = id WHERE depth < 1),
near AS (SELECT DISTINCT id FROM walk)"""


def own(spark, sf):
    return V.entities(spark, sf).where("user_id = 7").orderBy("id").limit(200)


@query(f"WITH {OWN}, {LNK}, n AS (SELECT entity_id, count(*) AS c FROM (SELECT DISTINCT * FROM lnk) GROUP BY entity_id) SELECT e.id, e.kind, e.name, coalesce(c, 0) AS memory_count FROM ent e JOIN near USING (id) LEFT JOIN n ON n.entity_id = e.id")
def user_subgraph(spark, sf):
    """A user's entities and what they touch, with how many memories mention each."""
    near = G.reach(V.edges(spark, sf), own(spark, sf), 1)
    nodes = V.entities(spark, sf).join(near.select("id"), "id", "left_semi")
    return G.memory_counts(V.links(spark, sf), nodes).select("id", "kind", "name", "memory_count")


@query(f"WITH {OWN} SELECT DISTINCT source, target, relationship FROM edg WHERE source IN (SELECT id FROM own) OR target IN (SELECT id FROM own)")
def user_subgraph_edges(spark, sf):
    return G.subgraph_edges(V.edges(spark, sf), own(spark, sf)).select("source", "target", "relationship")


@query(f"WITH {EDG} SELECT source AS id, target AS neighbour, relationship FROM edg WHERE source IN ('nation:3', 'region:1') UNION ALL SELECT target, source, relationship FROM edg WHERE target IN ('nation:3', 'region:1')")
def neighbors(spark, sf):
    return G.neighbours(V.edges(spark, sf), spark.createDataFrame([("nation:3",), ("region:1",)], "id string"))


@query(f"WITH {EDG} SELECT 'from' AS side, source, target FROM edg WHERE source = 'nation:3' UNION ALL SELECT 'to', source, target FROM edg WHERE target = 'nation:3'")
def edges_from_to(spark, sf):
    e = V.edges(spark, sf)
    one = e.where("source = 'nation:3'").select(F.lit("from").alias("side"), "source", "target")
    return one.unionByName(e.where("target = 'nation:3'").select(F.lit("to").alias("side"), "source", "target"))


@query(f"WITH {LNK}, {GOA} SELECT l.entity_id, g.id, g.memory_type FROM lnk l JOIN goa g ON g.id = l.memory_id JOIN customer ON l.entity_id = 'customer:' || c_custkey")
def entity_memories(spark, sf):
    """Entity, link, memory: two equi-joins; links to what does not exist are dropped."""
    l = V.links(spark, sf).join(V.entities(spark, sf).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    m = V.goals(spark, sf)
    return l.join(m, l.memory_id == m.id).select("entity_id", "id", "memory_type")


@query(f"WITH {ENT}, {LNK}, n AS (SELECT entity_id, count(*) AS c FROM lnk GROUP BY entity_id) SELECT e.id, coalesce(c, 0) AS memory_count FROM ent e LEFT JOIN n ON n.entity_id = e.id")
def entity_memory_counts(spark, sf):
    return G.memory_counts(V.links(spark, sf), V.entities(spark, sf)).select("id", "memory_count")


@query(f"WITH {WALK}, {ENT} SELECT id, name FROM ent WHERE id IN (SELECT id FROM near WHERE depth > 0)")
def missing_graph_nodes(spark, sf):
    """Names of nodes that a walk found beyond its seeds."""
    far = G.reach(V.edges(spark, sf), seeds(spark), 2).where("depth > 0")
    return V.entities(spark, sf).join(far, "id", "left_semi").select("id", "name")


@query(f"WITH {LNK} SELECT DISTINCT entity_id AS source, entity_id AS target, 'superseded' AS relationship FROM lnk WHERE memory_id % 19 = 0")
def supersession_edges(spark, sf):
    """A self-edge for each entity of a superseded memory."""
    l = V.links(spark, sf).where("memory_id % 19 = 0").select("entity_id").distinct()
    return l.select(F.col("entity_id").alias("source"), F.col("entity_id").alias("target"), F.lit("superseded").alias("relationship"))


@query(f"WITH {LNK} SELECT DISTINCT entity_id AS source, 'nation:' || c_nationkey AS target, 'mentioned_with' AS relationship FROM lnk JOIN customer ON entity_id = 'customer:' || c_custkey")
def typed_edge_creation(spark, sf):
    """New edges of one kind, from each linked customer to its nation."""
    c = V.load(spark, sf, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity_id"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"))
    return G.typed_edges(V.links(spark, sf).join(c, "entity_id").select(F.col("entity_id").alias("source"), "target"), "mentioned_with")
