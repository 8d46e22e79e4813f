"""Validation, normalisation, policies and schemas."""

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.text import choose
from ..operators import ingest as I
from ..operators import rules as Rules
from ..sources import views as V
from ..sources.scratch import Scratch
from .ctes import MEM, case, strip
from .registry import query

# Payloads of six sorts with the messages of the conversations, made alike on both sides; of the padded ones, those of every tenth conversation are too large.
BODY = """body AS (SELECT conv_id AS id, turn, CASE (conv_id + turn) % 6
  WHEN 0 THEN '{"user_id": ' || conv_id || ', "organization_id": 1, "session_id": ' || conv_id || ', "messages": [' || to_json({'role': role, 'text': text}) || ']}'
  WHEN 1 THEN '{"user_id": null, "organization_id": 1, "messages": []}'
  WHEN 2 THEN '{"user_id": 1, "organization_id"'
  WHEN 3 THEN '[1, 2]'
  WHEN 4 THEN '{}'
  ELSE '{"user_id": 1, "organization_id": 2, "session_id": 3, "messages": [' || to_json({'role': role, 'text': text}) || '], "pad": "' || repeat('a', CASE WHEN conv_id % 10 = 0 THEN 1048600 ELSE 60 END) || '"}' END AS body
FROM conversations)"""
MISSING = ", ".join(f"CASE WHEN json_extract(j, '$.{f}') IS NULL OR json_type(j, '$.{f}') = 'NULL' THEN '{f}: required' END" for f in D.REQUIRED_FIELDS)
ERRORS = f"""{BODY}, p AS (SELECT id, turn, octet_length(encode(body)) AS n, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM body),
e AS (SELECT id, turn, CASE WHEN n > 1048576 THEN 'body: too large' WHEN j IS NULL THEN 'body: not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'body: not an object'
  ELSE array_to_string(list_filter([{MISSING}], lambda x: x IS NOT NULL), '; ') END AS errors FROM p)"""


def bodies(spark, sf):
    c = V.load(spark, sf, "conversations")
    i, k = F.col("conv_id").cast("string"), (F.col("conv_id") + F.col("turn")) % 6
    said_ = F.to_json(F.struct("role", "text"))
    body = (
        F.when(k == 0, F.concat(F.lit('{"user_id": '), i, F.lit(', "organization_id": 1, "session_id": '), i, F.lit(', "messages": ['), said_, F.lit("]}")))
        .when(k == 1, '{"user_id": null, "organization_id": 1, "messages": []}')
        .when(k == 2, '{"user_id": 1, "organization_id"')
        .when(k == 3, "[1, 2]")
        .when(k == 4, "{}")
        .otherwise(F.concat(F.lit('{"user_id": 1, "organization_id": 2, "session_id": 3, "messages": ['), said_, F.lit('], "pad": "'), F.repeat(F.lit("a"), F.when(F.col("conv_id") % 10 == 0, 1048600).otherwise(60)), F.lit('"}')))
    )
    return c.select(F.col("conv_id").alias("id"), "turn", body.alias("body"))


@query(f"WITH {ERRORS} SELECT id, turn, errors FROM e")
def payload_validation(spark, sf):
    return bodies(spark, sf).select("id", "turn", F.array_join(I.payload_errors(F.col("body")), "; ").alias("errors"))


@query(f"WITH {ERRORS} SELECT id, turn FROM e WHERE errors = ''")
def payload_accepted(spark, sf):
    ok, _ = I.split(bodies(spark, sf), I.payload_errors(F.col("body")))
    return ok.select("id", "turn")


@query(f"""WITH {ERRORS}, i AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS k, errors FROM e),
m AS (SELECT id, k, errors = 'body: not JSON' AS broken, CASE WHEN errors = '' THEN NULL WHEN starts_with(errors, 'body: ') THEN '[' || k || ']: ' || substr(errors, 7)
  ELSE '[' || k || '].' || replace(errors, '; ', '; [' || k || '].') END AS errors FROM i)
SELECT id, CASE WHEN bool_or(broken) THEN 'body: not an array' ELSE coalesce(string_agg(errors, '; ' ORDER BY k), '') END AS errors FROM m GROUP BY id""")
def batch_validation(spark, sf):
    """Every conversation's payloads as a batch: one bad item gives the place of each error and rejects the batch; with
    an item that is no JSON the whole is none."""
    g = bodies(spark, sf).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "body"))).alias("bs"))
    body = F.concat(F.lit("["), F.array_join(F.col("bs.body"), ","), F.lit("]"))
    return g.select("id", F.array_join(I.batch_errors(body), "; ").alias("errors"))


@query(f"""WITH {ERRORS}, i AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS k, errors FROM e)
SELECT id, count(*) FILTER (WHERE errors = '') AS accepted, coalesce(string_agg('[' || k || '] ' || errors, '; ' ORDER BY k) FILTER (WHERE errors <> ''), '') AS skipped FROM i GROUP BY id""")
def batch_partial(spark, sf):
    """Every conversation's payloads as a batch that goes on past bad items: how many were taken, and why not the others."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("turn")) - 1
    rows = bodies(spark, sf).withColumn("k", place).withColumn("errors", F.array_join(I.payload_errors(F.col("body")), "; "))
    bad = F.when(F.col("errors") != "", F.struct("k", F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), "errors").alias("why")))
    g = rows.groupBy("id").agg(F.count_if(F.col("errors") == "").alias("accepted"), F.sort_array(F.collect_list(bad)).alias("bad"))
    return g.select("id", "accepted", F.array_join(F.col("bad.why"), "; ").alias("skipped"))


def policy(name: str) -> str:
    store, ignore, _ = D.POLICIES[name]
    kinds = ", ".join(f"'{k}'" for k in store)
    return f"memory_type IN ({kinds}) AND " + " AND ".join(f"NOT regexp_matches(said, '(?i){p}')" for p in ignore)


SAID = f"{MEM}, s AS (SELECT *, CASE WHEN id % 4 = 0 THEN ' Thanks ' ELSE content END AS said FROM mem)"


def said(spark, sf):
    return V.memories(spark, sf).withColumn("said", F.when(F.col("id") % 4 == 0, " Thanks ").otherwise(F.col("content")))


def accepts(name: str):
    store, ignore, _ = I.resolve_policy(name)
    return I.policy_accepts(F.col("memory_type"), F.col("said"), store, ignore)


@query(f"WITH {SAID} SELECT id, memory_type FROM s WHERE {policy('coding-agent')}")
def policy_accept(spark, sf):
    return said(spark, sf).where(accepts("coding-agent")).select("id", "memory_type")


@query(f"WITH {SAID} SELECT id, memory_type FROM s WHERE NOT ({policy('crm-agent')})")
def policy_reject(spark, sf):
    return said(spark, sf).where(~accepts("crm-agent")).select("id", "memory_type")


# Policies that tenants have of their own: one under the name of a built-in one, one under a new name.
TENANT_POLICIES = [
    ("en", "crm-agent", ["contact", "fact", "goal"], ["^the ", r"\\bere"], {"contact": 0.95, "goal": 0.2}),
    ("de", "notes", ["fact", "skill", "event", "custom"], [r"\\d{3}"], {"event": 0.33}),
    ("fr", "notes", ["fact"], [], {}),
]
NAMES = ["coding-agent", "crm-agent", "tutor-agent", "notes", "nobody"]


def sql_policy(org, name, store, ignore, weights) -> str:
    texts = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    return f"({f"'{org}'" if org else 'NULL'}, '{name}', {texts(store)}, {texts(ignore)}, {texts(weights)}, [{', '.join(map(str, weights.values()))}]::DOUBLE[])"


ALL_POLICIES = ", ".join(sql_policy(*p) for p in [*TENANT_POLICIES, *[(None, k, *v) for k, v in D.POLICIES.items()], (None, "", D.MEMORY_TYPES, [], {})])


@query(f"""WITH {MEM}, pol(org, name, store, ignore, kinds, weights) AS (VALUES {ALL_POLICIES}),
req AS (SELECT *, {NAMES}[id % 5 + 1] AS policy FROM mem),
r AS (SELECT req.*, (SELECT max_by(struct_pack(store := store, ignore := ignore, kinds := kinds, weights := weights), CASE WHEN org IS NOT NULL THEN 2 WHEN name <> '' THEN 1 ELSE 0 END)
  FROM pol WHERE name = policy AND (org = organization_id OR org IS NULL) OR name = '') AS p FROM req)
SELECT id, policy, list_contains(p.store, memory_type) AND len(list_filter(p.ignore, lambda x: regexp_matches(content, '(?i)' || x))) = 0 AS accepted,
  coalesce(p.weights[list_position(p.kinds, memory_type)], {case('memory_type', D.IMPORTANCE)}) AS weight FROM r""")
def tenant_policies(spark, sf):
    """Every memory by the policy that it asks for: its tenant's own, else the built-in one, else the default."""
    own = spark.createDataFrame(TENANT_POLICIES, Rules.POLICY)
    m = Rules.with_policy(V.memories(spark, sf).withColumn("policy", V.pick(NAMES, F.col("id") % 5)), own)
    kind, rules = F.col("memory_type"), F.col("rules")
    return m.select("id", "policy", Rules.accepts(rules, kind, F.col("content")).alias("accepted"), Rules.priority(rules, kind, choose(kind, D.IMPORTANCE)).alias("weight"))


@query(f"WITH {MEM} SELECT id, memory_type, {case('memory_type', D.POLICIES['tutor-agent'][2], case('memory_type', D.IMPORTANCE))} AS weight FROM mem")
def priority_weights(spark, sf):
    return V.memories(spark, sf).select("id", "memory_type", I.priority(F.col("memory_type"), D.POLICIES["tutor-agent"][2], choose(F.col("memory_type"), D.IMPORTANCE)).alias("weight"))


# Model answers: a fence, one full item, one with content alone, one that is no object, one without content.
ANSWER = """ans AS (SELECT doc_id AS id, '```json' || chr(10) || '{"memories": [' || to_json({'title': ' T' || doc_id || ' ', 'content': text, 'memory_type': ['fact', 'goal', 'nonsense'][doc_id % 3 + 1], 'source_type': 'api'}) || ', '
  || to_json({'content': '  ' || text}) || ', 5, {"title": ""}]}' || chr(10) || '```' AS answer FROM documents),
items AS (SELECT id, unnest(range(0, 4)) AS idx, CAST(regexp_replace(regexp_replace(answer, '^```json', ''), '```$', '') AS JSON) AS j FROM ans),
got AS (SELECT id, idx, json_extract(j, '$.memories[' || idx || ']') AS item FROM items)"""
NORM = f"""{ANSWER}, n AS (SELECT id, idx, coalesce(json_extract_string(item, '$.memory_type'), 'custom') AS memory_type, coalesce(json_extract_string(item, '$.source_type'), 'agent_inference') AS source_type,
  {strip("coalesce(json_extract_string(item, '$.title'), '')")} AS t, {strip("coalesce(json_extract_string(item, '$.content'), '')")} AS content FROM got WHERE json_type(item) = 'OBJECT'),
m AS (SELECT id, CAST(idx AS INTEGER) AS idx, memory_type, source_type, CASE WHEN t = '' AND content <> '' THEN {strip("left(content, 80)")} ELSE t END AS title, content FROM n)"""


def answers(spark, sf):
    i = F.col("doc_id")
    full = F.to_json(F.struct(F.concat(F.lit(" T"), i, F.lit(" ")).alias("title"), F.col("text").alias("content"), V.pick(["fact", "goal", "nonsense"], i % 3).alias("memory_type"), F.lit("api").alias("source_type")))
    bare = F.to_json(F.struct(F.concat(F.lit("  "), "text").alias("content")))
    return V.load(spark, sf, "documents").select(i.alias("id"), F.concat(F.lit('```json\n{"memories": ['), full, F.lit(", "), bare, F.lit(', 5, {"title": ""}]}\n```')).alias("answer"))


@query(f"WITH {NORM} SELECT * FROM m")
def llm_json_parse(spark, sf):
    """A model's fenced answer to rows with defaults; what is no object is skipped."""
    return I.normalized(I.parsed_memories(answers(spark, sf), "answer"))


@query(f"WITH {NORM} SELECT id, idx, title FROM m WHERE memory_type IN ({', '.join(repr(k) for k in D.MEMORY_TYPES)}) AND source_type IN ({', '.join(repr(k) for k in D.SOURCE_TYPES)}) AND length(title) > 0")
def normalize_memories(spark, sf):
    """Those that then are valid memories."""
    items = I.normalized(I.parsed_memories(answers(spark, sf), "answer"))
    return items.where(I.valid_memory(F.col("memory_type"), F.col("source_type"), F.col("title"))).select("id", "idx", "title")


SCHEMA = {"fields": [{"name": "company", "type": "string"}, {"name": "amount", "type": "number"}, {"name": "won", "type": "boolean"}, {"name": "stage", "type": "enum", "values": ["lead", "won"]}, {"name": "closed", "type": "date"}, {"name": "tags", "type": "array"}, {"name": "extra", "type": "object"}], "required": ["company", "amount"]}
DATA = """dat AS (SELECT event_id AS id, '{"company": ' || ['"acme"', '5', 'null', 'true'][event_id % 4 + 1] || ', "amount": ' || ['1', '2.5', '"x"', 'true', 'null'][event_id % 5 + 1] || ', "won": ' || ['true', '1'][event_id % 2 + 1]
  || ', "stage": ' || ['"lead"', '"maybe"', 'null'][event_id % 3 + 1] || ', "closed": ' || ['"2024-02-29"', '"2023-02-29"', '"soon"', '7'][event_id % 4 + 1] || ', "tags": ' || ['[1]', '{}'][event_id % 2 + 1] || ', "extra": ' || ['{}', '[]', 'null'][event_id % 3 + 1] || ', "other": 1}' AS data FROM events)"""


def ev(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN '{text}' END"


def jt(f: str) -> str:
    return f"json_type(j, '$.{f}')"


CHECKS = ", ".join([
    ev(f"{jt('company')} = 'NULL'", "company is required"), ev(f"{jt('amount')} = 'NULL'", "amount is required"),
    ev(f"{jt('company')} NOT IN ('VARCHAR', 'NULL')", "company must be string"), ev(f"{jt('amount')} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')", "amount must be number"),
    ev(f"{jt('won')} <> 'BOOLEAN'", "won must be boolean"), ev(f"{jt('stage')} <> 'NULL' AND json_extract_string(j, '$.stage') NOT IN ('lead', 'won')", "stage must be enum"),
    ev("TRY_CAST(json_extract_string(j, '$.closed') AS DATE) IS NULL", "closed must be date"), ev(f"{jt('tags')} <> 'ARRAY'", "tags must be array"), ev(f"{jt('extra')} NOT IN ('OBJECT', 'NULL')", "extra must be object"),
])


@query(f"WITH {DATA}, p AS (SELECT id, CAST(data AS JSON) AS j FROM dat) SELECT id, array_to_string(list_filter([{CHECKS}], lambda x: x IS NOT NULL), '; ') AS errors FROM p")
def schema_validation(spark, sf):
    """A tenant's schema against JSON payloads, as generated expressions over variants."""
    return payloads(spark, sf).select("id", F.array_join(I.schema_errors(F.parse_json("data"), SCHEMA), "; ").alias("errors"))


def payloads(spark, sf):
    i = F.col("event_id")
    p = lambda vs: V.pick(vs, i % len(vs))
    data = F.concat(F.lit('{"company": '), p(['"acme"', "5", "null", "true"]), F.lit(', "amount": '), p(["1", "2.5", '"x"', "true", "null"]), F.lit(', "won": '), p(["true", "1"]), F.lit(', "stage": '), p(['"lead"', '"maybe"', "null"]), F.lit(', "closed": '), p(['"2024-02-29"', '"2023-02-29"', '"soon"', "7"]), F.lit(', "tags": '), p(["[1]", "{}"]), F.lit(', "extra": '), p(["{}", "[]", "null"]), F.lit(', "other": 1}'))
    return V.load(spark, sf, "events").select(i.alias("id"), data.alias("data"))


# Schemas of three tenants over the same payloads; a tenant of no schema accepts all.
SCHEMAS = [
    ("0", "deal", [(f["name"], f["type"], f.get("values")) for f in SCHEMA["fields"]], SCHEMA["required"]),
    ("1", "deal", [("amount", "string", None), ("won", "number", None), ("extra", "array", None)], ["extra", "absent"]),
    ("2", "deal", [("stage", "enum", ["maybe"]), ("company", "number", None), ("tags", "object", None), ("closed", "string", None)], []),
]
SQL_SCHEMAS = ", ".join(f"('{org}', '{name}', '{typ}', {list(values or [])}::VARCHAR[], {k})" for org, _, fields, _ in SCHEMAS for k, (name, typ, values) in enumerate(fields))
SQL_REQUIRED = ", ".join(f"('{org}', '{name}', {k})" for org, _, _, required in SCHEMAS for k, name in enumerate(required))


@query(f"""WITH {DATA}, p AS (SELECT id, CAST(id % 4 AS VARCHAR) AS org, CAST(data AS JSON) AS j FROM dat), fld(org, name, typ, vals, k) AS (VALUES {SQL_SCHEMAS}), must(org, name, k) AS (VALUES {SQL_REQUIRED}),
v AS (SELECT id, k, name, typ, vals, json_extract_string(j, '$.' || name) AS x, json_type(j, '$.' || name) AS t FROM p JOIN fld USING (org)),
e AS (SELECT id, k + 100 AS k, name || ' must be ' || typ AS error FROM v WHERE coalesce(t, 'NULL') <> 'NULL' AND NOT CASE typ WHEN 'string' THEN t = 'VARCHAR' WHEN 'number' THEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') WHEN 'boolean' THEN t = 'BOOLEAN'
    WHEN 'date' THEN t = 'VARCHAR' AND TRY_CAST(x AS DATE) IS NOT NULL WHEN 'enum' THEN t = 'VARCHAR' AND list_contains(vals, x) WHEN 'array' THEN t = 'ARRAY' ELSE t = 'OBJECT' END
  UNION ALL SELECT id, k, name || ' is required' FROM p JOIN must USING (org) WHERE coalesce(json_type(j, '$.' || name), 'NULL') = 'NULL')
SELECT p.id, coalesce(string_agg(error, '; ' ORDER BY k), '') AS errors FROM p LEFT JOIN e ON e.id = p.id GROUP BY p.id""")
def tenant_schemas(spark, sf):
    """Payloads of four tenants, each against its tenant's schema from a table."""
    rules = spark.createDataFrame(SCHEMAS, Rules.SCHEMA)
    rows = payloads(spark, sf).withColumn("organization_id", (F.col("id") % 4).cast("string")).join(rules, "organization_id", "left")
    errors = F.when(F.col("fields").isNotNull(), Rules.schema_errors(F.col("data"), F.col("fields"), F.col("required"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.array_join(errors, "; ").alias("errors"))


@query(f"WITH {DATA}, p AS (SELECT id, CAST(data AS JSON) AS j FROM dat), e AS (SELECT id, len(list_filter([{CHECKS}], lambda x: x IS NOT NULL)) AS n FROM p) SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS review, count(*) FILTER (WHERE n = 0) AS stored FROM e")
def task_outcomes(spark, sf):
    """What became of a batch: how many rows, to review, stored; observed while they are written."""
    seen, scratch = Observation("outcomes"), Scratch(spark, "outcomes")
    bad = F.col("errors") != ""
    scratch.write(schema_validation(spark, sf).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("review"), F.count_if(~bad).alias("stored")), "validated")
    return spark.createDataFrame([tuple(seen.get[k] for k in ("total", "review", "stored"))], "total long, review long, stored long")


SENTENCES = f"""s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: {strip("x")}), lambda x: x <> '')) AS content FROM conversations)"""


@query(f"""WITH {SENTENCES} SELECT conv_id, turn, content, CASE {" ".join(f"WHEN regexp_matches(content, '(?i){p}') THEN '{k}'" for p, k in I.TELLING)} ELSE 'fact' END AS memory_type FROM s""")
def extraction(spark, sf):
    """What the rules extract from each message, by a table function that is joined laterally."""
    I.register_extractor(spark, "extracted", I.by_rules)
    V.load(spark, sf, "conversations").createOrReplaceTempView("said")
    return spark.sql("SELECT conv_id, turn, content, memory_type FROM said, LATERAL extracted(text)")


@query("SELECT DISTINCT lower(replace(replace(split_part(e, '@', 1), '.', '-'), '_', '-')) AS slug FROM (SELECT replace(c_name, '#', '_') || '.' || c_mktsegment || '@Example.com' AS e FROM customer)")
def slug_derivation(spark, sf):
    from ..functions.text import slug

    mail = F.concat(F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("."), "c_mktsegment", F.lit("@Example.com"))
    return V.load(spark, sf, "customer").select(slug(mail).alias("slug")).distinct()
