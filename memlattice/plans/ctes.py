"""The views of ``sources.views`` in the oracle's SQL, as common table expressions."""

from ..functions import domains as D


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def case(key: str, values: dict, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + f" ELSE {default} END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def age(since: str, now: str) -> str:
    return f"(date_diff('microsecond', {since}, TIMESTAMP '{now}') / 86400000000.0)"


MEM = f"""mem AS (
  SELECT doc_id AS id, lang AS organization_id, doc_id % 50 AS user_id,
    {listed(D.MEMORY_TYPES)}[doc_id % 11 + 1] AS memory_type, {listed(D.SOURCE_TYPES)}[doc_id % 5 + 1] AS source_type,
    {listed(D.MEMORY_STATES)}[doc_id % 4 + 1] AS memory_state, left({strip("text")}, 80) AS title, text AS content,
    [lang, source] AS tags, doc_id % 17 = 0 AS is_pinned, doc_id % 13 = 0 AS is_archived,
    (doc_id % 100) / 100.0 AS importance, (doc_id % 21) / 20.0 AS utility_score, doc_id % 87 AS session_id,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 + doc_id % 7 AS INTEGER)) AS updated_at,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 + doc_id % 90 AS INTEGER)) END AS last_accessed_at,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) AS valid_from,
    CASE WHEN doc_id % 19 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 + 10 AS INTEGER)) END AS valid_to
  FROM documents)"""

EMB = MEM + """, emb AS (
  SELECT m.*, v.embedding FROM mem m LEFT JOIN embeddings v ON m.id = v.vec_id)"""

VER = MEM + """, ver AS (
  SELECT id AS memory_id, organization_id, n AS version, title || '#' || n AS content, importance / n AS importance,
    valid_from + to_days(CAST(n AS INTEGER)) AS valid_from, valid_from + to_days(CAST(n + 1 AS INTEGER)) AS valid_to
  FROM (SELECT *, unnest(range(1, id % 3 + 2)) AS n FROM mem WHERE valid_to IS NOT NULL))"""

SES = """ses AS (
  SELECT conv_id AS id, conv_id % 50 AS user_id, count(*) AS turns,
    TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 300 AS INTEGER)) AS started_at,
    CASE WHEN conv_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 300 + 1 AS INTEGER)) END AS ended_at
  FROM conversations GROUP BY conv_id)"""

MET = """met AS (
  SELECT event_id AS id, user_id % 10 AS tenant_id, user_id AS actor_id, event_type, ts AS recorded_at, value AS units,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS target_id, octet_length(encode(props)) AS bytes FROM events)"""

ENT = """ent AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, CAST(-1 AS BIGINT) AS user_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, -1 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_custkey % 50 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, s_suppkey % 50 FROM supplier)"""

EDG = """edg AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relationship FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in' FROM supplier)"""

LNK = "lnk AS (SELECT o_orderkey AS memory_id, 'customer:' || o_custkey AS entity_id FROM orders)"

GOA = f"""goa AS (
  SELECT o_orderkey AS id, {listed(D.MEMORY_TYPES)}[o_orderkey % 11 + 1] AS memory_type,
    {listed(D.MEMORY_STATES)}[o_orderkey % 4 + 1] AS memory_state, o_orderkey % 17 = 0 AS is_pinned,
    o_orderkey % 13 = 0 AS is_archived, (o_orderkey % 100) / 100.0 AS importance, o_orderdate AS seen_at, o_custkey AS user_id
  FROM orders)"""


def similarities(pairs: str) -> str:
    """CTEs (recursive) that give ``sim`` (a, b, ratio): the Ratcliff-Obershelp ratio of each distinct pair (a, b) of
    lower-cased texts of ``pairs``, under 200 characters. A step takes the longest common block, the first in a, then
    in b, and goes on with what lies to its left and right; a block is kept as 1000 * length - place in a."""
    best = """list_max(list_transform(list_filter(flatten(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: list_transform(range(1, len({a}) - k + 2), lambda i: [k, i]))),
      lambda c: contains({b}, substr({a}, c[2], c[1]))), lambda c: c[1] * 1000 - c[2]))"""
    return f"""txt AS (SELECT DISTINCT a, b FROM {pairs}),
seg AS (SELECT a AS left_text, b AS right_text, a, b, {best.format(a="a", b="b")} AS best FROM txt
  UNION ALL SELECT left_text, right_text, x.a, x.b, {best.format(a="x.a", b="x.b")} FROM (
    SELECT left_text, right_text, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS x FROM (
      SELECT *, instr(b, substr(a, i, k)) AS j FROM (SELECT *, CAST(ceil(best / 1000.0) AS BIGINT) AS k, CAST(ceil(best / 1000.0) * 1000 - best AS BIGINT) AS i FROM seg WHERE best IS NOT NULL)))
  WHERE x.a <> '' AND x.b <> ''),
sim AS (SELECT left_text AS a, right_text AS b, 2.0 * sum(coalesce(ceil(best / 1000.0), 0)) / (len(left_text) + len(right_text)) AS ratio FROM seg GROUP BY left_text, right_text)"""
