"""Payload validation, normalisation, policies and tenant-defined schemas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.text import let, strip


def payload_errors(body: Column, prefix: Column | None = None, required: Sequence[str] = tuple(D.REQUIRED_FIELDS), most: int = D.MAX_PAYLOAD_BYTES) -> Column:
    """Array of errors of a JSON payload: too large, no JSON object, required fields that are missing or null."""
    at = lambda name: F.concat(prefix, F.lit("." + name)) if prefix is not None else F.lit(name)
    whole = prefix if prefix is not None else F.lit("body")
    there = lambda x: x.isNotNull() & ~F.is_variant_null(x)

    def of(v: Column) -> Column:
        missing = F.array(*[F.when(~there(F.try_variant_get(v, f"$.{f}", "variant")), F.concat(at(f), F.lit(": required"))) for f in required])
        return F.when(v.isNull(), F.array(F.concat(whole, F.lit(": not JSON")))).when(~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.concat(whole, F.lit(": not an object")))).otherwise(F.array_compact(missing))

    return F.when(F.octet_length(body) > most, F.array(F.concat(whole, F.lit(": too large")))).otherwise(let(F.try_parse_json(body), of))


def batch_errors(body: Column, most: int = D.MAX_BATCH) -> Column:
    """Array of errors of a JSON array of ``most`` payloads at most; a batch is taken whole or not at all."""
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    each = F.flatten(F.transform(items, lambda x, i: payload_errors(F.to_json(x), F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
    return F.when(items.isNull(), F.array(F.lit("body: not an array"))).when(F.size(items) == 0, F.array(F.lit("body: empty"))).when(F.size(items) > most, F.array(F.lit(f"body: more than {most} items"))).otherwise(each)


def split(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def create_many(rows: DataFrame, errors: Column) -> DataFrame:
    """``rows``, all of them or none: reading them fails if a single one has ``errors`` (an array). The check is a count
    of its own, so no row is handed on before every row was looked at."""
    bad = rows.where(F.size(errors) > 0).agg(F.count(F.lit(1))).scalar()
    checked = F.when(bad > 0, F.raise_error(F.concat(bad.cast("string"), F.lit(" rows are not valid")))).otherwise(F.lit(True))
    return rows.where(checked)


def persisted(scored: DataFrame, now: Column) -> DataFrame:
    """Scored memories (id, organization_id, user_id, memory_type, source_type, title, content, importance) as rows of
    the memory table: new, active, valid from now on."""
    return scored.withColumns({"memory_state": F.lit("active"), "is_pinned": F.lit(False), "is_archived": F.lit(False), "utility_score": F.lit(0.0), "created_at": now, "valid_from": now, "valid_to": F.lit(None).cast("timestamp_ntz")})


def with_edges(scored: DataFrame, edges: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memory rows, edge rows) of scored memories with an array ``edges`` (source, target, relationship,
    organization_id). Reading the edges fails if one belongs to another tenant than its memory."""
    each = scored.select(F.col("id").alias("memory_id"), F.col("organization_id").alias("_tenant"), F.inline(edges))
    ours = F.coalesce(F.col("organization_id") == F.col("_tenant"), F.lit(False))
    each = each.withColumn("organization_id", F.when(ours, F.col("organization_id")).otherwise(F.raise_error(F.lit("tenant mismatch")).cast("string"))).drop("_tenant")
    return persisted(scored.drop(edges), now), each


def metered(changes: DataFrame, subject: str, op: str = "op") -> DataFrame:
    """``changes`` with event_type, the kind that metering counts them under; other operations are not metered."""
    kind = F.concat(F.lit(f"{subject}:"), F.col(op))
    return changes.withColumn("event_type", kind).where(F.col("event_type").isin(*D.METER_EVENTS))


def unfenced(response: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(strip(response), r"^```(json)?|```$", ""))


def parsed_memories(df: DataFrame, response: str) -> DataFrame:
    """A row (idx, item: a variant object) for each object of the answer's ``memories``; other items are skipped."""
    items = F.try_variant_get(F.try_parse_json(unfenced(F.col(response))), "$.memories", "array<variant>")
    out = df.select(*[c for c in df.columns if c != response], F.posexplode(items).alias("idx", "item"))
    return out.where(F.schema_of_variant("item").startswith("OBJECT"))


def normalized(df: DataFrame, item: str = "item") -> DataFrame:
    """``df`` with a memory's fields in place of the variant ``item``: kind and source with their defaults, stripped
    title and content, a title from the content where there is none."""
    rest = [c for c in df.columns if c != item]
    get = lambda f: F.try_variant_get(item, f"$.{f}", "string")
    text = {f: strip(F.coalesce(get(f), F.lit(""))).alias(f) for f in ("title", "content")}
    out = df.select(*rest, F.coalesce(get("memory_type"), F.lit("custom")).alias("memory_type"), F.coalesce(get("source_type"), F.lit("agent_inference")).alias("source_type"), text["title"], text["content"])
    return out.withColumn("title", F.when((F.col("title") == "") & (F.col("content") != ""), strip(F.left("content", F.lit(80)))).otherwise(F.col("title")))


def valid_memory(kind: Column, source: Column, title: Column) -> Column:
    return kind.isin(*D.MEMORY_TYPES) & source.isin(*D.SOURCE_TYPES) & (F.length(title) > 0)


def extract(df: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Memories (idx, item) of observations (…, text): by ``model``, or by rules that need none: each sentence with a
    telling verb is a memory of the kind that the verb stands for."""
    if model is not None:
        return model(df)
    s = F.explode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 0))
    out = df.select(*[c for c in df.columns if c != "text"], s.alias("content"))
    kind = F.when(F.col("content").rlike(r"(?i)\b(prefer|like|love)"), "preference").when(F.col("content").rlike(r"(?i)\b(want|plan|goal)"), "goal").when(F.col("content").rlike(r"(?i)\b(work|build)"), "project").otherwise("fact")
    return out.withColumn("memory_type", kind)


def register_extractor(spark: SparkSession, name: str, provider: Callable[[str], Iterable[tuple[str, str]]]) -> None:
    """Makes a provider a table function: ``name(text)`` gives (idx, content, memory_type) for each memory that the
    provider, text -> (content, kind) pairs, finds in a text. It is joined laterally and runs where the rows are."""

    class Extract:
        def eval(self, said: str):
            for i, (content, kind) in enumerate(provider(said or "")):
                yield i, content, kind

    spark.udtf.register(name, F.udtf(Extract, returnType="idx int, content string, memory_type string"))


def by_rules(said: str) -> Iterator[tuple[str, str]]:
    """A provider that needs no model: each sentence with a telling word is of the kind that the word stands for."""
    for m in re.finditer(r"[^.!?]+[.!?]*", said):
        content = m[0].strip(" \t\n\r\f\v")
        if content:
            yield content, next((kind for pattern, kind in TELLING if re.search(pattern, content, re.I)), "fact")


#: (pattern, kind) in the order in which they count.
TELLING = [(r"\b(prefer|like|love)", "preference"), (r"\b(want|plan|goal)", "goal"), (r"\b(work|build)", "project")]


def policy_accepts(kind: Column, content: Column, store: Sequence[str], ignore: Sequence[str]) -> Column:
    ok = kind.isin(*store)
    for pattern in ignore:
        ok = ok & ~content.rlike("(?i)" + pattern)
    return ok


def priority(kind: Column, weights: Mapping[str, float], otherwise: Column) -> Column:
    out = otherwise
    for k, w in weights.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out


def resolve_policy(name: str, own: Mapping[str, tuple] | None = None) -> tuple:
    """A tenant's own policy, else the built-in one of that name, else the default, which stores every kind."""
    return (own or {}).get(name) or D.POLICIES.get(name) or (D.MEMORY_TYPES, [], {})


def check_schema(schema: Mapping) -> list[tuple[str, str]]:
    """What is wrong with a schema's definition, as (rule, place); the rules are those of ``SCHEMA_RULES``, in order."""
    return [(rule, place) for rule, places in SCHEMA_RULES for place in places(schema)]


def schema_fields(schema: Mapping) -> list[tuple[str, Mapping]]:
    """(place, field) of the fields that are objects."""
    fields = schema.get("fields")
    return [(f"fields[{i}]", f) for i, f in enumerate(fields if isinstance(fields, list) else []) if isinstance(f, Mapping)]


def field_names(schema: Mapping) -> list[str]:
    return [f["name"] for _, f in schema_fields(schema) if isinstance(f.get("name"), str) and f["name"]]


#: (rule, schema -> where it is broken).
SCHEMA_RULES: list[tuple[str, Callable[[Mapping], list[str]]]] = [
    ("fields must be a list with an entry", lambda s: [] if isinstance(s.get("fields"), list) and s["fields"] else ["fields"]),
    ("a field is an object with a name", lambda s: [f"fields[{i}]" for i, f in enumerate(s["fields"] if isinstance(s.get("fields"), list) else []) if not isinstance(f, Mapping) or not isinstance(f.get("name"), str) or not f["name"]]),
    ("names are unique", lambda s: sorted(n for n, k in Counter(field_names(s)).items() if k > 1)),
    ("a type is one of the known ones", lambda s: [place for place, f in schema_fields(s) if f.get("type") not in D.FIELD_TYPES]),
    ("an enum lists its values", lambda s: [place for place, f in schema_fields(s) if f.get("type") == "enum" and not f.get("values")]),
    ("what is required is a field", lambda s: sorted(set(r) - set(field_names(s))) if isinstance(r := s.get("required", []), list) else ["required"]),
]


def schema_errors(data: Column, schema: Mapping) -> Column:
    """Array of errors of a variant object against a schema. Unknown keys are ignored, nulls pass every kind, a boolean
    is no number, dates are ISO dates or strings of such. Each field is taken out of the object once."""
    fields = {f["name"]: f for f in schema["fields"]}
    names = list(dict.fromkeys([*schema.get("required", []), *fields]))
    at = {n: f"f{i}" for i, n in enumerate(names)}

    def check(values: Column, kinds: Column) -> Column:
        null = lambda n: values[at[n]].isNull() | F.is_variant_null(values[at[n]])
        errors = [F.when(null(n), F.lit(f"{n} is required")) for n in schema.get("required", [])]
        for n, f in fields.items():
            v, kind = values[at[n]], kinds[at[n]]
            text = F.try_variant_get(v, "$", "string")
            ok = {
                "string": kind == "STRING",
                "number": kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
                "boolean": kind == "BOOLEAN",
                "date": (kind == "STRING") & F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & text.try_cast("date").isNotNull(),
                "enum": (kind == "STRING") & text.isin(*f.get("values", [])),
                "array": kind.startswith("ARRAY"),
                "object": kind.startswith("OBJECT"),
            }[f["type"]]
            errors.append(F.when(~null(n) & ~F.coalesce(ok, F.lit(False)), F.lit(f"{n} must be {f['type']}")))
        return F.array_compact(F.array(*errors))

    def of(v: Column) -> Column:
        values = F.struct(*[F.try_variant_get(v, f"$.{n}", "variant").alias(at[n]) for n in names])
        return let(values, lambda x: let(F.struct(*[F.schema_of_variant(x[a]).alias(a) for a in at.values()]), lambda k: check(x, k)))

    return let(data, of)
