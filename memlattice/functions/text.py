"""String expressions: terms, keyword overlap, stripped and comparison texts, token estimates, term search."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often and within whatever lambdas it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(x: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def choose(key: Column, values: Mapping, default=None) -> Column:
    """The literal that ``values`` has for ``key``."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def terms(x: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the lower-cased text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))


def keyword_overlap(query: Column, document: Column) -> Column:
    """Share of the query's terms that the document has; 0 for a query without terms."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, document)) / F.size(query)).otherwise(F.lit(0.0))


def has_all_terms(query: Column, document: Column) -> Column:
    return F.size(F.array_except(query, document)) == 0


def comparison_text(title: Column, content: Column) -> Column:
    return strip(F.concat_ws("\n", strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(content, F.lit("")))))


def word_tokens(x: Column) -> Column:
    """Words, one at least."""
    body = strip(x)
    return F.when(body == "", F.lit(1)).otherwise(F.size(F.split(body, r"\s+"))).cast("long")


def byte_tokens(x: Column) -> Column:
    return F.floor(F.octet_length(x) / 4).cast("long")


def slug(email: Column) -> Column:
    return F.lower(F.translate(F.split_part(email, F.lit("@"), F.lit(1)), "._", "--"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def weighted_terms(title: Column, content: Column, tags: Column) -> Column:
    """Search terms with the weight of the best place that they stand in: title A, content B, tags C."""
    part = lambda x, w: F.transform(terms(x), lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    a, b = terms(title), terms(content)
    fresh = lambda x, w, seen: F.filter(part(x, w), lambda t: ~F.array_contains(seen, t["term"]))
    return F.concat(part(title, "A"), fresh(content, "B", a), fresh(F.concat_ws(" ", tags), "C", F.array_union(a, b)))
