"""Vector expressions over array columns, and the deterministic stand-in embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a side is null, the lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def semantic(a: Column, b: Column) -> Column:
    """Cosine held to 0 .. 1; 0 where there is none."""
    x = cosine(a, b)
    return F.when(x.isNull() | (x < 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), x))


def deterministic_embedding(text: Column, dims: int) -> Column:
    """``dims`` numbers in -1 .. 1 from the bytes of a chain of SHA-256 digests: each digest hashes the one before."""
    first = F.sha2(text.cast("binary"), 256)
    rest = F.sequence(F.lit(1), F.lit(max(1, -(-dims // 32))))
    chain = F.aggregate(
        rest, F.struct(first.alias("d"), F.lit("").alias("all")),
        lambda s, _: F.struct(F.sha2(F.unhex(s.getField("d")), 256).alias("d"), F.concat(s.getField("all"), s.getField("d")).alias("all")),
        lambda s: s.getField("all"),
    )
    at = F.sequence(F.lit(0), F.lit(dims - 1))
    return F.transform(at, lambda i: F.conv(F.substring(chain, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1)


def embedding_text(title: Column, content: Column) -> Column:
    """What is embedded of a memory: its title and content, a line each, without white space around them."""
    return strip(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))


def of_dimension(v: Column, dims: int) -> Column:
    """``v``; reading it fails where it has another number of components."""
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dims} was expected, not of "), F.size(v).cast("string"))))


def embedded(text: Column, dims: int, provider: Callable[[Column], Column] | None = None) -> Column:
    """The vector of a text by ``provider``, an expression or Arrow UDF; by digests without one."""
    return of_dimension(provider(text) if provider else deterministic_embedding(text, dims), dims)
