"""Score expressions. Reference times are parameters, never the clock."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D
from .text import choose, strip


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` within bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def micros(since: Column, until: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", since, until)


def age_days(since: Column, now: Column) -> Column:
    return micros(since, now) / 86_400_000_000


def freshness(created: Column, now: Column, half_life_days: float = D.HALF_LIFE_DAYS) -> Column:
    half = half_life_days if half_life_days > 0 else D.HALF_LIFE_DAYS
    return F.exp(F.greatest(age_days(created, now), F.lit(0.0)) * (-log(2) / half))


def utility(used: Column, retrieved: Column) -> Column:
    return F.when(retrieved > 0, clamp(F.greatest(used, F.lit(0)) / retrieved)).otherwise(F.lit(0.0))


def confidence(source: Column) -> Column:
    return choose(source, D.CONFIDENCE)


def low_value(content: Column) -> Column:
    """Blank texts, greetings and fillers."""
    body = strip(content)
    out = body == ""
    for pattern in D.LOW_VALUE:
        out = out | body.rlike("(?i)" + pattern)
    return out


def importance(kind: Column, content: Column, mentions: Column, referenced: Column, emphasis: Column, decision: Column, ratio: Column, now: Column) -> dict[str, Column]:
    """The parts of the importance score, the score, and whether the content is rejected (then all parts are 0)."""
    rejected = low_value(content)
    part = lambda x: F.when(rejected, F.lit(0.0)).otherwise(x)
    parts = {
        "base_score": part(choose(kind, D.IMPORTANCE)),
        "repetition": part(clamp(mentions, 0, 3) / 3 * 0.1),
        "recency": part(F.when(referenced >= F.timestamp_add("DAY", F.lit(-7), now), F.lit(0.05)).otherwise(F.lit(0.0))),
        "emphasis": part(F.when(emphasis, F.lit(0.15)).otherwise(F.lit(0.0))),
        "decision_impact": part(F.when(decision, F.lit(0.1)).otherwise(F.lit(0.0))),
        "utility": part(F.coalesce(clamp((ratio - 0.5) * 0.2, -0.1, 0.1), F.lit(0.0))),
    }
    total = None
    for x in parts.values():
        total = x if total is None else total + x
    return parts | {"final_score": part(clamp(total)), "rejected": rejected}


def feedback_adjust(score: Column, retrieved: Column, used: Column, ignored: Column) -> Column:
    return (
        F.when((ignored >= 10) & (used == 0), F.greatest(F.lit(0.0), score - 0.1))
        .when((retrieved >= 10) & (utility(used, retrieved) > 0.8), F.least(F.lit(1.0), score + 0.05))
        .otherwise(score)
    )


def hybrid(semantic: Column, graph: Column, importance_: Column, recency: Column, keyword: Column, state: Column) -> Column:
    w = D.RETRIEVAL
    score = semantic * w["semantic"] + graph * w["graph"] + importance_ * w["importance"] + recency * w["recency"] + keyword * w["keyword"]
    return F.when(state == "cold", F.greatest(F.lit(0.0), score - D.COLD_PENALTY)).otherwise(score)


def last_seen(accessed: Column, updated: Column, created: Column) -> Column:
    return F.coalesce(accessed, updated, created)


def decay(state: Column, pinned: Column, seen: Column, now: Column) -> Column:
    """The state after one step of ageing; pinned memories keep theirs."""
    out = F.when(pinned, state)
    for before, (days, after) in D.DECAY_DAYS.items():
        out = out.when((state == before) & (age_days(seen, now) >= days), F.lit(after))
    return out.otherwise(state)


def reactivate(state: Column) -> Column:
    return F.when(state.isin("warm", "cold"), F.lit("active")).otherwise(state)
