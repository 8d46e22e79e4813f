"""Quality by a sparse rule ensemble: paths of small trees over text statistics become conjunctive rules, an L1-penalised
logistic fit keeps the few that matter, and what it keeps is compiled into one Spark column expression.

Scoring is DataFrame expressions only. Edge cases: a null text counts as an empty one; an empty text has the statistics
of no characters, no words and one line. Repeated rows are scored alike; a null id is carried along and not held out.
Texts of any length are read whole. Further columns are ignored. An empty table gives an empty result. Without labels
of both classes every score is the share of the one that there is (1 if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, crc_mod, labelled_sample, table

#: Labelled documents of a class to learn from, at most about; trees and their depth.
ROWS, TREES, DEPTH = 4000, 40, 3
Rule = tuple[tuple[str, bool, float], ...]  #: (statistic, whether it is above, bound), all of which must hold


def statistics(text: Column) -> dict[str, Column]:
    """Whole-text statistics, by name. Ratios have denominators of one at least."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.length(text) / F.size(lines),
        "upper": count(r"\p{Lu}"),
        "symbols": count(r"[^\p{L}\p{N}\s.,;:'\"?()-]"),
        "digits": count(r"\p{N}"),
        "stops": count(r"[.,;:?]"),
    }


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, bounds: list[np.ndarray], columns: np.ndarray, least: float):
    """(column, bound) whose two sides differ most by the second-order gain, if both weigh ``least`` or more."""
    best, gain = None, 1e-6
    total = g.sum() ** 2 / (h.sum() + 1)
    for c in columns:
        at = np.searchsorted(bounds[c], x[:, c], side="left")
        gs, hs = (np.cumsum(np.bincount(at, v, len(bounds[c]) + 1))[:-1] for v in (g, h))
        rg, rh = g.sum() - gs, h.sum() - hs
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((hs >= least) & (rh >= least), gs**2 / (hs + 1) + rg**2 / (rh + 1) - total, -1.0)
        if len(score) and score.max() > gain:
            best, gain = (int(c), float(bounds[c][score.argmax()])), float(score.max())
    return best


def grow(x, g, h, bounds, rng, names, depth: int, path: Rule, rows: np.ndarray, rules: set[Rule], step: np.ndarray) -> None:
    """A tree over ``rows``: notes the path to each node as a rule, and the leaf's value for each row in ``step``."""
    if path:
        rules.add(path)
    columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
    split = best_split(x[rows], g[rows], h[rows], bounds, columns, 3.0) if depth else None
    if split is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    c, bound = split
    above = x[rows, c] > bound
    for side in (False, True):
        grow(x, g, h, bounds, rng, names, depth - 1, (*path, (names[c], side, bound)), rows[above == side], rules, step)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    rng, rules, f = np.random.default_rng(11), set(), np.zeros(len(x))
    bounds = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 60))) for c in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(x))
        grow(x, weight * (p - y), weight * p * (1 - p) + 1e-9, bounds, rng, names, depth, (), np.arange(len(x)), rules, step)
        f += 0.3 * np.clip(step, -4, 4)
    return sorted(rules)


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """L1-penalised weighted logistic regression by accelerated proximal gradient; the bias is not penalised."""
    v = weight / weight.sum()
    m = np.c_[a, np.ones(len(a))]
    rate = 4 / max(np.linalg.eigvalsh((m * v[:, None]).T @ m)[-1], 1e-9)
    w, z, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), 1.0
    for _ in range(steps):
        grad = m.T @ (v * (1 / (1 + np.exp(-np.clip(m @ z, -30, 30))) - y))
        new = z - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


@dataclass
class Model:
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    bias: float = 30.0

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as one expression over columns that hold the statistics."""
        hit = lambda rule: reduce(lambda a, b: a & b, [(stats[n] > b) if up else (stats[n] <= b) for n, up, b in rule])
        total = reduce(lambda a, b: a + b, [F.when(hit(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.all([(x[:, names.index(n)] > b) if up else (x[:, names.index(n)] <= b) for n, up, b in rule], axis=0)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray, names: list[str]) -> Model:
    """Trees and weights from folds 0 and 1, the strength of the penalty from fold 3, then weights from all of them."""
    if not len(y):
        return Model()
    if len(set(y.tolist())) < 2:
        return Model(bias=30.0 if y[0] else -30.0)
    learn, check = fold != 3, fold == 3
    if len(set(y[learn].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        learn = check = np.ones(len(y), bool)
    rules = tree_rules(x[learn], y[learn], weight[learn], names)
    a = np.stack([holds(r, x, names) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))

    def loss(penalty: float) -> float:
        w, b = lasso(a[learn], y[learn], weight[learn], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(a[check] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(weight[check] * (y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))).sum())

    penalty = min((3e-2, 1e-2, 3e-3, 1e-3), key=loss)
    w, b = lasso(a, y, weight, penalty)
    return Model([(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4], b)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from about ``rows`` labelled documents of each class, none of which is held out. The driver gets one
    short row of statistics for each, never a text."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = labelled_sample(docs, labels, "quality", rows, scratch)
    stats = statistics(F.col("text"))
    got = sample.select("id", "y", "fold", "weight", *[c.alias(n) for n, c in stats.items()]).toPandas().sort_values(["id", "y"])
    scratch.clear()
    x = got[list(stats)].to_numpy(float).reshape(-1, len(stats))
    return fit(x, got["y"].to_numpy(float), got["fold"].to_numpy(), got["weight"].to_numpy(float), list(stats))


def mark(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, score): each row of ``docs`` as one value, so that no name can clash, and its score; a projection, without
    a shuffle. Statistics are columns of their own, so that rules that share one don't compute it again."""
    used = {n for r, _ in model.rules for n, _, _ in r}
    stats = {n: c for n, c in statistics(F.coalesce(F.col(text_col), F.lit(""))).items() if n in used}
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in stats.items()])
    return wide.select("doc", model.column({n: F.col(n) for n in stats}).alias("score"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mark(rows, model).select("doc.doc_id", "score")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Query] = {"op5_quality": op5_quality}
