"""Quality by weak supervision: simple rules vote for or against a text or abstain; expectation-maximisation estimates,
without labels, how often each vote is right among good texts and among bad ones; a text stays if the posterior
probability that it is good is a half or more. No rule decides alone, and none has to be passed.

Statistics, votes and posteriors are DataFrame functions. Votes are counted by pattern, so the estimation, on the
driver, sees at most 3^11 counts, whatever the size of the corpus. Each accuracy has a prior worth a hundredth of the
texts, so that classes which the votes don't tell apart are not made up; a vote never counts against what it says.

Edge cases: a null text has no words, an empty one neither; both fail the base (fewer than ten words, or too many in
repeated windows) and are not kept. Repeated rows are judged alike; a null id is carried along. Texts of any length are
read whole, with work in proportion to n log n of their words. Further columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, table
from .lines import let, split_lines

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Starting values and priors: share of good texts, how often a vote on a good text is for it, and on a bad one against.
SHARE, GOOD, BAD = 0.8, 0.98, 0.3
STEPS, WEIGHT = 50, 0.01


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more. Windows are sorted by hash; those with
    a neighbour of equal hash are sorted again by their words, so equal hashes of different windows do no harm."""
    window = lambda at: F.slice(words, at, width)
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))

    def shared(sorted_: Column, field: str) -> Column:
        """The entries that agree in ``field`` with the one before or after."""
        return let(sorted_, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)[field] == x[field], F.lit(False)) | F.coalesce(F.get(s, i + 1)[field] == x[field], F.lit(False))))

    hashed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(window(i)).alias("key"), i.alias("at"))))
    exact = F.sort_array(F.transform(shared(hashed, "key"), lambda x: F.struct(window(x["at"]).alias("key"), x["at"].alias("at"))))
    places = F.sort_array(F.transform(shared(exact, "key"), lambda x: x["at"]))
    covered = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))))
    return F.aggregate(covered, F.lit(0), lambda n, x: n + x)


def statistics(text: Column) -> Column:
    """What rules look at, as one value; ``text`` is not null."""
    words = F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")
    lines = F.filter(split_lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    ends = lambda w: w.endswith(".") | w.endswith("!") | w.endswith("?")
    of_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("distinct"), count(w, ends).alias("ends"), count(w, lambda x: x.rlike(r"^\p{L}+[.,;:!?]*\z")).alias("plain"),
            count(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))).alias("echoes"),
        ),
    )
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), n(r"[#*$%&|<>]").alias("n_symbols"), n(r"\p{Lu}").alias("upper"))


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (votes against, votes for), over the statistics; a rule abstains where neither holds."""
    n, chars, sym, dup, rep = _c("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lines, upper, ends, plain, distinct, echoes = _c("n_lines", "upper", "ends", "plain", "distinct", "echoes")
    return {
        "symbols": (10 * sym > n, 50 * sym <= n),
        "upper case": (10 * upper > 3 * chars, 10 * upper < chars),
        "word length": ((chars < 2 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "repeated lines": (10 * dup > 3 * lines, (dup == 0) & (lines >= 3)),
        "repeated windows": (10 * rep > n, 50 * rep <= n),
        "sentence ends": ((ends == 0) | (2 * ends > n), (50 * ends >= n) & (4 * ends <= n)),
        "plain words": (2 * plain < n, 10 * plain >= 8 * n),
        "length": (n < 30, n >= 50),
        "words a line": (n < 3 * lines, n >= 5 * lines),
        "echoes": (10 * echoes > n, 50 * echoes <= n),
        "vocabulary": ((10 * distinct <= 6 * n) & (n < 200), (10 * distinct >= 7 * n) & (n < 200)),
    }


ABSTAINS, AGAINST, FOR = 0, 1, 2


def estimate(votes: np.ndarray, count: np.ndarray, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, each rule's share of votes for a good text, each rule's share of votes against a bad one)
    by expectation-maximisation, from patterns of votes (a row each) and how often each occurs."""
    own, total = WEIGHT * count.sum() + 1, count.sum()
    share, good, bad = SHARE, np.full(votes.shape[1], GOOD), np.full(votes.shape[1], BAD)
    against, yes = votes == AGAINST, votes == FOR
    for _ in range(steps):
        p = count * posterior(votes, share, good, bad)
        q = count - p
        share = (p.sum() + 9 * own) / (total + 10 * own)
        good = (p @ yes + GOOD * own) / (p @ (yes | against) + own)
        bad = (q @ against + BAD * own) / (q @ (yes | against) + own)
        bad = np.maximum(bad, 1 - good)  # a vote never counts against what it says
    return share, good, bad


def posterior(votes: np.ndarray, share: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The probability of good of each pattern, rules being independent in each class."""
    plus, minus = np.log(good / (1 - bad)), np.log((1 - good) / bad)
    odds = np.log(share / (1 - share)) + (votes == FOR) @ plus + (votes == AGAINST) @ minus
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept) for each row;
    the posterior is null where the base failed. One scan of the texts, no shuffle of them."""
    scratch = Scratch(docs.sparkSession, "rules")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wide = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), statistics(text).alias("s")).select("doc_id", "s.w.*", "s.l.*", "s.n_symbols", "s.upper")
    voted = {k: F.when(no, AGAINST).when(yes, FOR).otherwise(ABSTAINS) for k, (no, yes) in rules().items()}
    pattern = reduce(lambda a, b: a + b, [v.cast("long") * 3**k for k, v in enumerate(voted.values())])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    five = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = scratch.write(wide.select("doc_id", *five, base.alias("base_failed"), pattern.alias("votes")), "votes")
    counted = found.where(~F.col("base_failed")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    digits = lambda codes: np.array([[c // 3**k % 3 for k in range(len(voted))] for c in codes], np.int64).reshape(-1, len(voted))
    share, good, bad = estimate(digits([r.votes for r in counted]), np.array([r.n for r in counted], float))
    digit: Callable[[int], Column] = lambda k: F.expr(f"votes DIV {3**k}") % 3
    odds = F.lit(float(np.log(share / (1 - share))))
    for k in range(len(voted)):
        odds += F.when(digit(k) == FOR, float(np.log(good[k] / (1 - bad[k])))).when(digit(k) == AGAINST, float(np.log((1 - good[k]) / bad[k]))).otherwise(0.0)
    scored = found.select("doc_id", *five, "base_failed", F.when(~F.col("base_failed"), 1 / (1 + F.exp(-odds))).alias("posterior"))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("posterior") >= least, F.lit(False)))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("posterior")


QUERIES: dict[str, Query] = {"op13_quality_rules": op13_quality_rules}
