"""Ratcliff-Obershelp text similarity. It is not symmetric: the left text is the incoming one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of the substrings that are counted, those that tell most first, and into how many columns they are hashed.
GRAMS, COLUMNS = (8, 4, 3, 2, 1), 1 << 17
#: Characters of a short text at most; ratios of pairs of these that are remembered; pairs taken side by side.
SHORT, REMEMBERED, SIDE = 128, 1 << 18, 1 << 15


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in zip(left, right)], dtype="float64")


def could_reach(left: Column, right: Column, least: float) -> Column:
    """False only where the lengths alone keep the ratio under ``least``: a lossless test before the UDF."""
    a, b = F.length(left), F.length(right)
    return 2.0 * F.least(a, b) >= least * (a + b)


def ratio_from(least: float):
    """A UDF (left, right) -> the ratio where it is ``least`` or more, else 0. Cheaper bounds are tried first, which
    never lie under the ratio, so nothing that counts is lost."""

    @F.pandas_udf(T.DoubleType())
    def found(left: pd.Series, right: pd.Series) -> pd.Series:
        out, m = [], SequenceMatcher(None)
        for a, b in zip(left, right):
            m.set_seqs((a or "").lower(), (b or "").lower())
            near = m.real_quick_ratio() >= least and m.quick_ratio() >= least
            out.append(x if near and (x := m.ratio()) >= least else 0.0)
        return pd.Series(out, dtype="float64")

    return found


def grams(text: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash columns that substrings of ``q`` characters fall into, and how many fall into each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(31)
    columns, counts = np.unique((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % COLUMNS, return_counts=True)
    return columns.astype(np.int32), counts.astype(np.int32)


def anchors(text: str) -> float:
    """At how many places of the right text a block of equal characters can be found from. The matcher doesn't look for
    blocks from characters that make up more than a hundredth of a text of 200 or more."""
    if len(text) < 200:
        return float("inf")
    return sum(n for n in Counter(text).values() if n <= len(text) // 100 + 1)


def subsequence(places: dict[str, int], size: int, text: str, need: int) -> bool:
    """Whether a text of ``size`` characters at ``places`` (a bit for each place of a character) and ``text`` have a
    common subsequence of ``need`` characters; what matches is one. Ends as soon as too few are left."""
    full = (1 << size) - 1
    free = full  # a bit that is gone: the subsequence is longer by one from that place on
    for lo in range(0, len(text), 64):
        for c in text[lo : lo + 64]:
            hit = free & places.get(c, 0)
            free = (free + hit) | (free - hit)
        free &= full
        if size - free.bit_count() + max(0, len(text) - lo - 64) < need:
            return False
    return True


def coded(texts: Sequence[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Short texts as rows of numbers from 1 on by the place of their characters in ``codes``, 0 for others and the rest."""
    each = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in texts]
    codes = np.unique(np.concatenate(each)) if codes is None else codes
    out = np.zeros((len(each), max(map(len, each))), np.int64)
    for row, x in zip(out, each):
        at = np.searchsorted(codes, x)
        row[: len(x)] = np.where(codes[np.minimum(at, len(codes) - 1)] == x, at + 1, 0) if len(codes) else 0
    return out, codes


def subsequences(left: Sequence[str], right: Sequence[str], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``subsequence`` for many pairs (left[i], right[j]) of short texts, side by side."""
    theirs, codes = coded(right)
    ours, words = coded(left, codes)[0], SHORT // 64
    bits = np.zeros((words, len(codes) + 1, len(right)), np.uint64)
    for at, column in enumerate(theirs.T):
        bits[at // 64, column, np.arange(len(right))] |= np.uint64(1 << at % 64)
    bits[:, 0] = 0
    bits, out = bits.reshape(words, -1), np.zeros(len(i), bool)
    for lo in range(0, len(i), SIDE):
        some, rows = j[lo : lo + SIDE], ours[i[lo : lo + SIDE]] * len(right)
        low = high = np.full(len(some), 0xFFFFFFFFFFFFFFFF, np.uint64)  # as in ``subsequence``, in two words
        for column in rows.T:
            at = column + some
            hit, more = bits[0].take(at), bits[1].take(at)
            hit &= low
            more &= high
            first = low + hit
            second = high + more
            second += first < hit
            low, high = first | (low ^ hit), second | (high ^ more)
        out[lo : lo + SIDE] = 128 - (np.bitwise_count(low).astype(int) + np.bitwise_count(high)) >= need[lo : lo + SIDE]
    return out


class Texts:
    """Right texts, to be held against left ones one after the other: each with what its bounds need, made when first
    asked for. Texts can be added and replaced."""

    def __init__(self, texts: Iterable[str] = ()):
        self.texts: list[str] = []
        self.sizes, self.rare = np.zeros(0, np.int64), np.zeros(0)
        self.kept: list[dict] = []
        self.dense = None
        self.extend(texts)

    def extend(self, texts: Iterable[str]) -> None:
        more = [x.lower() for x in texts]
        self.texts += more
        self.kept += [{} for _ in more]
        self.sizes = np.append(self.sizes, np.array([len(x) for x in more], np.int64))
        self.rare = np.append(self.rare, np.array([anchors(x) for x in more], float))

    def replace(self, j: int, text: str) -> None:
        self.texts[j], self.kept[j] = text.lower(), {}
        self.sizes[j], self.rare[j] = len(self.texts[j]), anchors(self.texts[j])
    def grams(self, j: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        if q not in self.kept[j]:
            self.kept[j][q] = grams(self.texts[j], q)
        return self.kept[j][q]

    def places(self, j: int) -> dict[str, int]:
        if "places" not in self.kept[j]:
            at: dict[str, int] = {}
            codes = np.frombuffer(self.texts[j].encode("utf-32-le", "surrogatepass"), "<u4")
            for code in np.unique(codes):
                at[chr(code)] = int.from_bytes(np.packbits(codes == code, bitorder="little").tobytes(), "little")
            self.kept[j]["places"] = at
        return self.kept[j]["places"]

    def reach(self, text: str, least: float, wanted: np.ndarray | None = None) -> np.ndarray:
        """Places of the texts (of ``wanted`` ones) that ``text``, in lower case, as the left one may be like by ``least``.

        A ratio says how many characters m match, in k blocks. Each block but those at the front of a stretch holds an
        anchor of the right text, so k <= 2 * anchors + 1; and between two blocks a character does not match, so
        k <= len(a) + len(b) - 2 * m + 1. A block of n characters has n - q + 1 substrings of q in common, so the texts
        have m - k * (q - 1) or more. Hashing them into columns only adds to what they seem to have in common. What
        matches is also a common subsequence, of m characters. Texts that fail any of this can't reach ``least``; the
        others, hardly more than those that do, are to be matched."""
        total = self.sizes + len(text)
        able = 2 * np.minimum(self.sizes, len(text)) >= least * total
        m = np.ceil(least * total / 2 - 1e-9)
        k = np.minimum(2 * self.rare + 1, total - 2 * m + 1)
        js = np.flatnonzero(able if wanted is None else able & wanted)
        for q in GRAMS:
            need = m[js] - k[js] * (q - 1)
            asked, need = js[need > 0], need[need > 0]
            if not len(asked):
                continue
            if self.dense is None:
                self.dense = np.zeros(COLUMNS, np.int32)
            columns, counts = grams(text, q)
            self.dense[columns] = counts
            theirs = [self.grams(j, q) for j in asked]
            common = np.minimum(self.dense[np.concatenate([c for c, _ in theirs])], np.concatenate([n for _, n in theirs]))
            ends = np.cumsum([len(c) for c, _ in theirs])
            sums = np.append(0, np.cumsum(common, dtype=np.int64))
            common = sums[ends] - sums[np.append(0, ends[:-1])]
            self.dense[columns] = 0
            js = np.setdiff1d(js, asked[common < need], assume_unique=True)
        return np.array([j for j in js if subsequence(self.places(j), int(self.sizes[j]), text, int(m[j]))], np.int64)


def near_pairs(left: Sequence[str], right: Sequence[str], least: float, wanted: np.ndarray | None = None, known: dict | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs (left[i], right[j]) with a ratio of ``least`` or more; of ``wanted`` ones, where given.
    Pairs that bounds (``Texts.reach``) leave are matched. ``known``: ratios of pairs of short texts, to be shared by
    calls in which the same texts come again."""
    a, theirs, known = [x.lower() for x in left], Texts(right), {} if known is None else known
    if not a or not theirs.texts:
        return
    wanted = np.ones((len(a), len(theirs.texts)), bool) if wanted is None else wanted.copy()
    sizes, by_right = np.array([len(x) for x in a]), {}
    ours, others = np.flatnonzero(sizes <= SHORT), np.flatnonzero(theirs.sizes <= SHORT)
    if len(ours) and len(others):
        total = sizes[ours][:, None] + theirs.sizes[others]
        able = wanted[np.ix_(ours, others)] & (2 * np.minimum(sizes[ours][:, None], theirs.sizes[others]) >= least * total)
        wanted[np.ix_(ours, others)] = False
        i, j = np.nonzero(able)
        reached = subsequences([a[k] for k in ours], [theirs.texts[k] for k in others], i, j, np.ceil(least * total[i, j] / 2 - 1e-9))
        for x, y in zip(ours[i[reached]].tolist(), others[j[reached]].tolist()):
            by_right.setdefault(y, []).append(x)
    for i, x in enumerate(a):
        if wanted[i].any():
            for j in theirs.reach(x, least, wanted[i]):
                by_right.setdefault(int(j), []).append(i)
    matcher = SequenceMatcher(None)
    for j, some in sorted(by_right.items()):
        b, set_ = theirs.texts[j], False
        for i in some:
            short = max(len(a[i]), len(b)) <= SHORT
            x = known.get((a[i], b)) if short else None
            if x is None:
                if not set_:
                    matcher.set_seq2(b)
                    set_ = True
                matcher.set_seq1(a[i])
                x = matcher.ratio()
                if short and len(known) < REMEMBERED:
                    known[a[i], b] = x
            if x >= least:
                yield i, j, x
