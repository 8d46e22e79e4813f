"""Source divergence audit: how far the sources of a language differ in what they say, and by which terms.

Each task counts its documents' terms, many texts at a time in arrays, into radix tries over bytes, one a language, whose
leaves have a counter for each source. A trie's walk gives its leaves in the order of UTF-8, so tries are merged by ranges of prefixes: leaves are dealt
by (language, term) ranges and sorted, and a task adds up those of one term as they stream by. Terms that too few
documents hold go there. A second walk over what is kept turns counters into shares and adds up the divergence of each
two sources; the most telling terms of each source are selected on the way, ties in the order of the terms.

All arithmetic is in whole numbers. Edge cases: null texts, languages and sources are empty ones; a group without terms
has a share for each kept term like any other; a language without kept terms gives pairs of value 0 and no terms.
Repeated rows and rows without an id are documents of their own. Texts of any length are read whole, a part at a time.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import itertools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Query, Scratch, table

UNIT = 1_000_000_000
#: Bytes of texts whose terms a task counts at once, and counts (of sources and of documents) that its tries hold before
#: they are handed on; bytes of a longer text that are cut into terms at a time.
POUR, HOLD, STEP = 1 << 23, 1_500_000, 1 << 20
#: Cells of a table of terms and sources, and of sums of pairs, that a task holds.
CELLS = 1 << 22
#: Groups whose names and sums are broadcast at a time; languages are dealt into rounds of no more (or one language).
GROUPS = 200_000
#: Bytes of terms as they are compared (A-Z in lower case), and blanks for all others.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """A radix trie over bytes; a node is [label, children by first byte, leaf], a leaf what ``make`` gives."""

    def __init__(self, make: Callable = dict):
        self.root: list = [b"", {}, None]
        self.make = make

    def leaf(self, term: bytes):
        """The leaf of ``term``, which is made if there is none."""
        node, at = self.root, 0
        while at < len(term):
            kid = node[1].get(term[at])
            if kid is None:
                new = self.make()
                node[1][term[at]] = [term[at:], {}, new]
                return new
            label = kid[0]
            if not term.startswith(label, at):
                k = 1
                while k < len(label) and term[at + k : at + k + 1] == label[k : k + 1]:
                    k += 1
                kid[0] = label[k:]
                kid = node[1][term[at]] = [label[:k], {label[k]: kid}, None]
                label = kid[0]
            node, at = kid, at + len(label)
        if node[2] is None:
            node[2] = self.make()
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, Any]]:
        """Terms and leaves in the order of the terms' bytes."""
        left = [(b"", self.root)]
        while left:
            before, (label, kids, leaf) = left.pop()
            term = before + label
            if leaf is not None:
                yield term, leaf
            if kids:
                left += [(term, kids[b]) for b in sorted(kids, reverse=True)]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in turn, a part of it at a time."""
    plain, at = text.translate(LETTERS), 0
    while len(plain) - at > STEP:
        end = plain.find(b" ", at + STEP)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


DOCS = -1  #: in a leaf, the counter of documents


class Leaves:
    """A language's trie, whose leaves are numbers, and what is counted at them: arrays of (leaf, source or DOCS, count),
    an entry once or more."""

    def __init__(self):
        self.trie = Trie(itertools.count().__next__)
        self.entries: list[np.ndarray] = []

    def add(self, terms: list[bytes], place: np.ndarray, key: np.ndarray, n: np.ndarray) -> int:
        """Counts ``n`` for sources or DOCS at terms, given by their place among ``terms``; how many entries."""
        order = sorted(range(len(terms)), key=terms.__getitem__)  # neighbours share their way down
        leaf = np.empty(len(terms), np.int64)
        leaf[order] = np.fromiter(map(self.trie.leaf, map(terms.__getitem__, order)), np.int64, len(terms))
        self.entries.append(np.stack([leaf[place], key, n]))
        return len(place)

    def given(self, lang: str) -> Iterator[pa.RecordBatch]:
        walk = list(self.trie.walk())
        rank = np.empty(len(walk), np.int64)
        rank[[k for _, k in walk]] = np.arange(len(walk))
        leaf, key, n = np.concatenate(self.entries, axis=1)
        leaf = rank[leaf]
        order = np.lexsort((key, leaf))  # a leaf's documents come first
        leaf, key, n = leaf[order], key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (key[1:] != key[:-1]))))
        leaf, key, n = leaf[first], key[first], np.add.reduceat(n, first)
        docs, own = n[key == DOCS], key != DOCS
        pairs, ends = np.stack([key[own], n[own]], axis=1), np.searchsorted(leaf[own], np.arange(len(walk) + 1))
        for lo in range(0, len(walk), 1 << 14):
            rows, at = walk[lo : lo + (1 << 14)], ends[lo : lo + (1 << 14) + 1]
            yield packed(pa.array([lang] * len(rows), pa.string()), pa.array([t for t, _ in rows], pa.binary()), docs[lo : lo + len(rows)], pairs[at[0] : at[-1]], np.diff(at))


class Counts:
    """A task's tries. The terms of many texts are counted in arrays first, which are poured into the tries in bulk."""

    def __init__(self):
        self.tries: dict[str, Leaves] = defaultdict(Leaves)
        self.fresh: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        self.new = self.held = 0

    def add(self, lang: str, source: int, text: bytes) -> None:
        if len(text) > STEP:
            own: Counter[bytes] = Counter()
            for part in terms(text):
                own.update(part)
            if own:
                n = len(own)
                key = np.concatenate((np.full(n, DOCS), np.full(n, source)))
                sums = np.concatenate((np.ones(n, np.int64), np.fromiter(own.values(), np.int64, n)))
                self.held += self.tries[lang].add(list(own), np.tile(np.arange(n), 2), key, sums)
            return
        self.fresh[lang].append((source, text))
        self.new += len(text)
        if self.new > POUR:
            self.pour()

    def pour(self) -> None:
        for lang, fresh in self.fresh.items():
            fresh.sort(key=itemgetter(0))  # so that a term's documents are in order of their sources
            source = np.array([s for s, _ in fresh], np.int64)
            data = np.frombuffer(b" ".join(t for _, t in fresh).translate(LETTERS) + b" ", np.uint8)
            letter = data != 32
            edges = np.flatnonzero(np.diff(letter, prepend=False))  # a term's begin and end in turn
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            places = np.concatenate(([0], np.cumsum(ends - starts)))
            found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[letter])]).dictionary_encode()
            bounds = np.cumsum([len(t) + 1 for _, t in fresh])
            # Terms by document, sorted: a run of them is a term's count in a document.
            both = found.indices.to_numpy().astype(np.int64) * len(fresh) + np.searchsorted(bounds, starts, "right")
            both.sort()
            term, doc = np.divmod(both, len(fresh))
            key = source[doc]
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (key[1:] != key[:-1]))))
            held = np.bincount(term[np.concatenate(([True], both[1:] != both[:-1]))])
            place = np.concatenate((np.arange(len(held)), term[first]))
            key = np.concatenate((np.full(len(held), DOCS), key[first]))
            n = np.concatenate((held, np.diff(np.append(first, len(term)))))
            self.held += self.tries[lang].add(found.dictionary.to_pylist(), place, key, n)
        self.fresh.clear()
        self.new = 0

    def given(self) -> Iterator[pa.RecordBatch]:
        """The tries' leaves; afterwards there are none."""
        self.pour()
        for lang, leaves in sorted(self.tries.items()):
            yield from leaves.given(lang)
        self.tries.clear()
        self.held = 0


KIND = "lang string, term binary, docs long, leaf binary"


def counted(docs: DataFrame, at: dict[tuple[str, str], int]) -> DataFrame:
    """(lang, term, docs, leaf): the leaves of every task's tries. ``docs``: (lang, source, text: binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = Counts(), shared.value
        gc.disable()  # tries have no cycles, and many objects to look through for some
        try:
            for b in batches:
                for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                    counts.add(lang, number[lang, source], text.as_py())
                    if counts.held > HOLD:
                        yield from counts.given()
            yield from counts.given()
        finally:
            gc.enable()

    return docs.mapInArrow(run, KIND)


def packed(lang: pa.Array, term: pa.Array, docs: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Leaves as rows; ``pairs``: (source, count) of all of them, ``sizes`` of each."""
    ends = np.concatenate(([0], np.cumsum(16 * sizes))).astype(np.int32)
    leaf = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(pairs, np.int64))])
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs, pa.int64()), leaf], names=["lang", "term", "docs", "leaf"])


def pairs_of(leaf: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((source, count) of all leaves one after the other, how many each has)."""
    return np.frombuffer(b"".join(leaf.to_pylist()), np.int64).reshape(-1, 2), pc.binary_length(leaf).to_numpy() // 16


def starts_of(rows: pa.Table) -> np.ndarray:
    """Where each term begins in sorted leaves."""
    same = [pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, len(rows) - 1)).to_numpy() for c in ("lang", "term")]
    return np.flatnonzero(np.concatenate(([True], ~(same[0] & same[1]))))


def added_up(rows: pa.Table, least: int) -> pa.RecordBatch:
    """The sum of each term's leaves, for terms that ``least`` documents hold or more."""
    rows = rows.combine_chunks()
    starts = starts_of(rows)
    docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    kept = docs >= least
    mine = rows.filter(pa.array(kept[group]))
    pairs, sizes = pairs_of(mine.column("leaf"))
    place = np.repeat((np.cumsum(kept) - 1)[group[kept[group]]], sizes)
    order = np.lexsort((pairs[:, 0], place))
    pairs, place = pairs[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (pairs[1:, 0] != pairs[:-1, 0])))) if len(pairs) else np.zeros(0, np.int64)
    sums = np.stack([pairs[first, 0], np.add.reduceat(pairs[:, 1], first) if len(first) else pairs[:, 1]], axis=1)
    keys = rows.select(["lang", "term"]).take(pa.array(starts[kept])).combine_chunks().to_batches()
    lang, term = (keys[0].column(c) if keys else pa.array([], k) for c, k in (("lang", pa.string()), ("term", pa.binary())))
    return packed(lang, term, docs[kept], sums, np.bincount(place[first], minlength=int(kept.sum())))


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, term, docs, leaf): the leaves of each term added up, of terms that ``least`` documents hold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the leaves of the last term so far, which may go on
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if left is None else pa.concat_tables([left, rows])
            last = int(starts_of(rows)[-1]) if len(rows) else 0
            if last:
                yield added_up(rows.slice(0, last), least)
            left = rows.slice(last)
        if left is not None and len(left):
            yield added_up(left, least)

    return parts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, KIND)


def cells(leaf: pa.Array, width: int) -> np.ndarray:
    """Counts of each row's term (down) by source (across)."""
    out = np.zeros((len(leaf), width), np.int64)
    pairs, sizes = pairs_of(leaf)
    out[np.repeat(np.arange(len(leaf)), sizes), pairs[:, 0]] = pairs[:, 1]
    return out


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / total) by long division, three digits at a time, so that no step leaves 64 bits."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Best:
    """The ``top`` terms of one group so far, by value and then by their bytes."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def add(self, value: np.ndarray, term: list[bytes], where: np.ndarray) -> None:
        if len(where) > self.top:
            where = where[value[where] >= np.partition(value[where], -self.top)[-self.top]]
        self.rows = sorted([*self.rows, *((-int(value[k]), term[k]) for k in where)])[: self.top]


def walked(kept: DataFrame, groups: dict[str, np.ndarray], sizes: dict[str, int], top: int) -> DataFrame:
    """(lang, a, b, term, value): sums of each two sources a and b over a task's terms, and a task's best terms of each
    source a, where b is null. ``groups``: each language's sums of counts by source; ``sizes``: its number of terms."""
    shared = kept.sparkSession.sparkContext.broadcast((groups, sizes))

    def rows(lang: str, a, b, term, value) -> pa.RecordBatch:
        n = len(value)
        cols = [pa.array([lang] * n, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(term, pa.binary()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "term", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = shared.value
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], Best] = defaultdict(lambda: Best(top))
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = batch.filter(pa.array(langs == lang))
                n, width = total[lang], len(total[lang])
                step = max(1, CELLS // width)
                for lo in range(0, own.num_rows, step):
                    part = own.slice(lo, step)
                    count, term = cells(part.column("leaf"), width), part.column("term").to_pylist()
                    p, whole = shares(count, n + number[lang]), shares(count.sum(axis=1), n.sum() + number[lang])
                    for a in range(width):
                        mine = apart(p[:, a : a + 1], p).sum(axis=0)
                        if width * width > CELLS:  # too many sums to hold: they are handed on as they are
                            yield rows(lang, [a] * width, np.arange(width), [None] * width, mine)
                        else:
                            sums.setdefault(lang, np.zeros((width, width), np.int64))[a] += mine
                        telling = np.flatnonzero((count[:, a] > 0) & (p[:, a] > whole))
                        if len(telling):
                            best[lang, a].add(apart(p[:, a], whole), term, telling)
        for lang, x in sums.items():
            a, b = np.indices(x.shape)
            yield rows(lang, a.ravel(), b.ravel(), [None] * x.size, x.ravel())
        for (lang, a), x in best.items():
            yield rows(lang, [a] * len(x.rows), [None] * len(x.rows), [t for _, t in x.rows], [-v for v, _ in x.rows])

    return kept.mapInArrow(run, "lang string, a long, b long, term binary, value long")


def audit(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of a language and source, the divergence from each other
    source of the language (part ``pair``) and the ``top`` terms that set it apart from the language (part ``term``).

    Broadcast are the groups' names and sums, at most GROUPS at a time; a language of more is a round of its own, whose
    result has a row for each two of its sources."""
    scratch = Scratch(docs.sparkSession, "divergence")
    read = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")).alias
    src = docs.select(read(lang_col)("lang"), read(source_col)("source"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = scratch.write(src.select("lang", "source").distinct().withColumn("at", place), "groups")
    rounds, room = [], 0
    for r in groups.groupBy("lang").count().orderBy("lang").toLocalIterator():
        if room < r["count"]:
            rounds.append([])
            room = GROUPS
        rounds[-1].append(r.lang)
        room -= r["count"]
    found = docs.sparkSession.createDataFrame([], "lang string, a long, b long, term binary, value long")
    for k, langs in enumerate(rounds):
        mine = (lambda x: x.where(F.col("lang").isin(langs))) if len(rounds) > 1 else (lambda x: x)
        at = {(r.lang, r.source): r["at"] for r in mine(groups).collect()}
        parts = scratch.write(counted(mine(src), at), f"leaves{k}")
        kept = scratch.write(merged(parts, least), f"kept{k}")
        scratch.drop(f"leaves{k}")

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], int] = defaultdict(int)
            for b in batches:
                langs = np.array(b.column("lang").to_pylist(), object)
                for lang in dict.fromkeys(langs.tolist()):
                    own = b.filter(pa.array(langs == lang)).column("leaf")
                    pairs, _ = pairs_of(own)
                    sums[lang, DOCS] += len(own)
                    for s in np.unique(pairs[:, 0]).tolist():
                        sums[lang, s] += int(pairs[pairs[:, 0] == s, 1].sum())
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int64()), pa.array([sums[x] for x in keys], pa.int64())], names=["lang", "at", "n"])

        total = {(r.lang, r["at"]): r.n for r in kept.mapInArrow(added, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()}
        width = Counter(lang for lang, _ in at)
        by = {lang: np.array([total.get((lang, s), 0) for s in range(n)], np.int64) for lang, n in width.items()}
        found = found.unionByName(walked(kept, by, {lang: total.get((lang, DOCS), 0) for lang in width}, top))
    found = scratch.write(found, "found")
    sums = found.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one, two = groups.select("lang", "source", F.col("at").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    told = found.where("b IS NULL").join(one, ["lang", "a"])
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(told.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op12_source_divergence": op12_source_divergence}

SQL = {
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), grp AS (SELECT DISTINCT lang, source FROM docs),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), cnt AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (t.n + s.v) AS p
  FROM total t JOIN kept k USING (lang) JOIN size s USING (lang)
  LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (max(n) + max(v)) AS q
  FROM cnt JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) USING (lang) JOIN size USING (lang)
  GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), told AS (
  SELECT p.lang, p.source, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM told
) WHERE rank <= 200
"""
}
