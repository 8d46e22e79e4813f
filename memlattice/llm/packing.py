"""Packing of tokenized documents into fixed windows by swap-based local search between underfull bins.

Pieces of one length are interchangeable, so a search sees only how many pieces of each length there are and handles
all bins of equal content at once. It starts from a first fit of the lengths in the order of a hash and exchanges pieces
until as many bins are empty as can be: moves and exchanges of one or two pieces for one or two, each of which raises
the sum of squared fills. Groups of pieces are searched by tasks of their own, and their emptiest bins again together, so
neither the driver nor a task sees more than a bounded number of pieces.

Edge cases: a null or empty text has no tokens but its end mark, a piece of length 1. A text longer than the window is
cut into full pieces after a first one that takes the rest. Repeated rows and rows without an id are packed like any
other. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, table

Bin = tuple[tuple[int, int], ...]  #: (length, how many) of what a bin holds, longest first
#: Pieces that a task searches over, about; underfull bins of a group that are searched again with those of others, and
#: of how many groups at a time; orders that a search starts from, one after the other, until one ends at the bound.
GROUP, OPEN, FAN, STARTS = 16_000, 512, 8, 2


def byte_level() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizers file at ``path``, without special tokens.

    A byte-level BPE file whose merges are in order of their ids is the same function as the same vocabulary as ranks,
    which tiktoken encodes four times faster; texts with characters on which the two libraries' Unicode tables could
    differ, or with the spelling of an added token, and all other files, are left to tokenizers itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in special}
    if not plain or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return slow
    import tiktoken

    stand = byte_level()
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={bytes(stand[c] for c in k): v for k, v in vocab.items()}, special_tokens={}).encode_ordinary
    unusual = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xac\xae-ɏ‘-”]")  # spellings are looked for apart: faster than by choice
    return lambda text: slow(text) if unusual.search(text) or any(t in text for t in special) else fast(text)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document; ``path``: the tokenizers file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("byte_bpe_50k.json")
        kept = sys.__dict__.setdefault("_memlattice_encoders", {})  # one for each worker process
        if at not in kept:
            kept[at] = encoder(at)
        encode = kept[at]
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = array("I", encode(text.as_py()) if text.is_valid else [])
                ids.append(end)
                if sys.byteorder == "big":
                    ids.byteswap()
                raw, n = memoryview(ids).cast("B"), len(ids)
                first = (n - 1) % capacity + 1
                for k, lo in enumerate([0, *range(first, n, capacity)]):
                    hi = first if k == 0 else lo + capacity
                    out.append((i, k, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi])))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fill(b: Bin) -> int:
    return sum(n * k for n, k in b)


def put(b: Bin, length: int, n: int = 1) -> Bin:
    c = Counter(dict(b))
    c[length] += n
    return tuple(sorted(((x, k) for x, k in c.items() if k), reverse=True))


def first_fit(counts: dict[int, int], capacity: int, seed: int = 0) -> Counter[Bin]:
    """First fit over the lengths in the order of a hash: how many bins there are of each content. A length takes all
    bins of a content at once, so there are no more than a few contents for each length."""
    full: Counter[Bin] = Counter()
    open_: list[tuple[int, Bin, int]] = []  # what is left free, content, how many
    for length in sorted(counts, key=lambda n: (zlib.crc32(n.to_bytes(8, "little"), seed), n)):
        left, after = counts[length], []
        for free, b, n in [*open_, (capacity, (), left)]:
            each = free // length
            for k, bins in ((each, min(n, left // each)), (left % each if left < n * each else 0, 1)) if each and left else ():
                if k and bins:
                    after.append((free - k * length, put(b, length, k), bins))
                    left, n = left - k * bins, n - bins
            if n and b:
                after.append((free, b, n))
        open_ = [x for x in after if x[0]]
        full.update({b: n for free, b, n in after if not free})
    for _, b, n in open_:
        full[b] += n
    return full


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A bound below on the number of bins: by the tokens, and by the pieces of which no two share a bin."""
    return max(-(-sum(n * k for n, k in counts.items()) // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))


def two_of(b: Bin) -> list[tuple[int, int]]:
    """The pairs of lengths that a bin can give at once."""
    return [(x, y) for i, (x, k) in enumerate(b) for y, _ in b[i:] if x != y or k > 1]


def some_of(b: Bin) -> list[tuple[int, ...]]:
    """What of a bin an exchange can take: one piece, or two."""
    return [*((x,) for x, _ in b), *two_of(b)]


class Search:
    """The local search's bins: how many there are of each content, the underfull ones in order of their fill, and the
    pieces in underfull contents, one or two of a bin, by their reach: their length and what their bin has free,
    together the most that can take their place."""

    def __init__(self, bins: Counter[Bin], capacity: int):
        self.capacity, self.bins = capacity, Counter()
        self.order: list[tuple[int, Bin]] = []
        self.reach: list[list[tuple[int, tuple[int, ...], Bin]]] = [[] for _ in range(capacity + 1)]  # by fill
        # The least and the largest fill at each reach; beyond the capacity there is none.
        self.low, self.top = np.full(2 * capacity + 1, capacity), np.full(2 * capacity + 1, -1)
        for b, n in bins.items():
            self.add(b, n)

    def add(self, b: Bin, n: int) -> None:
        """Adds ``n`` bins of this content, or takes away -n."""
        if not b or not n:
            return
        had, size = self.bins[b], fill(b)
        self.bins[b] = had + n
        if not had and size < self.capacity:
            insort(self.order, (size, b))
            for x in some_of(b):
                at = sum(x) + self.capacity - size
                insort(self.reach[at], (size, x, b))
                self.bounded(at)
        if not self.bins[b]:
            del self.bins[b]
            if size < self.capacity:
                del self.order[bisect_left(self.order, (size, b))]
                for x in some_of(b):
                    at = sum(x) + self.capacity - size
                    own = self.reach[at]
                    del own[bisect_left(own, (size, x, b))]
                    self.bounded(at)

    def bounded(self, at: int) -> None:
        own = self.reach[at]
        self.low[at], self.top[at] = (own[0][0], own[-1][0]) if own else (self.capacity, -1)

    def likely(self, sizes: np.ndarray, own: int) -> Iterator[tuple[int, int]]:
        """(slack, which of the sizes): where the least and the largest fill at a reach leave room for a taker, in
        order. Most slacks have none, so they are looked through in arrays."""
        lo = 0
        for hi in (64, 512, self.capacity):
            slack = np.arange(lo, min(hi, self.capacity))
            at = slack[:, None] + sizes
            found = (self.top[at] >= own) & (self.low[at] < self.capacity - slack[:, None])
            for k in np.flatnonzero(found).tolist():
                yield lo + k // len(sizes), k % len(sizes)
            lo = max(lo, min(hi, self.capacity))

    def partner(self, giver: Bin) -> tuple[Bin, list[int], list[int]] | None:
        """(taker, what it gets, what it gives back): a move, or an exchange of one or two for one or two, with a bin at
        least as full as the giver, if there is any; one that leaves the taker as little free as can be."""
        own, alone = fill(giver), self.bins[giver] < 2
        gives = some_of(giver)
        for a, _ in giver:
            k = bisect_left(self.order, (self.capacity - a + 1,)) - 1
            while k >= 0 and self.order[k][0] >= own:
                if self.order[k][1] != giver or not alone:
                    return self.order[k][1], [a], []
                k -= 1
        sizes = np.array([sum(there) for there in gives])
        for slack, which in self.likely(sizes, own):
            fit = self.reach[int(sizes[which]) + slack]  # the emptiest taker gains the most
            for k in range(bisect_left(fit, (own,)), len(fit)):
                full, back, taker = fit[k]
                if self.capacity - full <= slack:
                    break
                if taker != giver or not alone:
                    return taker, list(gives[which]), list(back)
        return None


def broken(search: Search, sums: dict[int, list[tuple[Bin, int, int]]]) -> tuple[Bin, Bin, int, int, int] | None:
    """(giver, taker, piece, two pieces): the longest piece of the emptiest bin that a full bin has two pieces for, of
    the same sum. The fills stay as they are, but what the underfull bin holds is in smaller pieces, which more
    exchanges have use for."""
    for _, giver in search.order:
        for x, _ in giver:
            found = sums.get(x, [])
            while found:
                taker, y, z = found[-1]
                if search.bins[taker]:
                    return giver, taker, x, y, z
                found.pop()
    return None


def improve(bins: Counter[Bin], capacity: int) -> tuple[Counter[Bin], int]:
    """(bins, exchanges): local search over underfull bins. The emptiest give and fuller ones take, so the sum of squared
    fills rises with each exchange until a giver is empty and its bin goes. Givers are the emptiest contents, twice as
    many as there are bins too many, and eight. Where none has an exchange, one with a full bin, two pieces for one of
    the same length, breaks up what the emptiest holds. It ends when there are no more bins than there must be, or there
    is neither."""
    search, counts, made = Search(bins, capacity), Counter(), 0
    for b, n in search.bins.items():
        for length, k in b:
            counts[length] += k * n
    number, least = sum(search.bins.values()), fewest(counts, capacity)
    stuck: set[Bin] = set()  # givers without an exchange; tried again when no other has one
    since, sums = 0, None

    def exchange(giver: Bin, taker: Bin, there: list[int], back: list[int], n: int) -> int:
        """Makes the exchange between ``n`` pairs of such bins; how many givers that empties."""
        give, take = giver, taker
        for x in there:
            give, take = put(give, x, -1), put(take, x)
        for x in back:
            give, take = put(give, x), put(take, x, -1)
        for b, k in ((giver, -n), (taker, -n), (take, n), (give, n)):
            search.add(b, k)
        return 0 if give else n

    while number > least:
        for _, giver in search.order[: 2 * (number - least) + 8]:
            if giver not in stuck:
                if found := search.partner(giver):
                    break
                stuck.add(giver)
        else:
            if since:
                stuck, since = set(), 0
                continue
            if sums is None:
                sums = {}
                for b in sorted(b for b in search.bins if fill(b) == capacity):
                    for y, z in two_of(b):
                        sums.setdefault(y + z, []).append((b, y, z))
            part = broken(search, sums)
            if part is None:
                break
            giver, taker, x, y, z = part
            exchange(giver, taker, [x], [y, z], 1)
            stuck, made = set(), made + 1
            continue
        taker, there, back = found
        n = search.bins[giver] // 2 if giver == taker else min(search.bins[giver], search.bins[taker])
        number -= exchange(giver, taker, there, back, n)
        since, made = since + 1, made + n
    return search.bins, made


def packed(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """The fewest bins that the search ends with, from a first fit in one order or another."""
    best, least = None, fewest(counts, capacity)
    for seed in range(STARTS):
        bins, _ = improve(first_fit(counts, capacity, seed), capacity)
        if best is None or sum(bins.values()) < sum(best.values()):
            best = bins
        if sum(best.values()) <= least:
            break
    return best


def held(number: np.ndarray, length: np.ndarray) -> Counter[Bin]:
    """What the bins of these numbers hold."""
    by: dict[int, Counter[int]] = {}
    for n, x in zip(number.tolist(), length.tolist()):
        by.setdefault(n, Counter())[x] += 1
    return Counter(tuple(sorted(c.items(), reverse=True)) for c in by.values())


def dealt(length: np.ndarray, bins: Counter[Bin]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces of one length take their places in order."""
    number, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    next_ = dict(zip(sizes.tolist(), first.tolist()))
    at = 0
    for b, n in sorted(bins.items()):
        for _ in range(n):
            lo = 0
            for x, k in b:
                mine = order[next_[x] : next_[x] + k]
                number[mine], offset[mine] = at, lo + x * np.arange(k)
                next_[x] += k
                lo += x * k
            at += 1
    return number, offset


KEPT = ["doc_id", "piece", "start", "length", "ids_crc32"]
KIND = "doc_id long, piece int, start long, length long, ids_crc32 long, group long, sequence_id long, offset long, open boolean"


def searched(rows: DataFrame, capacity: int, level: int) -> DataFrame:
    """Each group's pieces in its bins: from the bins that they lie in, if they do, else from a first fit. ``open``:
    whether the bin goes on to the next level, as do the OPEN emptiest of a group that are underfull."""

    def run(table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")]
        table = table.sort_by(order)
        length, group = table.column("length").to_numpy(), table.column("group")[0].as_py()
        if level:
            bins, _ = improve(held(table.column("sequence_id").to_numpy(), length), capacity)
        else:
            bins = packed(Counter(length.tolist()), capacity)
        number, offset = dealt(length, bins)
        fills = np.bincount(number, length).astype(np.int64)
        emptiest = np.argsort(fills, kind="stable")[:OPEN]
        goes_on = np.isin(number, emptiest[fills[emptiest] < capacity])
        ids = (level << 56) + (group << 24) + number
        cols = [table.column(c) for c in KEPT] + [table.column("group"), pa.array(ids), pa.array(offset), pa.array(goes_on)]
        return pa.Table.from_arrays(cols, names=[*KEPT, "group", "sequence_id", "offset", "open"])

    return rows.groupBy("group").applyInArrow(run, KIND)


def pack(pieces: DataFrame, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. Pieces are dealt into groups of about GROUP, each searched by a task of
    its own; then the emptiest bins of FAN groups are searched together, and so on until one group is left."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.write(pieces, "pieces")
    groups, level = max(1, -(-pieces.count() // GROUP)), 0
    rows = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    done = []
    while True:
        found = scratch.write(searched(rows, capacity, level), f"level{level}")
        if groups == 1:
            done.append(found)
            break
        done.append(found.where("NOT open"))
        rows = found.where("open").drop("offset", "open").withColumn("group", F.floor(F.col("group") / FAN))
        groups, level = -(-groups // FAN), level + 1
    return reduce(DataFrame.unionByName, done).select(*KEPT, "sequence_id", "offset")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(tokenize(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {"op6_best_fit_packing": op6_best_fit_packing}
