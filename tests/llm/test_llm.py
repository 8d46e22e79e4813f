"""The corpus operators against brute force, and their defined results in edge cases."""

import struct
import zlib
from collections import Counter
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import langid, lines, packing, pieces, quality, sharding, simhash, topk, toxicity, vectors
from memlattice.llm.common import Scratch, connected_components, gapless_rank, spanning

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, id string, score string, fold string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z", "w") for i, t in rows], DOCS)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same text"), (4, "same text"), (None, "no id"), (5, LONG), (6, "¿Ñandú?"), (7, "\n\n\n")]


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- shared helpers


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = Random(seed)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    got = {x.node: x.comp for x in connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    want = union_find(300, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_gapless_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = gapless_rank(df, "k", "r", [F.col("id")], Scratch(spark, "t"), "s", 1667, 100).collect()
    for k in range(3):
        own = [x.r for x in got if x.k == k]
        assert sorted(own) == list(range(len(own)))


# --- 1 language


def test_language(spark):
    rows = [(i, f"the house and the garden number {i} of the town", "en") for i in range(60)] + [(100 + i, f"das haus und der garten nummer {i} von der stadt", "de") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    assert set(model.names) == {"en", "de"}
    odd = docs(spark, [*ODD, (50, "12345 !!"), (51, "das ist der garten")])
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (50, "und"), (51, "de")} <= got
    assert langid.predict(odd, model).count() == len(ODD) + 2
    scores = [r.score for r in langid.predict(odd, model).collect()]
    assert min(scores) == 0.0 and max(scores) <= 1.0
    assert langid.predict(odd.limit(0), model).count() == 0


def test_language_without_labels(spark):
    model = langid.train(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs(spark, ODD), model).collect()} == {"und"}


def test_language_rejects_what_is_far(spark):
    rows = [(i, f"the house and the garden number of the town {'x' * (i % 3)}", "en") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(docs(spark, [(1, "qzxv kkkj wqqz"), (2, "the house and the garden number of the town x")]), model).orderBy("doc_id").collect()
    assert got[0].rejected and not got[1].rejected and got[0].lang_pred == "en"


# --- 2 simhash


def brute_fingerprint(text, words=4):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    fps = {(r.id, r.fp % (1 << 64)) for r in got}
    assert fps == {(i, brute_fingerprint(t)) for i, t in ODD}
    assert {r.component for r in got if r.id in (1, 2, 3, 7)} == {1}
    assert [r.component for r in got if r.id is None] == [None]
    assert simhash.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_simhash_long_text_is_whole():
    words = "Alpha beta\x0bGamma deltaÄ epsilon " * 3000
    assert simhash.fingerprint(words.encode(), step=1000) == brute_fingerprint(words)


@pytest.mark.parametrize(("spread", "n"), [(3, 1500), (6, 700), (40, 300)])
def test_simhash_links(spark, monkeypatch, spread, n):
    """Dense buckets (spread 3: all within a few bits of one value) and sparse ones, in cells smaller than a bucket."""
    monkeypatch.setattr(simhash, "CELL", 100)
    r = Random(spread)
    base = [r.getrandbits(64) for _ in range(3)]
    values = set()
    while len(values) < n:
        x = r.choice(base)
        for _ in range(r.randrange(spread + 1)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values = sorted(values)
    v = np.array(values, np.uint64)
    want = union_find(n, zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)))
    fps = spark.createDataFrame([(int(np.int64(np.uint64(x))),) for x in values], "fp long")
    at = {int(np.int64(np.uint64(x))): i for i, x in enumerate(values)}
    links = [(at[x.a], at[x.b]) for x in simhash.link(fps, Scratch(spark, "t")).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in links)
    assert union_find(n, links) == want
    assert len(links) <= 60 * n  # spanning forests, not pairs


def test_masks_cover_every_close_pair():
    r = Random(5)
    for n in (10, 10**8, 10**11):
        ms = simhash.masks(simhash.blocks_for(n, 4), 4)
        for _ in range(300):
            flip = 0
            for b in r.sample(range(64), 4):
                flip |= 1 << b
            assert any(flip & m % (1 << 64) == 0 for m in ms)


# --- 3 toxicity, 5 quality


def labelled(spark, n=240):
    r = Random(3)
    plain = ["the", "house", "stands", "near", "river", "and", "people", "walk", "there", "often", "with", "their", "dogs"]
    rows, labels = [], []
    for i in range(n):
        ws = [r.choice(plain) + r.choice(["", "s", "ed", "ly"]) for _ in range(r.randrange(20, 120))]
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            for _ in range(2):
                ws.insert(r.randrange(len(ws)), r.choice(["vilescum", "dumbfool", "grossrat"]))
        if not good:
            ws = [w + "###" for w in ws]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    d, labels = labelled(spark)
    model = toxicity.train(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 3 == 0) for i in held) >= 0.9 * len(held)
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.3 for r in odd)
    assert toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    d, labels = labelled(spark, 20)
    assert {r.score < 1e-9 for r in toxicity.score(d, toxicity.train(d, labels.limit(0))).collect()} == {True}


def test_quality(spark):
    d, labels = labelled(spark)
    model = quality.train(d, labels)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 4 != 1) for i in held) >= 0.95 * len(held)
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(d.limit(0), model).count() == 0


def test_quality_column_is_the_model(spark):
    d, labels = labelled(spark)
    model = quality.train(d, labels)
    stats = quality.statistics(F.coalesce(F.col("text"), F.lit("")))
    wide = d.select("doc_id", *[c.alias(n) for n, c in stats.items()]).toPandas()
    x, names = wide[list(stats)].to_numpy(float), list(stats)
    total = model.bias + sum(w * quality.holds(r, x, names) for r, w in model.rules)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert np.allclose([got[i] for i in wide.doc_id], 1 / (1 + np.exp(-total)))
    assert model.rules and all(1 <= len(r) <= quality.DEPTH for r, _ in model.rules)


def test_quality_of_one_class(spark):
    d, labels = labelled(spark, 40)
    assert {round(r.score) for r in quality.score(d, quality.train(d, labels.where("quality = 1"))).collect()} == {1}
    assert {round(r.score) for r in quality.score(d, quality.train(d, labels.where("quality = 0"))).collect()} == {0}


# --- 4 pieces


def varint(x):
    out = b""
    while True:
        out += bytes([x & 127 | (128 if x > 127 else 0)])
        x >>= 7
        if not x:
            return out


def field(n, value):
    if isinstance(value, bytes):
        return varint(n << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(n << 3 | 5) + struct.pack("<f", value)
    return varint(n << 3) + varint(value)


def unigram_model():
    """A small unigram model, written by hand: every byte, some words, scores that make the best path matter."""
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    words = ["▁", "▁the", "▁th", "e", "▁a", "n", "d", "▁and", "ab", "b", "c", "abc", "t", "h", "a", "▁ca", "at", "▁cat"]
    pieces_ += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces_)
    return raw + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


TEXTS = ["", " ", "the cat and abc", "  two  blanks  ", "日本 ☃", "a\nb\tc", "x" * 300, "▁odd ▁▁", "<s> <0x41>", "thecatand abcab"]


def test_bpe_parity():
    codec = pieces.loaded(None)
    for t, (raw, same, trip) in zip(TEXTS, codec.verified(TEXTS)):
        ids = list(np.frombuffer(raw, np.uint32))
        assert ids == codec.own.encode(t) == codec.tok.encode(t, add_special_tokens=False).ids and same and trip


def test_unigram_parity():
    codec = pieces.Codec(unigram_model())
    assert codec.spec.kind == pieces.UNIGRAM and codec.split is not None
    for t, (raw, same, trip) in zip(TEXTS, codec.verified(TEXTS)):
        ids = list(map(int, np.frombuffer(raw, np.uint32)))
        assert ids == codec.own.encode(t) and same and trip
        assert codec.decode([ids])[0] == codec.own.decode(ids).replace("▁", " ")


@pytest.mark.parametrize("model", ["own", "unigram"])
def test_texts_are_decoded_as_by_the_tokenizer(model):
    """Any ids, broken bytes and pieces without a text among them; ids as texts give them without the tokenizer."""
    codec = pieces.loaded(None) if model == "own" else pieces.Codec(unigram_model())
    r, n = Random(3), len(codec.spec.pieces)
    ids = [[r.choice([r.randrange(n), r.randrange(min(n, 280))]) for _ in range(r.randrange(12))] for _ in range(3000)]
    want = codec.tok.decode_batch([[i for i in x if i not in codec.silent] for x in ids], skip_special_tokens=False)
    assert codec.decode(ids) == want and any("\ufffd" in t for t in want)
    whole, codec.tok = codec.tok, None
    try:
        raws = codec.encode(TEXTS)
        assert codec.decode([np.frombuffer(x, np.uint32).tolist() for x in raws]) == [codec.spelled(t) for t in TEXTS]
    finally:
        codec.tok = whole


def test_words_of_many_texts_are_those_of_each():
    """Words are told apart over all texts at once: blanks at edges, runs of marks and empty texts between."""
    r = Random(5)
    texts = ["".join(r.choice(["the", "cat", " ", "  ", "▁", "é", "日", "\n", "<0x41>", "zq"]) for _ in range(r.randrange(9))) for _ in range(500)]
    for codec in (pieces.loaded(None), pieces.Codec(unigram_model(), room=30)):
        raws = codec.encode(texts)
        assert [np.frombuffer(x, np.uint32).tolist() for x in raws] == codec.own.encode(texts)
        assert raws == [codec.encode([t])[0] for t in texts]
    assert [len(x) for x in pieces.batches_of(["a" * 10] * 10 + [None], 200)] == [3, 3, 3, 2]


def test_memory_of_words_is_bounded():
    small = pieces.Codec(unigram_model(), room=5)
    big = pieces.Codec(unigram_model())
    assert [small.encode([t])[0] for t in TEXTS] == [big.encode([t])[0] for t in TEXTS] and len(small.known) <= 8


def test_pieces_edges(spark):
    d = docs(spark, ODD)
    got = pieces.digest(d).collect()
    assert len(got) == len(ODD) and all(r.parity and r.round_trip for r in got if r.doc_id != 1)
    assert [(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 1] == [(None, None)]
    enc = pieces.encode(d)
    back = Counter((r.doc_id, r.text) for r in pieces.decode(enc).collect())
    assert back == Counter(ODD)
    assert pieces.digest(d.limit(0)).count() == 0


def test_unknown_models_are_refused():
    with pytest.raises(ValueError, match="model kind"):
        pieces.parse(field(2, field(3, 4)))


# --- 6 packing


@pytest.mark.parametrize("seed", range(6))
def test_packing_search(seed):
    r = Random(seed)
    lengths = Counter(r.randint(r.choice([1, 10, 20]), r.choice([30, 45, 64])) for _ in range(r.choice([20, 200])))
    first = packing.first_fit(lengths, 64)
    better, made = packing.improve(first, 64)
    squares = lambda bins: sum(packing.fill(b) ** 2 * n for b, n in bins.items())
    for bins in (first, better):
        held = Counter()
        for b, n in bins.items():
            assert 0 < packing.fill(b) <= 64
            for length, k in b:
                held[length] += k * n
        assert held == lengths
    assert sum(better.values()) <= sum(first.values()) and squares(better) >= squares(first)


def test_exchanges_empty_bins():
    """Lengths as texts have them: the first fit leaves more bins than there must be, the exchanges empty those."""
    r = Random(9)
    lengths = Counter(min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000))
    first, least = packing.first_fit(lengths, 2048), packing.fewest(lengths, 2048)
    assert sum(first.values()) > sum(packing.improve(first, 2048)[0].values()) and sum(packing.packed(lengths, 2048).values()) == least


def test_search_ends_where_nothing_can_be_exchanged():
    lengths = Counter({n: 3 for n in range(1025, 1200)})
    assert sum(packing.improve(packing.first_fit(lengths, 2048), 2048)[0].values()) == 525
    lengths = Counter({700: 10, 900: 7})
    assert sum(packing.improve(packing.first_fit(lengths, 2048), 2048)[0].values()) == 9


def test_exchange_kinds():
    partner = lambda giver, taker: packing.Search(Counter({giver: 1, taker: 1}), 64).partner(giver)
    assert partner(((10, 1),), ((50, 1),)) == (((50, 1),), [10], [])
    assert partner(((30, 1),), ((33, 1), (20, 1)))[1:] == ([30], [20])
    assert partner(((12, 1), (11, 1)), ((40, 1), (20, 1)))[1:] == ([12, 11], [20])
    assert partner(((60, 1),), ((60, 1),)) is None
    assert partner(((30, 1),), ((34, 1), (15, 1), (13, 1)))[1:] == ([30], [15, 13])


@pytest.mark.parametrize("seed", range(4))
def test_takers_are_found_without_looking_at_every_slack(seed):
    """The same exchange as by looking at each slack and each give in turn, at a small part of the places."""
    r = Random(seed)
    lengths = Counter(min(512, int(r.lognormvariate(4.5, 1)) + 1) for _ in range(400))
    search, places, plain = packing.Search(packing.improve(packing.first_fit(lengths, 512), 512)[0] if seed % 2 else packing.first_fit(lengths, 512), 512), 0, 0
    for own, giver in list(search.order):
        gives, alone, want = packing.some_of(giver), search.bins[giver] < 2, None
        room = [b for size, b in search.order if own <= size <= 512 - giver[-1][0] and (b != giver or not alone)]
        at = 512, 0
        for slack, k, there in ((s, k, g) for s in range(512) for k, g in enumerate(gives) if sum(g) + s <= 512):
            plain += 1
            fit = [x for x in search.reach[sum(there) + slack] if own <= x[0] < 512 - slack and (x[2] != giver or not alone)]
            if fit:
                want, at = (fit[0][2], list(there), list(fit[0][1])), (slack, k)
                break
        places += sum(x <= at for x in search.likely(np.array([sum(g) for g in gives]), own))
        assert room or search.partner(giver) == want
    assert places <= plain / (3 if seed % 2 else 1)


def test_exchanges_alone_reach_the_bound():
    """From the first fit, no other packing being looked at: every bin fewer comes from exchanges, which most bins went
    through."""
    r = Random(4)
    lengths = Counter(r.choice([2048, min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)]) for _ in range(4000))
    first = packing.first_fit(lengths, 2048)
    bins, made = packing.improve(first, 2048)
    underfull = lambda bins: Counter({b: n for b, n in bins.items() if b != ((2048, 1),)})
    assert sum(first.values()) > sum(bins.values()) == packing.fewest(lengths, 2048) and made >= 50
    assert sum((underfull(bins) - underfull(first)).values()) >= 0.1 * sum(underfull(bins).values())


def test_groups_are_searched_apart_and_their_emptiest_bins_together(spark, monkeypatch):
    """Many small groups end with hardly more bins than one, each piece in one place."""
    monkeypatch.setattr(packing, "GROUP", 300)
    monkeypatch.setattr(packing, "FAN", 3)
    r = Random(2)
    lengths = [min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)]
    rows = spark.createDataFrame([(i % 7 or None, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows).collect()
    assert sorted((r.ids_crc32, r.length) for r in got) == list(enumerate(lengths))
    bins = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= packing.fewest(Counter(lengths), 2048) + 2


def test_packing_edges(spark):
    got = packing.pack(packing.tokenize(docs(spark, ODD))).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.piece), []).append(r)
    assert by[1, 0][0].length == by[2, 0][0].length == 1 and len(by[4, 0]) == 2
    long = sorted((r for r in got if r.doc_id == 5), key=lambda r: r.piece)
    assert all(r.length == 2048 for r in long[1:]) and long[1].start == long[0].length
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(packing.tokenize(docs(spark, ODD).limit(0))).count() == 0


def test_fast_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for t in [*TEXTS, "It's  they'll\n\n x", "<|endoftext|>", "ab <|endoftext|> cd", "Été üß", "ไทย ​", "1234 5½", "\x85\xa0"]:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


# --- 7 sharding


def test_min_cost_flow_moves_the_least():
    flow = sharding.min_cost_flow([10, 4], [5, 5, 4], lambda i, j: float(i != j))
    assert sum(flow.values()) == 14 and sum(x for (i, j), x in flow.items() if i != j) == 5
    assert sharding.min_cost_flow([3], [2, 1], lambda i, j: float(j == 0))[0, 0] == 2


def test_sharding(spark):
    r = Random(1)
    rows = [(i, "x" * r.randrange(400) + str(i)) for i in range(1500)] + [(5000 + i, "hot copy") for i in range(400)] + [x for x in ODD if x[0] != 5]
    got = sharding.reshard(docs(spark, rows), shards=8, old_shards=6).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), {}
    for x in got:
        load[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
    assert max(load.values()) <= 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(x.doc_id, x.size, x.text_crc32) for x in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert len({x.shard for x in got if x.text_crc32 == zlib.crc32(b"hot copy")}) == 1
    assert sharding.reshard(docs(spark, ODD).limit(0), shards=8).count() == 0


def test_a_text_too_large_for_a_shard_is_split(spark):
    rows = [(i, "a hot text of some length") for i in range(3000)] + [(9000 + i, f"other {i}") for i in range(1000)]
    got = sharding.reshard(docs(spark, rows), shards=8, old_shards=8).collect()
    load = Counter()
    for x in got:
        load[x.shard] += x.size
    assert max(load.values()) <= 1.1 * min(load.values())


@pytest.mark.parametrize("seed", range(4))
def test_moved_bytes_are_near_the_flow(seed):
    r = Random(seed)
    sizes = {(b, -1, -1): int(r.lognormvariate(8, 1)) for b in range(2000)}
    old = {b: b[0] % 32 for b in sizes}
    new = sharding.plan_transfers(sizes, old, 40)
    supply, load = Counter(), Counter()
    for b, n in sizes.items():
        supply[old[b]] += n
        load[new[b]] += n
    room = sharding.rooms(sizes, old, 40)
    flow = sharding.min_cost_flow([supply[i] for i in range(32)], room, lambda i, j: float(i != j))
    best, moved = sum(x for (i, j), x in flow.items() if i != j), sum(n for b, n in sizes.items() if new[b] != old[b])
    assert set(new) == set(sizes) and best <= moved + 40 * 40 and moved <= 1.005 * best
    assert max(load.values()) <= 1.002 * min(load.values())


def test_shrinking_moves_the_shards_that_go():
    sizes = {(b, -1, -1): 100 + b % 7 for b in range(400)}
    old = {b: b[0] % 10 for b in sizes}
    new = sharding.plan_transfers(sizes, old, 8)
    assert set(new.values()) == set(range(8))
    assert sum(n for b, n in sizes.items() if new[b] != old[b]) <= 1.02 * sum(n for b, n in sizes.items() if old[b] >= 8)


def test_a_block_larger_than_a_share_has_its_own_shard():
    sizes = {(0, -1, -1): 10_000} | {(b, -1, -1): 100 for b in range(1, 41)}
    new = sharding.plan_transfers(sizes, {b: b[0] % 4 for b in sizes}, 5)
    load = Counter()
    for b, s in new.items():
        load[s] += sizes[b]
    assert new[0, -1, -1] == 0 and sorted(load.values()) == [1000, 1000, 1000, 1000, 10_000]


def test_rewrite(spark, tmp_path):
    """Documents with equal ids, without ids and with columns of the plan's names come back, each in its shard."""
    rows = [(i % 500 if i % 50 else None, "y" * (i % 90)) for i in range(600)]
    d = docs(spark, rows).withColumn("shard", F.lit("own")).withColumn("slot", F.lit(1.5))
    plan = sharding.reshard(d, shards=5, old_shards=4)
    same = {r.shard for r in sharding.rewrite_affected(spark, d, plan, str(tmp_path / "out"), rows=40).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*d.columns, "slot_", "shard_"] and back.where("shard <> 'own' OR slot <> 1.5").count() == 0
    want = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in plan.collect() if r.shard not in same)
    assert Counter((r.doc_id, zlib.crc32(r.text.encode()), r.shard_, r.slot_) for r in back.collect()) == want


# --- 8 top-k


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * r.choice([0.01, 1, 5])]) for i in range(900)]
    rows += [(1000, None), (1100, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, [0.0] * 8), (1500, [2.0, 1.0]), (1501, [1.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "q", 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, dim string, norm double")
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in ok:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:10]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_pruning_keeps_what_counts():
    r = np.random.default_rng(4)
    for _ in range(50):
        c = (r.normal(size=(300, 6)) * 1000).astype(np.int64)
        q = (r.normal(size=6) * 1000).astype(np.int64)
        scores = topk.product(c, q)
        least = float(np.sort(scores)[-10])
        kept = topk.candidates(c, np.linalg.norm(c, axis=1), q, float(np.linalg.norm(q)), least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept) and len(kept) < 300


def test_products_beyond_floats_are_exact():
    c, q = np.array([[2**31 + 1, 3]]), np.array([2**30 + 1, 5])
    assert topk.product(c, q)[0] == (2**31 + 1) * (2**30 + 1) + 15


# --- 9 vectors


def test_vectors(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + r.normal(size=16) * 0.03], i % 2) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, rows[0][1], 0), (702, rows[0][1], None), (703, None, 0), (704, [0.0] * 16, 0), (705, [None] * 16, 0), (706, [float("nan")] * 16, 0), (None, rows[0][1], 0), (707, [1.0, 0.0], 0), (708, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(i, v, lab, "q", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node string, h int")
    got = vectors.near_duplicates(df, trees=6, leaf=16).collect()
    assert len(got) == len(rows)
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = [np.array([np.float32(c) for c in rows[k][1]], float) for k in ok]
    pairs = [(a, b) for a in range(len(ok)) for b in range(a) if rows[ok[a]][2] == rows[ok[b]][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98]
    degree = Counter(k for p in pairs for k in p)
    found, all_ = sum(r.n_links for r in got), sum(degree.values())
    assert 0.97 * all_ <= found <= all_
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].kept and by[i].component_id == i for i in (702, 703, 704, 705, 706))
    assert by[707].component_id == by[708].component_id == 707 and by[708].n_links == 1 and not by[708].kept
    assert by[None].component_id == by[700].component_id == by[701].component_id and by[None].kept is False
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_crowded_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.ones(8) + r.normal(size=8) * 0.01], 1) for i in range(150)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), trees=2, leaf=200).collect()
    assert {x.n_links for x in got} == {149} and {x.component_id for x in got} == {0}


def test_large_leaves_are_split_again(spark, monkeypatch):
    """With a sample too small for deep trees, leaves are split level by level, and near copies stay together."""
    monkeypatch.setattr(vectors, "SAMPLE", 8)
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=8)], 1) for i in range(600)]
    rows += [(1000 + i, [float(x + 0.002 * r.normal()) for x in rows[i % 300][1]], 1) for i in range(300)]
    rows += [(2000 + i, [float(x) for x in np.ones(8) + r.normal(size=8) * 0.001], 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    split = vectors.split_crowded
    monkeypatch.setattr(vectors, "split_crowded", lambda *a: seen.append((a[0], split(*a))) or seen[-1][1])
    drop = Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, name: None if name in ("indexed", "resplit") else drop(self, name))
    got = {x.vec_id: x for x in vectors.near_duplicates(df, trees=3, leaf=8).collect()}
    before, after = ({x.code: x.n for x in d.select("node", F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()} for d in seen[0])
    assert max(before.values()) > 200 and sorted(after.values())[-4] <= 0.5 * max(before.values()) and len(after) > 2 * len(before)
    x = np.array([np.float32(v) for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    links = np.array([got[i].n_links for i, _, _ in rows])
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum()


def test_spanning_forest():
    r = np.random.default_rng(3)
    near = r.random((60, 60)) < 0.02
    near |= near.T
    np.fill_diagonal(near, False)
    pairs = spanning(near)
    assert union_find(60, pairs) == union_find(60, zip(*np.nonzero(near))) and len(pairs) == 60 - len(set(union_find(60, pairs)))


# --- 10 lines


def brute_chunks(text):
    """(first line, lines) of the chunks that the rule gives."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in text.split("\n")]
    rolled = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    cuts = [0, *(i for i in range(2, len(h)) if rolled(h[i - 2], h[i - 1]) % 4 < 3), len(h)]
    ends = {a: next((b for b in cuts if b >= a + 2), len(h)) for a in cuts}
    return [(a, b - a) for a, b in ends.items() if b - a > 1]


def brute_clean(texts):
    """id -> (text, lines removed), from id -> text."""
    lines_ = {i: t.split("\n") for i, t in texts.items()}
    body = lambda i, a, n: "\n".join(lines_[i][a : a + n])
    first = {}
    for i in sorted(texts):
        for a, n in sorted(brute_chunks(texts[i])):
            if body(i, a, n).strip():
                first.setdefault(body(i, a, n), (i, a))
    out = {}
    for i, ls in lines_.items():
        gone = set()
        for a, n in brute_chunks(texts[i]):
            j, f = first.get(body(i, a, n), (i, a))
            if (j, f) == (i, a):
                continue
            gone |= set(range(a, a + n))
            for step, x, y in ((-1, a - 1, f - 1), (1, a + n, f + n)):
                for _ in range(lines.REACH):
                    if not (0 <= x < len(ls) and 0 <= y < len(lines_[j]) and ls[x] == lines_[j][y]):
                        break
                    gone.add(x)
                    x, y = x + step, y + step
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    return out


PASSAGE = "\n".join(f"line {k} of a passage that many documents share, with some more words" for k in range(9))


def test_lines_edges(spark):
    d = docs(spark, ODD)
    got = lines.clean(d)
    assert got.columns == [*d.columns, "_removed_lines"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(ODD)
    assert lines.clean(d.limit(0)).count() == 0


def test_shared_passages_go_but_for_the_first(spark):
    rows = [(i, f"own start {i}\n{PASSAGE}\nown end {i}") for i in (3, 1, 2)] + [(9, "own start 9\nshort\nown end 9"), (10, "short"), (None, f"zz\n{PASSAGE}")]
    got = {r.doc_id: r.text for r in lines.clean(docs(spark, rows)).collect()}
    assert got[1] == dict(rows)[1] and got[2] == "own start 2\nown end 2" and got[3] == "own start 3\nown end 3"
    assert got[9] == dict(rows)[9] and got[10] == "short" and got[None] == "zz"


def test_long_single_lines_stay_and_short_chunks_go(spark):
    long = "a single line that many documents hold " * 20
    rows = [(1, f"own 1\n{long}\nend 1"), (2, f"own 2\n{long}\nend 2"), (3, long), (4, long), (5, "a\nb\nc"), (6, "a\nb\nc"), (7, "own\n\n\n\n"), (8, "more\n\n\n\n")]
    got = {r.doc_id: r.text for r in lines.clean(docs(spark, rows)).collect()}
    assert got == {**dict(rows), 6: ""}


def test_a_copy_becomes_empty_and_repeated_rows_agree(spark):
    got = Counter((r.doc_id, r.text) for r in lines.clean(docs(spark, [(1, PASSAGE), (2, PASSAGE), (1, PASSAGE), (3, f"{PASSAGE}\n{PASSAGE}")])).collect())
    assert got == Counter({(1, PASSAGE): 2, (2, ""): 1, (3, ""): 1})


def test_boundaries_resist_shifts(spark):
    body = [f"short line number {k * 37 % 101}" for k in range(40)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["inserted", *body]))]
    parts = docs(spark, rows).select("doc_id", F.explode(lines.chunks(F.col("text"))).alias("c")).select("doc_id", "c.*").collect()
    one, two = ({r.k for r in parts if r.doc_id == i} for i in (1, 2))
    assert len(one & two) >= 0.9 * len(one)
    for i, t in rows:
        assert {(r.pos, r.n) for r in parts if r.doc_id == i} == set(brute_chunks(t))


def test_passages_of_short_lines_go(spark):
    """Passages of 5 to 12 lines of 10 words, each planted twice between lines of its own, go whole the second time,
    but for a few short ones that hold no two boundaries."""
    r = Random(3)
    words = lambda n: " ".join(f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.randrange(1000)}" for _ in range(n))
    rows, want = [], {}
    for k in range(160):
        passage = [words(10) for _ in range(5 + k % 8)]
        for i in (2 * k, 2 * k + 1):
            before, after = ([words(r.randrange(1, 15)) for _ in range(3)] for _ in range(2))
            rows.append((i, "\n".join([*before, *passage, *after])))
            want[i] = rows[-1][1] if i % 2 == 0 else "\n".join([*before, *after])
    got = {x.doc_id: x.text for x in lines.clean(docs(spark, rows)).collect()}
    assert all(got[i] in (t, want[i]) for i, t in rows)
    assert sum(got[i] == want[i] for i in want if i % 2) >= 0.95 * 160


def test_lines_against_brute_force(spark):
    r = Random(4)
    line = lambda: r.choice(["", "x", "a line of some thirty bytes, ok", "y" * 79, "é" * 50, "w" * 90, f"new {r.random()}"])
    texts = {i: "\n".join(line() for _ in range(r.randrange(1, 40))) for i in range(60)} | {60: "\n" * 200, 61: "own" + "\n" * 90, 62: "\n".join(["a", "b"] * 40)}
    got = lines.clean(docs(spark, texts.items()))
    assert {x.doc_id: (x.text, x._removed_lines) for x in got.collect()} == brute_clean(texts)


def test_long_copies_are_cleaned(spark):
    """Two copies of a text of 20000 lines, one with a line put in, and a third that shares its middle."""
    body = [f"line {k * 7919 % 20011} of a long text" for k in range(20_000)]
    texts = {1: "\n".join(body), 2: "\n".join([*body[:9000], "put in", *body[9000:]]), 3: "\n".join(["own", *body[500:1500], "end"])}
    got = {x.doc_id: x.text for x in lines.clean(docs(spark, texts.items())).collect()}
    assert got == {1: texts[1], 2: "put in", 3: "own\nend"}
