"""The driver's queries over whole tables, against brute force, SQL or held-out labels."""

import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from memlattice.llm import topk
from memlattice.llm.queries import QUERIES

from test_llm import brute_clean

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def groups(ids, pairs):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark, docs):
    got = QUERIES["op1_language_id"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op2(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_simhash"](spark, SF).collect()}
    v = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, d in list(docs.items())[:40]:
        w = d.text.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
        assert v[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids = sorted(v)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (v[a] ^ v[b]).bit_count() <= 4])
    assert {i: r.component_id for i, r in got.items()} == want


def held_out(spark, sf, name, label, least):
    """(label, predicted) of the labelled rows that were held out, after holding all rows to the contract."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows} and all(0 <= r.score <= 1 and r.predicted == (r.score >= least) and r.held_out == (crc(r.doc_id) % 4 == 2) for r in got.values())
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return np.array([(known[i], got[i].predicted) for i in known if got[i].held_out])


def test_op3(spark):
    """Of the rare class, on the largest table: what is called toxic is, and half of it is found, the part that does
    not consist of ordinary syllables. A constant fails both."""
    y, p = held_out(spark, "/root/testdata/sf0.1", "op3_toxicity", "toxic", 0.3).T
    assert y[p == 1].mean() >= 0.9 and p[y == 1].mean() >= 0.45 and p[y == 0].mean() <= 0.01


def test_op5(spark):
    """Of the rare class: bad documents are found, and what is called bad is."""
    y, p = held_out(spark, "/root/testdata/sf0.1", "op5_quality", "quality", 0.7).T
    assert y[p == 0].mean() <= 0.1 and p[y == 0].mean() <= 0.1 and p[y == 1].mean() >= 0.97


def test_op4(spark, docs):
    got = QUERIES["op4_sentencepiece"](spark, SF).collect()
    assert len(got) == len(docs) and all(r.parity and r.round_trip and r.n_tokens > 0 for r in got)


def test_op6(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == [sum(x.length for x in b[:k]) for k in range(len(b))] and sum(r.length for r in b) <= 2048
    for i, d in docs.items():
        ids = np.array([*own.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 2048 for r in mine[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_op7(spark, docs):
    rows = QUERIES["op7_min_cost_sharding"](spark, SF).collect()
    load, slots, at = {}, {}, {}
    for r in rows:
        text = docs[r.doc_id].text
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        at.setdefault(text, set()).add(r.shard)
    assert set(load) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(load.values()) / 40
    singles = max(len(t.encode()) + 16 for t in at)
    assert max(load.values()) <= max(1.05 * share, singles) and min(load.values()) >= 0.9 * share
    copies = {t: sum(docs[r.doc_id].text == t for r in rows) for t in at}
    assert all(len(s) == 1 for t, s in at.items() if copies[t] * (len(t.encode()) + 16) <= share)


def test_op7_moves_little_and_rewrites(spark, tmp_path):
    """At the middle scale: bytes moved are near the flow's least, and the files written hold each shard's documents."""
    from memlattice.llm import sharding

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = sharding.reshard(d)
    rows = plan.collect()
    supply = [sum(r.size for r in rows if r.old_shard == i) for i in range(32)]
    share = sum(supply) // 40
    assert sum(r.size for r in rows if r.shard != r.old_shard) <= 1.005 * sum(max(0, n - share) for n in supply)
    load = [sum(r.size for r in rows if r.shard == j) for j in range(40)]
    assert max(load) <= 1.008 * min(load)
    same = {r.shard for r in sharding.rewrite_affected(spark, d, plan, str(tmp_path / "out")).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in rows if r.shard not in same}


def test_op7_is_even_and_moves_little(spark):
    """At the large scale: shards are within a five-hundredth of each other and moved bytes near the flow's least."""
    from memlattice.llm import sharding

    rows = sharding.reshard(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("old_shard", "shard").agg({"size": "sum"}).collect()
    load, supply = [sum(r[2] for r in rows if r.shard == j) for j in range(40)], [sum(r[2] for r in rows if r.old_shard == i) for i in range(32)]
    assert max(load) <= 1.002 * min(load)
    assert sum(r[2] for r in rows if r.shard != r.old_shard) <= 1.005 * sum(max(0, n - load[i]) for i, n in enumerate(supply))


def test_op8(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(topk.SQL["op8_norm_bucket_topk"]).fetchall()
    got = QUERIES["op8_norm_bucket_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op9(spark, tmp_path):
    """A table of clusters, near and exact copies, and a crowded one, against brute force."""
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 64))
    v = [base[i % 300] + r.normal(size=64) * r.choice([0.02, 0.1, 0.14]) for i in range(1500)]
    v += [base[0] + r.normal(size=64) * 0.02 for _ in range(800)] + [v[i] for i in range(0, 600, 3)]
    rows = [(i, [float(np.float32(c)) for c in x], i % 3 if i < 1500 else 1) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["op9_embedding_near_dup"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    x, label = np.array([x for _, x, _ in rows]), np.array([k for _, _, k in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want, links = near.sum(axis=1), np.array([got[i].n_links for i in range(len(rows))])
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum() and want.sum() > 600_000
    comps = groups(range(len(rows)), zip(*np.nonzero(np.triu(near))))
    assert sum(got[i].component_id == comps[i] for i in comps) >= 0.98 * len(rows)
    assert sum(r.kept for r in got.values()) == len({r.component_id for r in got.values()})


def test_op10(spark, docs):
    texts = {i: d.text for i, d in docs.items()}
    got = {r.doc_id: (r.text, r.removed_lines) for r in QUERIES["op10_line_dedup"](spark, SF).collect()}
    assert got == brute_clean(texts) and {i: t for i, (t, _) in got.items()} != texts
