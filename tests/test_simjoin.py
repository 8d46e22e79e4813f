"""The similarity join loses no pair that the plain matcher finds."""

from difflib import SequenceMatcher
from random import Random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlattice.functions import similarity as Sim
from memlattice.operators import matching as M
from memlattice.operators import simjoin


def brute(left, right, least):
    out = {(i, j): SequenceMatcher(None, a.lower(), b.lower()).ratio() for i, a in enumerate(left) for j, b in enumerate(right)}
    return {k: r for k, r in out.items() if r >= least}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcd ÄİßZ😀\n", max_size=40), max_size=6), st.lists(st.text("abcd ÄİßZ😀\n", max_size=40), max_size=6), st.sampled_from([0.3, 0.5, 0.85, 1.0]))
def test_no_pair_of_short_texts_is_lost(left, right, least):
    assert {(i, j): r for i, j, r in Sim.near_pairs(left, right, least)} == brute(left, right, least)


def edited(r, text, share):
    chars = list(text)
    for _ in range(int(share * len(chars))):
        k = r.randrange(len(chars))
        chars[k : k + 1] = r.choice([[], [r.choice("abcdefgh .")], [chars[k], r.choice("xyz")]])
        if r.random() < 0.02:
            a, b = sorted((r.randrange(len(chars)), r.randrange(len(chars))))
            chars = chars[:a] + chars[b:] + chars[a:b]
    return "".join(chars)


@pytest.mark.parametrize("seed", range(6))
def test_no_pair_of_long_texts_is_lost(seed):
    """With characters too common to start a block, near copies, moved passages and texts of one alphabet."""
    r = Random(seed)
    base = ["".join(r.choice("aaeeinst  dlmo.rq" + "xyzXYZ019" * (seed % 2)) for _ in range(r.randrange(150, 900))) for _ in range(4)]
    left = [edited(r, t, r.choice([0, 0.02, 0.05, 0.1, 0.2])) for t in base for _ in range(4)]
    right = base + ["a" * 300, "ab" * 150, "a" * 299 + "b"]
    for least in (0.5, 0.85):
        assert {(i, j): x for i, j, x in Sim.near_pairs(left, right, least)} == brute(left, right, least)


def rows_of(spark, texts, blocks=2):
    return spark.createDataFrame([(k, k % blocks, t) for k, t in enumerate(texts)], "id long, block int, t string")


def best(texts, blocks, least, earlier):
    out = {}
    for i, a in enumerate(texts):
        found = []
        for j, b in enumerate(texts):
            if i % blocks == j % blocks and (j < i if earlier else i != j) and a is not None and b is not None:
                x = SequenceMatcher(None, a.lower(), b.lower()).ratio()
                if x >= least:
                    found.append((-x, j))
        out[i] = (min(found)[1], -min(found)[0]) if found else (None, None)
    return out


@pytest.mark.parametrize("earlier", [True, False])
def test_best_match_against_brute_force(spark, monkeypatch, earlier):
    """Copies, nulls, empty texts, ties and groups of few texts."""
    monkeypatch.setattr(simjoin, "GROUP", 4)
    r = Random(9)
    base = ["".join(r.choice("abcdef gh.") for _ in range(r.randrange(20, 260))) for _ in range(5)]
    texts = [edited(r, r.choice(base), r.choice([0, 0, 0.05, 0.3])) for _ in range(60)] + [None, "", "", None, "x", "x"]
    rows = rows_of(spark, texts)
    got = {x.id: (x.match, x.similarity) for x in M.best_match(rows, rows, ["block"], "id", "t", 0.8, earlier=earlier).collect()}
    assert got == best(texts, 2, 0.8, earlier)


def test_a_crowd_of_copies_is_matched_once(spark):
    """Rows of one text are one text to the join, so their number costs no comparisons."""
    rows = rows_of(spark, ["the same text over and over"] * 5000 + ["another one, not alike"], 1)
    nodes, owners = simjoin.texts(rows, ["block"], "id", "t")
    assert nodes.count() == 2 and owners.count() == 5001
    got = M.best_match(rows, rows, ["block"], "id", "t", 0.85, earlier=True)
    assert got.groupBy("match").count().collect()[0].asDict() is not None and got.where("match = 0").count() == 4999


def test_few_pairs_reach_the_matcher(monkeypatch):
    """Of the pairs that lengths alone leave (what was matched before), under a twentieth are matched, and none is lost."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'en' AND length(text) BETWEEN 800 AND 2500 ORDER BY doc_id").fetchall()
    texts, calls, plain = [t for (t,) in rows[:90]], [], Sim.SequenceMatcher

    class Counted(plain):
        def ratio(self):
            calls.append(1)
            return plain.ratio(self)

    monkeypatch.setattr(Sim, "SequenceMatcher", Counted)
    got = {(i, j): x for i, j, x in Sim.near_pairs(texts, texts, 0.85)}
    by_length = sum(2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) for a in texts for b in texts)
    assert len(calls) <= by_length / 20 and got == brute(texts, texts, 0.85)


def test_contradictions_against_brute_force(spark):
    r = Random(1)
    titles = ["".join(r.choice("abcde ") for _ in range(30)) for _ in range(4)]
    rows = [(k, k % 2, edited(r, r.choice(titles), r.choice([0, 0.1])), r.choice(["yes", " yes ", "no", None])) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, block int, title string, content string")
    got = {tuple(x) for x in M.contradictions(df, df, ["block"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and None not in (a[3], b[3]) and a[3].strip() != b[3].strip() and SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio() >= 0.8}
    assert got == want


def test_empty_tables(spark):
    rows = rows_of(spark, ["a"]).limit(0)
    assert M.best_match(rows, rows, ["block"], "id", "t", 0.5).count() == 0
    assert simjoin.similar(*(simjoin.texts(rows.withColumn("x", F.lit(1)), ["block"], "id", "t")[0] for _ in range(2)), ["block"], 0.5).count() == 0


def counted(monkeypatch):
    calls, plain = [], Sim.SequenceMatcher

    class Counted(plain):
        def ratio(self):
            calls.append(1)
            return plain.ratio(self)

    monkeypatch.setattr(Sim, "SequenceMatcher", Counted)
    monkeypatch.setattr(M, "SequenceMatcher", Counted)
    return calls


def test_unlike_long_texts_are_not_matched(monkeypatch):
    """of the pairs of whole texts hardly more are matched than are alike."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'en' ORDER BY doc_id").fetchall()
    texts, calls = list(dict.fromkeys(t for (t,) in rows if len(t) < 9000))[:150], counted(monkeypatch)
    found = list(Sim.near_pairs(texts, texts, 0.85))
    assert found and len(calls) <= 2 * len(found)


def test_unlike_titles_are_not_matched(monkeypatch):
    """titles of one language have letters in common, but no long subsequence."""
    rows = duckdb.sql("SELECT left(text, 80) FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'en' ORDER BY doc_id").fetchall()
    texts, calls = list(dict.fromkeys(t for (t,) in rows))[:150], counted(monkeypatch)
    found = list(Sim.near_pairs(texts, texts, 0.8))
    assert len(calls) <= 1.5 * len(found) and {(i, j): x for i, j, x in found if i < 30} == brute(texts[:30], texts, 0.8)


def test_a_row_does_not_meet_all_its_like_texts(spark):
    """of texts that are all alike only those come out that are more alike than the ones before them."""
    texts = [f"a part with the number {k:04d}" for k in range(300)]
    rows = rows_of(spark, texts, 1)
    nodes = simjoin.texts(rows, ["block"], "id", "t")[0]
    few = simjoin.similar(nodes, nodes, ["block"], 0.5, earlier=True, best=True).count()
    assert few < 300 * 12 and simjoin.similar(nodes, nodes, ["block"], 0.5, earlier=True).count() == 300 * 299 // 2
    got = {x.id: (x.match, x.similarity) for x in M.best_match(rows.where("id < 60"), rows.where("id < 60"), ["block"], "id", "t", 0.5, earlier=True).collect()}
    assert got == best(texts[:60], 1, 0.5, True)


def test_cells_of_two_groups_give_each_pair_once(spark, monkeypatch):
    """Also where one of the two groups has no text."""
    monkeypatch.setattr(simjoin, "GROUP", 2)
    rows = rows_of(spark, [f"some text {k}" for k in range(5)] + ["another thing altogether, and longer"], 1)
    nodes = simjoin.texts(rows, ["block"], "id", "t")[0]
    got = [(x.left_node, x.right_node) for x in simjoin.similar(nodes, nodes, ["block"], 0.8).collect()]
    assert sorted(got) == sorted([(i, j) for i in range(5) for j in range(5)] + [(5, 5)])


def test_stored_memories_are_matched_only_where_they_can_be_alike(monkeypatch):
    """the decisions of the plain fold, with few calls of the matcher."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'en' AND length(text) < 4000 ORDER BY doc_id").fetchall()[:150]
    r = Random(5)
    rows += [(10_000 + k, edited(r, t, 0.03)) for k, t in rows[:4] if len(t) < 1500]
    calls, stored, plain, want = counted(monkeypatch), M.Stored(), [], []
    got = [stored.take(k, "", t) for k, t in rows]
    few = len(calls)
    for k, t in rows:
        new = M.Stored.whole("", t)
        sims = [(s, -i) for i, (_, _, old) in enumerate(plain) if (m := SequenceMatcher(None, new, old)).real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and (s := m.ratio()) >= M.D.MERGE_FROM]
        if not sims:
            plain.append((k, t, new))
            want.append(("store", None))
            continue
        s, i = max(sims)
        match, old, _ = plain[-i]
        want.append(("discard" if s > M.D.DUPLICATE_ABOVE else "merge", match))
        if want[-1][0] == "merge":
            a, b = old.strip(M.Stored.SPACE), t.strip(M.Stored.SPACE)
            a = f"{a}\n\n{b}".strip() if b and b not in a else a
            plain[-i] = (match, a, M.Stored.whole("", a))
    assert got == want and few <= 2 * sum(d != "store" for d, _ in got) + 5
