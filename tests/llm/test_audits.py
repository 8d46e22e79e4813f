"""Filter interaction, source divergence and voting rules against brute force, and their edge cases."""

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import permutations
from random import Random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import divergence, interaction, rules
from memlattice.llm.common import Scratch
from memlattice.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, id string, fails string, `a.b` int, at string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """(id, text, lang, source) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "i", "f", 1, "t") for r in rows], KIND)


def odd(n=1):
    """Nulls in each column, empty, blank and long texts, ties and repeated rows."""
    r = Random(3)
    long = " ".join(f"w{r.randrange(500)}" for _ in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (None, "no id here", "en", "a"), (None, "no id here", "en", "a")]
    rows += [(4, "same text", "en", "a"), (4, "same text", "en", "a"), (5, "same text", "de", "b"), (6, "SAME TEXT!", "de", "b"), (7, "no id here", "en", "c"), (8, long, "en", "a"), (9, long, "fr", "x")]
    return rows * n


# --- 11 filter interaction


def fails(rows):
    """Mask of each row, by brute force."""
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        bits = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)
        out.append(sum(1 << k for k, b in enumerate(bits) if b))
    return out


def brute_interaction(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out, masks = {}, fails(rows)
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, masks) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, kept = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                shapley[f] += len(gone)
                failing = sum(bool(m & bit) for _, m in own)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(m == bit for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
                left = kept
        for (p, _, _), x in out.items():
            if p == part:
                x[-1] = shapley[x[-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_interaction_against_brute_force(spark, partitions):
    rows = odd() + [(20 + i, f"copied passage {i % 3}", "en", "a") for i in range(40)] + [(200 + i, " ".join(f"w{k * (i + 1) % 131}" for k in range(120)) + "$" * (i % 2), "fr", "b") for i in range(6)]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, None), (5, 0, 1), (25, 1, None), (8, None, 1), (999, 1, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interaction.audit(docs(spark, rows), known).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute_interaction(rows, labels)


def test_runs_of_copies_go_over_the_edges_of_ranges(spark):
    """One text has most rows, so that it fills several ranges; colliding neighbours and all ids count once."""
    rows = [(i, "hot" if i % 4 else f"t{i % 10}", "en", "a") for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = interaction.masks(docs(spark, rows), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 2000 and {r.id: r.fails for r in got} == dict(zip([r[0] for r in rows], fails(rows)))


def test_interaction_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs(spark, odd()).limit(0), none).count() == 0
    assert interaction.audit(docs(spark, odd()), none).count() == 4 * 600


def test_compared_holds_batches_of_any_size():
    """The same outcome whether rows come one by one or together, with fingerprints that collide."""
    import pyarrow as pa

    r = Random(5)
    rows = [(r.randrange(4), 7, bytes([97 + r.randrange(2)]), r.choice([None, *range(6)])) for _ in range(60)]
    rows.sort(key=lambda x: (*x[:3], x[3] is None, x[3] or 0))
    kind = pa.schema([("at", pa.int32()), ("fp", pa.int64()), ("fp2", pa.int64()), ("text", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("fails", pa.int32())])
    whole = pa.RecordBatch.from_pylist([{"at": 3, "fp": a, "fp2": b, "text": t, "id": i, "part": "p", "fails": 0} for a, b, t, i in rows], schema=kind)
    outs = []
    for size in (1, 7, 60):
        got = pa.Table.from_batches(list(interaction.compared(iter([whole.slice(k, size) for k in range(0, 60, size)])))).to_pylist()
        outs.append(sorted(map(repr, got)))
    assert outs[0] == outs[1] == outs[2]
    got = [x for x in got if x["text"] is None]
    least = {}
    for a, b, t, i in rows:
        least[a, t] = min([x for x in (least.get((a, t)), i) if x is not None], default=None)
    assert [x["again"] for x in got] == [i is not None and i > least[a, t] for a, b, t, i in rows]


# --- 12 source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least=3, top=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept, sources = [t for t, n in held[lang].items() if n >= least], sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o) for o in sources if o != s]
            telling = [((each[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and each[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", telling)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, value, k))
    return out


def corpus(n=300):
    r = Random(8)
    words = [f"{a}{b}" for a in ("Ab", "abc", "ñu", "éa", "z", "abcd") for b in "abcdefghij"]
    return [(i, " ".join(r.choice(words[: 20 + 5 * (i % 8)]) + r.choice(["", "1", "-", "_x"]) for _ in range(r.randrange(40))), r.choice(["en", "de"]), f"s{i % 5}") for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_brute_force(spark, monkeypatch, small):
    """Also with tries that are handed on often, tables of few cells and a round for each language."""
    rows = odd() + corpus()
    if small:
        for name, value in (("POUR", 50), ("HOLD", 120), ("CELLS", 24), ("GROUPS", 3), ("STEP", 64)):
            monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(docs(spark, rows), top=30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top=30)


def test_divergence_without_terms(spark):
    assert divergence.audit(docs(spark, odd()).limit(0)).count() == 0
    got = divergence.audit(docs(spark, [(1, "once", "en", "a"), (2, None, "en", "b"), (3, "12", "en", None)])).collect()
    assert len(got) == 6 and all(r.part == "pair" and r.value == 0 for r in got)


def test_tries_walk_in_order_and_merge():
    r = Random(4)
    words = [bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randrange(1, 7))) for _ in range(400)]
    one = divergence.Trie()
    for w in words:
        x = one.leaf(w)
        x[0] = x.get(0, 0) + 1
    assert [(t, x[0]) for t, x in one.walk()] == sorted(Counter(words).items())


@pytest.mark.parametrize("pour, step", [(1 << 24, 1 << 20), (200, 1 << 20), (1 << 24, 30)])
def test_terms_of_many_texts_are_counted_at_once(monkeypatch, pour, step):
    """Leaves hold each source's count and the number of documents, and tries see a term once a pour, however often it
    occurs; also across pours and in texts that are counted by parts."""
    monkeypatch.setattr(divergence, "POUR", pour)
    monkeypatch.setattr(divergence, "STEP", step)
    asked, leaf = [], divergence.Trie.leaf
    monkeypatch.setattr(divergence.Trie, "leaf", lambda self, term: asked.append(term) or leaf(self, term))
    r, want, held = Random(6), defaultdict(Counter), Counter()
    counts = divergence.Counts()
    for _ in range(120):
        lang, source = r.choice("xy"), r.randrange(4)
        text = "".join(r.choice(["Ab", "ab", "é", "abc", " ", "  ", "1", "\n", "zq"]) for _ in range(r.randrange(30)))
        found = TERM.findall(text.replace("A", "a"))
        for t in found:
            want[lang, t.encode()][source] += 1
        held.update((lang, t.encode()) for t in set(found))
        counts.add(lang, source, text.encode())
    got = [x for b in counts.given() for x in b.to_pylist()]
    assert {(x["lang"], x["term"]): dict(np.frombuffer(x["leaf"], np.int64).reshape(-1, 2).tolist()) for x in got} == want
    assert {(x["lang"], x["term"]): x["docs"] for x in got} == held and len(got) == len(want)
    assert [(x["lang"], x["term"]) for x in got] == sorted(want) and (pour < 1000 or step < 1000 or sorted(asked) == sorted(t for _, t in want))
    assert list(counts.given()) == [] and not counts.held and len(divergence.Leaves().entries) == 0


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([0, 10**12, 7 * 10**14]), np.array([9 * 10**14] * 3)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, total)]


def test_op12_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert {tuple(r) for r in QUERIES["op12_source_divergence"](spark, SF).collect()} == brute_divergence(rows)


@pytest.mark.parametrize("name", ["op11_filter_interaction", "op12_source_divergence"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    module = interaction if name[:4] == "op11" else divergence
    want = con.sql(module.SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# --- 13 quality rules


def base(text):
    w = WORD.findall(text or "")
    n = len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    out = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return out, n < 10 or 100 * len(covered) > 20 * n


def votes(text):
    """The rules over again, in plain Python."""
    (n, chars, sym, dup, rep), _ = base(text)
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    ends, plain = sum(x[-1] in ".!?" for x in w), sum(bool(re.fullmatch(r"[^\W\d_]+[.,;:!?]*", x)) for x in w)
    echo, distinct, k = sum(a == b for a, b in zip(w, w[1:])), len(set(w)), len(lines)
    pairs = [
        (sym / n > 0.1, sym / n <= 0.02), (upper / chars > 0.3, upper / chars < 0.1), (not 2 <= chars / n <= 12, 3 <= chars / n <= 10), (dup / k > 0.3, dup == 0 and k >= 3),
        (rep / n > 0.1, rep / n <= 0.02), (ends == 0 or ends / n > 0.5, 0.02 <= ends / n <= 0.25), (plain / n < 0.5, plain / n >= 0.8), (n < 30, n >= 50), (n / k < 3, n / k >= 5),
        (echo / n > 0.1, echo / n <= 0.02), (distinct / n <= 0.6 and n < 200, distinct / n >= 0.7 and n < 200),
    ]
    return [1 if no else 2 if yes else 0 for no, yes in pairs]


def brute_rules(texts):
    """kept of each text: the two-class model by plain expectation-maximisation over texts, not patterns."""
    passed = [i for i, t in enumerate(texts) if not base(t)[1]]
    v = np.array([votes(texts[i]) for i in passed]).reshape(len(passed), -1)
    own, share, good, bad = 0.01 * len(v) + 1, 0.8, [0.98] * v.shape[1], [0.3] * v.shape[1]

    def chance():
        a, b = np.full(len(v), share), np.full(len(v), 1 - share)
        for j, (g, x) in enumerate(zip(good, bad)):
            a *= np.select([v[:, j] == 2, v[:, j] == 1], [g, 1 - g], 1.0)
            b *= np.select([v[:, j] == 2, v[:, j] == 1], [1 - x, x], 1.0)
        return a / (a + b)

    for _ in range(50):
        p = chance()
        share = (p.sum() + 9 * own) / (len(v) + 10 * own)
        for j in range(v.shape[1]):
            yes, no = v[:, j] == 2, v[:, j] == 1
            good[j] = (p[yes].sum() + 0.98 * own) / (p[yes | no].sum() + own)
            bad[j] = max(((1 - p)[no].sum() + 0.3 * own) / ((1 - p)[yes | no].sum() + own), 1 - good[j])
    kept = dict(zip(passed, chance() >= 0.5)) if len(v) else {}
    return [bool(kept.get(i, False)) for i in range(len(texts))]


def test_rules_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, SF).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        r, (want, failed) = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*want, failed), i
    assert [got[i].kept for i in rows] == brute_rules(list(rows.values()))


def test_rules_edges(spark):
    tricky = ["a b c d e " * 2, "a b c d e a b c d e a b", "x " * 9, "x " * 10, "ä Ö\x0bß\x0cñ\r\n" * 5, "l1\n\nl1\n \n \nl1 \n", "one two\u0085three four.\nfive", "0 " + "b c d e f g " * 300]
    rows = odd() + [(50 + k, t, "en", "a") for k, t in enumerate(tricky)]
    got = rules.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base(t)[0], base(t)[1], k) for (i, t, *_), k in zip(rows, brute_rules([t or "" for _, t, *_ in rows])))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert rules.judge(docs(spark, rows).limit(0)).count() == 0


def test_colliding_hashes_of_windows_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1))
    r = Random(2)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (4, 5, 6, 12, 30, 60)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.repeated_words(F.split("t", " ")).alias("n"))
    assert {x.t: x.n for x in d.collect()} == {t: base(t)[0][4] for t in texts}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rules_agree_with_labels(spark, sf):
    """Labels are not learned from; of texts that pass the base, good ones stay and bad ones go."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept) for r in QUERIES["op13_quality_rules"](spark, f"/root/testdata/{sf}").collect() if r.doc_id in labels and not r.base_failed]
    y, kept = np.array(got).T
    assert kept[y == 1].mean() >= 0.995 and kept[y == 0].mean() <= 0.03


def test_clean_corpora_are_kept():
    """Texts of one kind with votes that differ by chance are not split into two classes."""
    r = np.random.default_rng(6)
    votes = np.where(r.random((5000, 11)) < 0.02, rules.AGAINST, rules.FOR)
    share, good, bad = rules.estimate(votes, np.ones(len(votes)))
    assert (rules.posterior(votes, share, good, bad) >= 0.5).mean() >= 0.97
