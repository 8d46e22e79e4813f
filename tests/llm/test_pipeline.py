"""Each stage of the pipeline keeps what it should, and the stages fit together."""

import corpus_pipeline as P
from memlattice.llm import quality, simhash, toxicity
from memlattice.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((docs, out))
        docs = out
    assert all(out.columns == columns for _, out in seen[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    before, after = seen[0]
    good = {r.doc_id for r in quality.score(before, quality.train(before, labels)).collect() if r.score >= 0.7}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen[1]
    civil = {r.doc_id for r in toxicity.score(before, toxicity.train(before, labels)).collect() if r.score < 0.3}
    assert {r.doc_id for r in after.collect()} == civil
    before, after = seen[2]
    assert before.count() == after.count() and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen[3]
    assert {r.doc_id for r in after.collect()} == {r.component for r in simhash.near_duplicates(before).collect()}
    before, after = seen[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    total, bins = sum(r.length for r in after.collect()), {r.sequence_id for r in after.collect()}
    assert len(bins) == -(-total // 2048)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns whose names the stages use themselves."""
    rows = [(1, None, 0), (2, "", 0), (3, "one text", 8), (3, "one text", 8), (None, "no id", 5), (4, "one text", 8), (5, " ".join(f"w{i % 500}" for i in range(30_000)), 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, doc string, score double, _removed string, id string, comp string, `a.b` int"
    docs = spark.createDataFrame([(i, t, None, None, n, "d", 0.5, "r", "i", "c", 1) for i, t, n in rows], kind)
    for k, (_, stage) in enumerate(P.STAGES):
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            before = docs.count()
    assert before >= 3 and docs.where("doc_id IS NULL").count() == 1 and docs.where("doc_id = 3").count() == 1


def test_one_of_each_group_stays_where_ids_repeat_or_lack(spark):
    text = lambda k: " ".join(f"{'abcdefgh'[k]}{i * (k + 3) % 97}" for i in range(60))
    rows = [(1, text(0)), (1, text(1)), (1, text(1)), (2, text(1)), (None, text(2)), (None, text(2)), (None, text(0)), (None, text(3))]
    docs = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, doc string")
    got = sorted(((r.doc_id or 0, r.text) for r in P.keep_one_of_each(spark, docs, SF).collect()))
    assert got == sorted([(1, text(0)), (1, text(1)), (0, text(2)), (0, text(3))])


def test_lines_go_without_a_count_of_characters(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.drop_repeated_lines(spark, docs, SF).collect()}
    assert got[1] == "a\nb\nc\nd" and got[2] == "" and got[3] is None
