"""Stems, postings and ranks; tenants' policies and schemas as tables."""

import pytest
from pyspark.sql import functions as F

from memlattice.functions.stem import STOP_WORDS, query_stems, stem
from memlattice.operators import ingest as I
from memlattice.operators import rules as Rules
from memlattice.operators import search as Search

STEMS = """consign consign|consigned consign|consistency consist|consolations consol|consolatory consolatori|console consol|knackeries knackeri|knavery knaveri|knightly knight|knitting knit|running run
hopping hop|hoping hope|happiness happi|relational relat|flies fli|generously generous|generation generat|skies sky|ties tie|cries cri|agreed agre|feed feed|luxuriated luxuri|by by|say say|cry cri|rational ration
digitizer digit|operator oper|decisiveness decis|callousness callous|formality formal|triplicate triplic|formative format|replacement replac|adoption adopt|rate rate|controlling control|roll roll|apology apolog
boyish boyish|proceed proceed|innings inning|gas gas|gaps gap|kiwis kiwi|news news|dying die|dogs2 dogs2|ñus ñus"""


def test_stems():
    pairs = [p.split() for line in STEMS.splitlines() for p in line.split("|")]
    assert {w: stem(w) for w, _ in pairs} == dict(pairs)
    assert query_stems("The Running of THE runs, and runner") == ["run", "runner"] and "the" in STOP_WORDS


def indexed(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id long, title string, content string, tags array<string>")
    parts = {"A": F.col("title"), "B": F.col("content"), "C": F.array_join("tags", " ")}
    return Search.written(Search.postings(df, "id", parts), str(tmp_path / "postings"))


def test_search(spark, tmp_path):
    rows = [(1, "Running shoes", "he runs", ["sport"]), (2, None, "they run in shoes", None), (3, "", "a shoe", ["run"]), (4, "the of", None, []), (5, "walk", "walked walking", ["walks"])]
    found = indexed(spark, tmp_path, rows)
    hits = lambda q: [r.id for r in Search.search(found, "id", q).orderBy(F.desc("score"), "id").collect()]
    assert hits("running shoe") == [1, 2, 3] and hits("run") == [1, 2, 3]
    assert hits("the of") == [] and hits("") == [] and hits("run walk") == [] and hits("Walks the") == [5]
    plan = Search.search(found, "id", "running shoe")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stem" in plan and "content" not in plan


def test_rank_reads_weights_in_order(spark, tmp_path):
    found = indexed(spark, tmp_path, [(1, "x y", "x x", ["x"]), (2, "z", "x", [])])
    got = {r.id: r.weights for r in found.where("stem = 'x'").collect()}
    assert got == {1: [1.0, 0.4, 0.4, 0.2], 2: [0.4]}
    score = {r.id: r.score for r in Search.search(found, "id", "x").collect()}
    assert score[1] == pytest.approx((1.0 + 0.4 / 4 + 0.4 / 9 + 0.2 / 16) / 1.64493406685) and score[2] == pytest.approx(0.4 / 1.64493406685)


def test_policies_of_tenants(spark):
    own = spark.createDataFrame([("a", "crm-agent", ["fact"], [r"\bsecret\b"], {"fact": 0.9}), ("b", "mine", [], [], {})], Rules.POLICY)
    rows = [(1, "a", "crm-agent", "fact", "a Secret thing"), (2, "a", "crm-agent", "fact", "secretly"), (3, "b", "crm-agent", "fact", " Hello "), (4, "b", "crm-agent", "contact", "hello you"), (5, "b", "mine", "fact", "x"), (6, "a", "mine", "goal", "x"), (7, "a", None, "goal", "x")]
    df = spark.createDataFrame(rows, "id long, organization_id string, policy string, kind string, content string")
    out = Rules.with_policy(df, own).select("id", Rules.accepts(F.col("rules"), F.col("kind"), F.col("content")).alias("ok"), Rules.priority(F.col("rules"), F.col("kind"), F.lit(0.1)).alias("w"))
    got = {r.id: (r.ok, r.w) for r in out.collect()}
    assert got == {1: (False, 0.9), 2: (True, 0.9), 3: (False, 0.1), 4: (True, 0.9), 5: (False, 0.1), 6: (True, 0.1), 7: (True, 0.1)}


def test_schemas_of_tenants_are_the_compiled_ones(spark):
    schema = {"fields": [{"name": "a", "type": "string"}, {"name": "b", "type": "number"}, {"name": "c", "type": "enum", "values": ["x"]}, {"name": "d", "type": "date"}, {"name": "e", "type": "array"}, {"name": "f", "type": "boolean"}, {"name": "g", "type": "object"}], "required": ["b", "z"]}
    bodies = ["{}", '{"a": 1, "b": true, "c": "y", "d": "2023-02-29", "e": {}, "f": 0, "g": []}', '{"a": "t", "b": 1.5, "c": "x", "d": "2024-02-29", "e": [], "f": false, "g": {}, "z": 1, "more": 2}', '{"a": null, "b": null, "z": "q"}']
    table = spark.createDataFrame([("t", "s", [(f["name"], f["type"], f.get("values")) for f in schema["fields"]], schema["required"])], Rules.SCHEMA)
    df = spark.createDataFrame([(k, "t", b) for k, b in enumerate(bodies)], "id int, organization_id string, data string").join(table, "organization_id")
    rows = df.select(Rules.schema_errors(F.col("data"), F.col("fields"), F.col("required")).alias("a"), I.schema_errors(F.parse_json("data"), schema).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows) and [] in [r.a for r in rows]


def test_words_are_not_shuffled(spark, tmp_path):
    """postings are made where the texts are and written there; each file is sorted by stem."""
    df = spark.range(300).selectExpr("id", "concat('running shoes ', id) AS t").repartition(3)
    found = Search.postings(df, "id", {"A": F.col("t"), "B": F.col("t")})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of repartition()
    table = Search.written(found, str(tmp_path / "postings"))
    assert len(table.inputFiles()) == 3 and table.where("stem = 'run'").count() == 300
    for f in table.inputFiles():
        stems = [r.stem for r in spark.read.parquet(f).collect()]
        assert stems == sorted(stems)


def test_terms_that_no_query_asks_for_do_not_travel(spark):
    """F9"""
    from memlattice.operators import retrieval as R

    df = spark.createDataFrame([("the and", "of tea and coffee", ["x"])], "title string, content string, tags array<string>")
    assert R.with_terms(df, F.array(F.lit("and"), F.lit("milk"), F.lit("x"))).first().terms == ["and", "x"]
