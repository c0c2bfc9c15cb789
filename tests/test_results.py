"""Case results, import logs and plug-ins on small tables."""

import pytest
from pyspark.sql import functions as F

from citeplane.operators import results, surfaces as sf
from citeplane.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


def test_sets_and_reviews(spark):
    rows = spark.createDataFrame([("answered", ["a"], ["a", "b"]), ("not_mentioned", ["b"], ["a", "b"]), ("not_mentioned", ["b", "a"], ["a", "b"]), ("answered", ["c"], ["a"]), ("answered", [], [])], "status string, reviewed array<string>, sources array<string>")
    got = [r[0] for r in rows.select(results.review_error(F.col("status"), F.col("reviewed"), F.col("sources"))).collect()]
    assert got == [None, "incomplete_review", None, "invalid_context", None]


def test_readings_of_unknown(spark):
    asked = spark.createDataFrame([("c", "m1"), ("c", "m2"), ("c", "m1")], "case_id string, mention_id string")
    mentions = asked.where("mention_id = 'm1'").distinct()
    readings = spark.createDataFrame([("c", "m1", "r2"), ("c", "m1", "r1"), ("c", "m2", "r3")], "case_id string, mention_id string, reading_id string")
    found, unknown = results.readings_of(asked, mentions, readings)
    assert sorted((r["reading_id"], r["place"]) for r in found.collect()) == [("r1", 1), ("r2", 2)]
    assert [(r["mention_id"], r["code"]) for r in unknown.collect()] == [("m2", "unknown_reference")]


def test_load_compares(spark):
    parts = plans._result_parts(plans.Tables(spark, SMALL))
    made, errors = results.create(*parts)
    made = made.cache()
    back, none = results.load(made, *parts)
    assert back.count() == made.count() > 0 and none.count() == 0
    other, wrong = results.load(made.withColumn("run_id", F.lit("run9")), *parts)
    assert other.count() == 0 and {r["code"] for r in wrong.collect()} == {"invalid_schema"}
    assert errors.count() + made.count() == parts[0].count()
    made.unpersist()


def test_no_claim_and_events(spark):
    cases = spark.createDataFrame([("c", ["s"], "synthetic")], "case_id string, source_ids array<string>, sensitivity string")
    row = results.no_claim(cases, "v", "not_mentioned", "nothing said", "run").first()
    assert (row["status"], row["reviewed"], row["final_claim_ids"]) == ("not_mentioned", ["s"], [])
    with pytest.raises(ValueError):
        results.no_claim(cases, "v", "answered", "why", "run")
    events = spark.createDataFrame([("c", "review.submit", "r")], "case_id string, action string, role string")
    both = results.with_outcome_events(events, cases.select("case_id"))
    assert [(r["action"], r["role"]) for r in both.orderBy("action").collect()] == [("outcome.set", None), ("review.submit", "r")]


def test_import_refuses_failed(spark):
    made = spark.createDataFrame([("a", "r", [("v", "failed")]), ("b", "r", [("v", "answered")])], "case_id string, run_id string, outcomes array<struct<variable:string,status:string>>")
    none = spark.createDataFrame([], "case_id string, mention_id string, reading_id string, claim_id string, rank int, status string")
    events, refused = results.import_events(made, none.select("case_id", "mention_id"), none, none, "tool:x")
    assert [r["case_id"] for r in refused.collect()] == ["a"]
    assert [(r["case_id"], r["action"]) for r in events.orderBy("seq").collect()] == [("b", "import.result"), ("b", "outcome.set"), ("b", "tier.set")]


def test_calls_and_budgets(spark):
    class Script:
        capabilities = frozenset({"tools"})

        def complete(self, request, attempt):
            if request["say"] == "raise":
                raise OSError
            if request["say"] == "odd":
                return None
            if request["say"] == "later" and attempt < 2:
                return sf.Answer(kind="provider", reason="busy", retryable=True, tokens=1)
            return sf.Answer(text=request["say"], tokens=10)

    one = lambda say, budget=sf.Budget(), **more: sf.ask(Script(), {"say": say, **more}, sf.Meter(budget))
    assert one("hello") == (sf.Answer(text="hello", tokens=10), 1)
    assert (one("raise")[0].reason, one("odd")[0].reason) == ("unexpected_error", "invalid_response")
    assert one("x", needs=["logprobs"]) == (sf.Answer(kind="provider", reason="capability_missing"), 0)
    assert one("later")[0].reason == "busy" and one("later", sf.Budget(retries=1))[1] == 2 and one("later", sf.Budget(retries=5)) == (sf.Answer(text="later", tokens=10), 3)
    assert one("x", sf.Budget(calls=0)) == (sf.Answer(kind="budget", reason="budget_exhausted"), 0)
    assert one("x", sf.Budget(tokens=9))[0].kind == "budget" and one("x", json=True)[0].reason == "invalid_json" and one("{}", json=True)[0].text == "{}"
    requests = spark.createDataFrame([("a", i, "x") for i in range(4)] + [("b", i, "y") for i in range(2)], "case_id string, call long, say string")
    got = sorted((r["case_id"], r["call"], r["kind"], r["tokens"]) for r in sf.ask_all(requests, Script, sf.Budget(tokens=25)).fillna("").collect())
    assert got == [("a", 0, "", 10), ("a", 1, "", 20), ("a", 2, "budget", 30), ("a", 3, "budget", 40), ("b", 0, "", 10), ("b", 1, "", 20)]


def test_plug_ins(spark):
    class Silver:
        tier = "silver"

        def label(self, cases):
            return cases

    class Half:
        def run(self, cases):
            return cases.where("case_id = 'a'").selectExpr("case_id", "'v' AS variable", "'answered' AS status", "'1' AS value", "CAST(NULL AS STRING) AS failure_kind")

        def score(self, predicted, reference):
            return predicted.selectExpr("'n' AS name", "1 AS value")

    assert sf.admit(Silver())
    for bad in (object(), type("Gold", (Silver,), {"tier": "adjudicated"})()):
        with pytest.raises(sf.Rejected):
            sf.admit(bad)
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    got = sorted((r["case_id"], r["status"], r["failure_kind"]) for r in sf.extract(Half(), cases, ["v"]).collect())
    assert got == [("a", "answered", None), ("b", "failed", "provider")]
    with pytest.raises(sf.Rejected):
        sf.extract(Half(), cases, ["w"])
    assert sf.score(Half(), cases.limit(1), cases).first()["value"] == 1.0
    with pytest.raises(sf.Rejected):
        sf.score(Half(), cases, cases)
