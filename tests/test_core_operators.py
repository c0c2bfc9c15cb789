"""Operators against hand-computed rows and small independent models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citeplane.operators import binary, cases, graph, grounding, policy, replay, rules, scores, span_scores
from citeplane.streaming.replay import replay_stream


def spans_of(spark, gold, pred, kind="finding"):
    rows = [(s, "c", "s", k if len(x) > 2 else kind, [(x[0], x[1])], []) for s, xs in (("gold", gold), ("pred", pred)) for x in xs for k in [x[-1]]]
    return spark.createDataFrame(rows, "side string, case_id string, source_id string, mention_type string, pieces array<struct<start:bigint,end:bigint>>, attributes array<struct<category:string,value:string>>")


@pytest.mark.parametrize(
    "gold, pred, strict, lenient",
    [
        ([(0, 4), (10, 14), (20, 24)], [(0, 4), (11, 14), (30, 34)], (1, 3), (2, 3)),
        ([(0, 4)], [(4, 8)], (0, 1), (0, 1)),
        ([(0, 6)], [(0, 3), (2, 6)], (0, 2), (1, 2)),
        ([(0, 10), (0, 3)], [(0, 10), (5, 6)], (1, 2), (2, 2)),
        ([(0, 3), (5, 9)], [(0, 10), (1, 2)], (0, 2), (2, 2)),
        ([], [], (0, 0), (0, 0)),
    ],
)
def test_span_precision(spark, gold, pred, strict, lenient):
    got = {r["name"]: (int(r["numerator"]), r["denominator"]) for r in span_scores.span_metrics(spans_of(spark, gold, pred)).collect()}
    assert got["strict_precision"] == strict and got["lenient_precision"] == lenient


def test_span_macro(spark):
    got = {r["name"]: (r["numerator"], r["denominator"]) for r in span_scores.span_metrics(spans_of(spark, [(0, 4), (10, 14)], [(0, 4), (20, 24, "site")])).collect()}
    assert got["strict_macro_precision"] == (1.0, 2) and got["strict_macro_recall"] == (0.5, 1)
    assert got["strict_macro_f1"] == (pytest.approx(2 / 3), 2)


def brute_matching(edges):
    best = 0
    for mask in range(1 << len(edges)):
        chosen = [e for i, e in enumerate(edges) if mask >> i & 1]
        if len({a for a, _ in chosen}) == len(chosen) == len({b for _, b in chosen}):
            best = max(best, len(chosen))
    return best


def test_matching():
    rng = random.Random(1)
    for _ in range(150):
        edges = list({(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(9))})
        assert span_scores.maximum_matching(edges) == brute_matching(edges)
    assert span_scores.maximum_matching([e for i in range(1200) for e in ((i, i), (i, i + 1))]) == 1200


def test_binary_worked_example(spark):
    ids_ = [str(i) for i in range(1, 11)]
    gold = [(i, v) for i, v in zip(ids_, [True] * 4 + [False] * 4 + [None] * 2)]
    pred = [(i, "answered", v, None) for i, v in zip(["1", "2", "3", "5", "6", "7"], [True] * 3 + [False] * 3)] + [(i, "not_mentioned", None, None) for i in ("4", "8", "9", "10")]
    rows = binary.joined(spark.createDataFrame([(i,) for i in ids_], "case_id string"), spark.createDataFrame(gold, "case_id string, value boolean"), spark.createDataFrame(pred, "case_id string, status string, value boolean, failure_kind string"))
    counts = binary.counts(rows)
    c = counts.first()
    assert [c[k] for k in ("N", "B", "P", "Q", "A", "C", "A_pos", "TP", "FP", "O")] == [10, 8, 4, 4, 6, 6, 3, 3, 0, 2]
    m = {r["name"]: r["value"] for r in binary.measures(counts, cost=5.0).collect()}
    assert (m["precision"], m["ppv"], m["recall"], m["omission_rate"], m["coverage"], m["correct_yield"], m["mean_cost"]) == (1.0, 1.0, 0.75, 0.25, 0.6, 0.6, 0.5)
    specs = spark.createDataFrame([("p", "precision", "ge", 0.95), ("r", "recall", "ge", 0.85), ("f", "false_positives", "eq", 0.0)], "name string, measure string, op string, threshold double")
    results = binary.gates(specs, binary.measures(counts), False, False)
    assert {r["name"]: r["status"] for r in results.collect()} == {"p": "met", "r": "unmet", "f": "met"}
    assert binary.overall(results).first()[0] == "unmet"
    soft = binary.gates(specs, binary.measures(counts), True, False)
    assert {r["name"]: (r["status"], r["observed_pass"]) for r in soft.collect()} == {"p": ("inconclusive", True), "r": ("unmet", False), "f": ("inconclusive", True)}


def test_bootstrap_matches_plain_resampling(spark):
    ids_ = [f"{i:02d}" for i in range(12)]
    gold = {i: int(i) % 3 != 0 for i in ids_}
    pred = {i: int(i) % 4 != 0 for i in ids_ if int(i) % 5}
    rows = binary.joined(spark.createDataFrame([(i,) for i in ids_], "case_id string"), spark.createDataFrame(list(gold.items()), "case_id string, value boolean"), spark.createDataFrame([(i, "answered", v, None) for i, v in pred.items()], "case_id string, status string, value boolean, failure_kind string"))
    got = {r["name"]: r for r in binary.bootstrap(rows, resamples=40, seed=7).collect()}
    values = []
    draws = list(binary.resampled(ids_, 40, 7))
    for r in range(40):
        own = [i for k, i in draws if k == r]
        tp, p = sum(gold[i] and pred.get(i, False) for i in own), sum(gold[i] for i in own)
        values.append(tp / p if p else None)
    defined = sorted(v for v in values if v is not None)
    at = lambda q: (lambda x: defined[int(x)] + (defined[min(int(x) + 1, len(defined) - 1)] - defined[int(x)]) * (x - int(x)))(q * (len(defined) - 1))
    assert got["recall"]["low"] == pytest.approx(at(0.025)) and got["recall"]["high"] == pytest.approx(at(0.975))


def test_regression_boundary(spark):
    schema = "name string, numerator double, denominator long"
    base = scores.baseline_from(spark.createDataFrame([("f1", 160.0, 200), ("cost", 500.0, 10), ("gone", 1.0, 1), ("none", 0.0, 0)], schema), ("cost",))
    def run(f1, cost):
        now = spark.createDataFrame([("f1", f1, 200), ("cost", cost, 10), ("new", 1.0, 1)], schema)
        return {r["name"]: r["status"] for r in scores.compare(now, base).collect()}, scores.untracked(now, base).collect()
    status, new = run(159.0, 500.0)
    assert status == {"f1": "passed", "cost": "passed", "gone": "missing"} and new[0][0] == "new"
    assert run(158.0, 501.0)[0] == {"f1": "regressed", "cost": "regressed", "gone": "missing"}


def closed(nodes, deps):
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for c in deps.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        reach[n] = seen
    return reach


def test_graphs(spark):
    rng = random.Random(3)
    nodes, deps = [], []
    for case in ("a", "b", "c"):
        names = [f"{case}{i}" for i in range(7)]
        for i, n in enumerate(names):
            kind = "inclusion" if i < 2 else "inference" if i < 4 else "claim"
            nodes.append((case, n, kind, None if kind != "claim" else rng.choice(["proposed", "rejected"]), f"v{i % 2}"))
            if i >= 2:
                deps += [(case, n, rng.choice(names)) for _ in range(2) if rng.random() < 0.8]
    deps = [d for d in dict.fromkeys(deps) if d[1] != d[2] or rng.random() < 0.5]
    n = spark.createDataFrame(nodes, "case_id string, node_id string, kind string, status string, variable string")
    d = spark.createDataFrame(deps, "case_id string, parent_id string, child_id string")
    children = {}
    for _, p, c in deps:
        children.setdefault(p, set()).add(c)
    want = closed([x[1] for x in nodes], children)
    got = graph.closure(d)
    assert {(r["root_id"], r["node_id"]) for r in got.collect()} == {(a, b) for a, bs in want.items() for b in bs}
    kinds = {x[1]: x[2] for x in nodes}
    cyclic = {x for x in want if x in want[x]}
    on_cycle = {x for x in want if x in cyclic or want[x] & cyclic}
    codes = {r["node_id"]: r["code"] for r in graph.peel(n, d).collect()}
    assert {k for k, v in codes.items() if v == "cycle"} == on_cycle
    backed = lambda x: kinds[x] == "inclusion" or bool(children.get(x)) and all(backed(c) for c in children[x])
    assert {k for k, v in codes.items() if v != "cycle"} == {x for x in want if x not in on_cycle and not backed(x)}
    chain = spark.range(300).selectExpr("'z' case_id", "cast(id as string) parent_id", "cast(id + 1 as string) child_id")
    assert graph.closure(chain).where("root_id = '0'").count() == 300


def event(i, action, role="reviewer", actor="human:a", target=None, after=None, before=None, variable=None, reason=None, case="c", **more):
    return {"case_id": case, "event_id": f"{i:026d}", "variable": variable, "actor": actor, "role": role, "action": action, "target_id": target, "before": json.dumps(before) if before else None, "after": json.dumps(after) if after is not None else None, "reason": reason, "round": 1, "stream": None} | more


SCHEMA = "case_id string, event_id string, variable string, actor string, role string, action string, target_id string, before string, after string, reason string, round long, stream string"


def claim(name, producer="model:m"):
    return {"claim": {"claim_id": name, "status": "proposed", "provenance": {"producer": producer}}}


HISTORY = [
    event(1, "import.result", "importer", "model:m"),
    event(2, "claim.create", "importer", "model:m", after=claim("k1")),
    event(3, "outcome.set", "importer", "model:m", variable="v", after={"outcome": {"status": "answered"}, "final_claim_ids": ["k1"]}),
    event(4, "tier.set", "importer", "model:m", variable="v", after={"tier": "silver"}),
    event(5, "review.submit"),
    event(6, "tier.set", variable="v", after={"tier": "single_review"}),
]


def test_replay(spark):
    good = replay.replay(spark.createDataFrame(HISTORY, SCHEMA)).first()
    state = json.loads(good["state"])
    assert good["error_code"] is None and state["claims"] == {"k1": "gold"} and state["tiers"] == {"v": "single_review"}
    for extra, code in [
        (event(7, "tier.set", variable="v", after={"tier": "silver"}, role="importer"), "invalid_transition"),
        (event(7, "outcome.set", "importer", "model:m", variable="v", after={"outcome": {"status": "failed"}, "final_claim_ids": []}), "invalid_role"),
        (event(7, "claim.create", after=claim("k2")), "invalid_role"),
        (event(7, "claim.set_status", target="k9", after={"status": "verified"}), "unknown_reference"),
        (event(7, "adjudication.resolve", "adjudicator", target="k1", after={"status": "rejected"}), "invalid_transition"),
        (event(7, "edge.add", after={"edge": {"claim_id": "k1", "evidence_id": "e"}}), "invalid_transition"),
        (event(7, "adjudication.resolve", after=None), "invalid_role"),
        (event(7, "nothing.known"), "invalid_schema"),
    ]:
        got = replay.replay(spark.createDataFrame([*HISTORY, extra], SCHEMA)).first()
        assert (got["error_code"], got["error_event"]) == (code, extra["event_id"]), extra
    again = replay.replay(spark.createDataFrame([*HISTORY, HISTORY[4]], SCHEMA)).first()
    assert again["error_code"] == "event_order"


def test_prefixes_and_snapshots(spark):
    events = spark.createDataFrame(HISTORY, SCHEMA)
    asked = spark.createDataFrame([(f"s{i}", "c", f"{i:026d}") for i in (2, 4, 6)], "snapshot_id string, case_id string, as_of string")
    states = {}
    for i in (2, 4, 6):
        states[f"s{i}"] = replay.fold(HISTORY[:i])[0].summary()
    snaps = asked.join(spark.createDataFrame(list(states.items()), "snapshot_id string, state string"), "snapshot_id")
    assert replay.verify_snapshots(snaps, events).count() == 0
    assert replay.verify_snapshots(snaps.withColumn("state", F.lit("{}")), events).count() == 3


def test_visibility(spark):
    rows = [event(1, "claim.create", stream="a"), event(2, "claim.create", stream="b"), event(3, "claim.create", "importer", "model:m"), event(4, "claim.create", "adjudicator")]
    see = lambda xs, role, streams=(): sorted(int(r["event_id"]) for r in replay.visible(spark.createDataFrame(xs, SCHEMA), role, streams).collect())
    assert see(rows, "reviewer", ("a",)) == [1, 3] and see(rows, "reviewer") == [3] and see(rows, "adjudicator") == [1, 2, 3, 4]
    assert see([*rows, event(5, "adjudication.resolve", "adjudicator")], "reviewer", ("a",)) == [1, 2, 3, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame(HISTORY[:3], SCHEMA).coalesce(1).write.parquet(str(folder))
    spark.createDataFrame(HISTORY[3:], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = replay_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = spark.sql("SELECT * FROM folded ORDER BY as_of DESC").first()
    assert got["error_code"] is None or got["error_code"] == "event_order"  # files may arrive in either order
    if got["error_code"] is None:
        assert got["state"] == replay.replay(spark.createDataFrame(HISTORY, SCHEMA)).first()["state"]


def test_policy_order(spark):
    none = []
    def row(**x):
        base = {"sensitivity": "phi", "zone": "local", "kind": "k", "accepts": ["a"], "trains_on_inputs": True, "tags": none, "payload": "a", "policy_version": None}
        return base | x
    r = {"id": "r1", "forbids_zones": none, "forbids_kinds": none, "forbids_training": True, "requires_tags": none, "forbids_payloads": none, "valid_until": None}
    rows = [row(policy_version="9"), row(sensitivity="?"), row(zone="external"), row(payload="b"), row(), row(trains_on_inputs=False)]
    df = spark.createDataFrame([x | {"restrictions": [r], "i": i} for i, x in enumerate(rows)], f"sensitivity string, zone string, kind string, accepts array<string>, trains_on_inputs boolean, tags array<string>, payload string, policy_version string, restrictions {policy.RESTRICTION}, i int").withColumn("now", F.current_timestamp())
    got = policy.decide(df, policy.matrix(spark), "1").orderBy("i").collect()
    assert [x["reason"] for x in got] == ["policy_version_mismatch", "unknown_sensitivity", "zone_not_allowed", "payload_not_accepted", "restriction_training", "ok"]
    assert [x["restriction_id"] for x in got] == [None] * 4 + ["r1", None]
    with pytest.raises(policy.PolicyRefused):
        policy.require(policy.decide(df, policy.matrix(spark), "1"))


def test_rule_precedence(spark):
    table = spark.createDataFrame([("S1", "N0", "I")], "T string, N string, value string")
    spec = rules.RuleSpec("r", "1", {"T": rules.Role("t"), "N": rules.Role("n", on_missing="default")}, "stage", {"N": "N0"})
    rows = [("a", "1", "t", "S1"), ("a", "2", "t", "S1"), ("b", "3", "t", "S1"), ("b", "4", "t", "S2"), ("c", "5", "n", "N0"), ("d", "6", "t", "S9")]
    claims = spark.createDataFrame([(*x, "proposed") for x in rows], "case_id string, claim_id string, variable string, value string, status string")
    rule = rules.TableRule(spec, table, suffix="x")
    got = {r["case_id"]: (r["status"], r["value"], r["inputs"]) for r in rules.derive(rule, claims).collect()}
    assert got["a"] == ("answered", "Ix", ["1", "2"]) and got["b"][0] == "conflicting_evidence"
    assert got["c"][0] == "insufficient_evidence" and got["d"][0] == "insufficient_evidence"
    later = rules.RuleSpec("s", "1", {"stage": rules.Role("stage")}, "last")
    both = rules.derive_all([rules.TableRule(later, spark.createDataFrame([("Ix", "end")], "stage string, value string")), rule], claims)
    assert {(r["case_id"], r["status"]) for r in both.where("variable = 'last'").collect()} >= {("a", "answered"), ("b", "conflicting_evidence")}


def test_labels_only(spark):
    assert cases.is_closed({"type": "object", "additionalProperties": False, "properties": {"x": {"$ref": "#/$defs/b"}}, "$defs": {"b": {"anyOf": [{"type": "boolean"}, {"type": "null"}]}}})
    assert not cases.is_closed({"type": "object", "additionalProperties": False, "properties": {"x": {"type": "string"}}})
    out = spark.createDataFrame([("c", "v", "answered", ["1", "2"], "m"), ("c", "w", "failed", [], "m"), ("c", "x", "answered", ["3"], "m")], "case_id string, variable string, status string, final_claim_ids array<string>, producer string")
    claims = spark.createDataFrame([("c", "1", "a", "p"), ("c", "2", "b", "p"), ("c", "3", "a", "p")], "case_id string, claim_id string, value string, producer string")
    good, bad = cases.labels_only(out, claims, spark.createDataFrame([("v",), ("x",)], "variable string"))
    assert [(r["variable"], r["value"]) for r in good.collect()] == [("x", "a")] and [r["code"] for r in bad.collect()] == ["several_answer_values"]


def test_grounding_statuses(spark):
    note = "Alpha \U0001f600 mass\r\nmáss and mass"
    rows = [("mass", None, "ambiguous"), ("mass", 8, "ok"), ("Alpha", None, "ok"), ("zzz", None, "not_found"), ("", None, "empty_candidate"), ("mass", 9, "hint_mismatch"), ("mass", 99, "hint_out_of_bounds"), ("\U0001f600 mass\r\n", None, "ok")]
    df = spark.createDataFrame([("s", note, c, h, w, i) for i, (c, h, w) in enumerate(rows)], "source_id string, text string, candidate string, hint_start int, want string, i int")
    got = grounding.ground(df).orderBy("i").collect()
    assert [r["status"] for r in got] == [r["want"] for r in got]
    assert got[0]["match_starts"] == [8, 23] and (got[7]["start"], got[7]["end"]) == (6, 14)
    assert grounding.ground(df.withColumn("text", F.lit(None).cast("string"))).where("status = 'source_not_text'").count() == len(rows)
