"""Queries over whole tables: each row that a query's tables hold counts, held against Python over the raw rows."""

import hashlib
import json
from collections import defaultdict

from citeplane.operators import binary
from citeplane.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def rows_of(duck, text):
    return duck.execute(text).fetchall()


def by_user(duck):
    out = defaultdict(list)
    for user, event, kind in rows_of(duck, "SELECT user_id, event_id, event_type FROM events ORDER BY event_id"):
        out[str(user)].append((event, kind))
    return out


def test_all_events_fold(spark, duck):
    users = by_user(duck)
    want_full, want_status, want_case = {}, {}, {}
    for user, events in users.items():
        state, error = "proposed", None
        for event, kind in events[1:]:
            if kind == "view":
                state, error = ("verified", None) if state == "proposed" else (state, event)
            elif kind == "purchase":
                state, error = ("gold", None) if state in ("proposed", "verified") else (state, event)
            if error is not None:
                break
        want_full[user] = (state, None if error is None else f"{error:012d}")
        state, error = "proposed", None
        for event, kind in events:
            to = {"click": "gold", "purchase": "rejected"}.get(kind, "verified")
            if event % 3 == 0:
                legal = (state in ("proposed", "verified") and to in ("gold", "rejected")) or (state == "gold" and to == "rejected" and event % 2 == 0)
            else:
                legal = state == "proposed" and to in ("verified", "rejected")
            if not legal:
                error = event
                break
            state = to
        want_status[user] = (state, error)
        worst = min("error click signup view".split().index(k) if k in ("error", "click", "signup", "view") else 4 for _, k in events)
        want_case[user] = ("failed", "conflicting_evidence", "insufficient_evidence", "not_mentioned", "answered")[worst]
    assert {r["case_id"]: (r["status"], r["error_event"]) for r in QUERIES["replay_full"](spark, SMALL).collect()} == want_full
    assert {r["record_id"]: (r["status"], r["error_seq"]) for r in QUERIES["status_machine"](spark, SMALL).collect()} == want_status
    assert {r["case_id"]: r["status"] for r in QUERIES["case_status"](spark, SMALL).collect()} == want_case
    assert sorted(r["seq"] for r in QUERIES["tier_machine"](spark, SMALL).collect()) == sorted(e for x in users.values() for e, _ in x)


def test_all_orders_hash(spark, duck):
    lines = []
    for key, at, customer, status in sorted(rows_of(duck, "SELECT CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ'), o_custkey, o_orderstatus FROM orders")):
        row = {"decision_id": key, "checked_at": at, "permitted": int(key) % 2 == 0, "reason": status, "case_id": str(customer), "policy_version": "1", "destination": "d", "destination_kind": "k", "zone": "local", "sensitivity": "synthetic", "payload": "labels_only", "restriction_id": None, "dataset": None, "run_id": None}
        lines.append(json.dumps(row, sort_keys=True, separators=(",", ":")))
    got = QUERIES["content_hash"](spark, SMALL).collect()[0]
    assert (got["rows"], got["content"]) == (len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_all_documents_split(spark, tmp_path):
    docs = [(5, "a", "en"), (6, "a", "en"), (7, "b", "en"), (9, "b", "en"), (3, "c", "de"), (44, "c", "de")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["split_conflicts"](spark, str(tmp_path)).select("dataset", "source_id", "splits").collect()
    assert sorted(tuple(r) for r in got) == [("a", "en", 2), ("c", "de", 2)]


def section_bounds(spark, where):
    """Documents whose marks end where half or a quarter of a text does, written to where; with each mark's innermost
    section and the marks outside their required one, bounds rounded, halves to the even number."""
    docs, innermost, outside = [], {}, set()
    for key in range(600):
        lang = ("fr", "de")[key % 2]
        start = key * 37 % 100
        end = start + 5 + key % 11
        n = 2 * end + key % 7 - 3 if key % 4 < 2 else 4 * start + key % 9 - 4
        docs.append((key, lang, n))
        sections = [("note", 0, n), ("history", 0, round(n / 2)), ("findings", round(n / 4), round(n / 2))]
        held = [(b - a, -a, name) for name, a, b in sections if a <= start and end <= b]
        if held:
            innermost[key] = min(held)[2]
        if {"fr": "findings", "de": "history"}[lang] not in {name for *_, name in held}:
            outside.add(str(key))
    spark.createDataFrame(docs, "doc_id long, lang string, n_chars long").write.parquet(f"{where}/documents.parquet")
    return innermost, outside


def test_all_innermost_sections(spark, tmp_path):
    innermost, _ = section_bounds(spark, tmp_path)
    assert {r["mark_id"]: r["section_category"] for r in QUERIES["section_innermost"](spark, str(tmp_path)).collect()} == innermost


def test_all_required_sections(spark, tmp_path):
    _, outside = section_bounds(spark, tmp_path)
    assert {r["claim_id"] for r in QUERIES["section_required"](spark, str(tmp_path)).collect()} == outside


def test_all_orders_support(spark, duck):
    above = {f"n{n}": f"r{r}" for n, r in rows_of(duck, "SELECT n_nationkey, n_regionkey FROM nation")}
    above |= {f"c{c}": f"n{n}" for c, n in rows_of(duck, "SELECT c_custkey, c_nationkey FROM customer") if c % 17}
    orders = {f"o{o}": f"c{c}" for o, c in rows_of(duck, "SELECT o_orderkey, o_custkey FROM orders")}
    above |= orders
    reach = set()
    for node in above:
        at = node
        while at in above:
            at = above[at]
            reach.add((node, at))
    leaves = {x for x in reach if x[1][0] == "r"}
    orphans = {f"c{c}" for (c,) in rows_of(duck, "SELECT c_custkey FROM customer") if c % 17 == 0}
    pairs = lambda name, *columns: {tuple(r[c] for c in columns) for r in QUERIES[name](spark, SMALL).collect()}
    assert len(orders) > 1000 and pairs("support_closure", "root_id", "node_id") == reach
    assert pairs("source_leaves", "root_id", "node_id") == leaves
    assert pairs("live_support", "node_id") == {(o,) for o, c in orders.items() if int(c[1:]) % 10 == 0}
    assert pairs("acyclic_backed", "node_id", "code") == {(o, "orphaned_claim") for o in orphans | {o for o, c in orders.items() if c in orphans}} | {(f"x{i}", "cycle") for i in (1, 2, 3)}
    assert pairs("case_propagation", "node_id", "case_id") == leaves | {(f"r{r}",) * 2 for (r,) in rows_of(duck, "SELECT r_regionkey FROM region")}


def test_all_parts_derive(spark, duck):
    cases, inputs = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for size, part in rows_of(duck, "SELECT p_size, p_partkey FROM part"):
        kind = ("size", "node", "spread")[part % 3]
        value = {"size": "S2" if size % 3 else "S1", "node": "N1" if (size + part / 1500) % 4 < 1 else "N0", "spread": "M0"}[kind]
        cases[str(size)]
        if part % 4:
            cases[str(size)][kind].add(value)
    want = {}
    for case, found in cases.items():
        if any(len(v) > 1 for v in found.values()):
            want[case] = ("conflicting_evidence", None)
        elif found["size"] and found["node"]:
            want[case] = ("answered", {"S1N0": "I", "S2N0": "II", "S1N1": "II", "S2N1": "III"}[min(found["size"]) + min(found["node"])])
        else:
            want[case] = ("insufficient_evidence", None)
    assert {r["case_id"]: (r["status"], r["value"]) for r in QUERIES["rule_derive"](spark, SMALL).collect()} == want
    assert [r["mismatches"] for r in QUERIES["rule_replay"](spark, SMALL).collect()] == [0]


def test_all_resamples(spark):
    got = QUERIES["bootstrap_ci"](spark, SMALL).collect()
    assert {r["defined"] + r["undefined"] for r in got} == {10_000}
    for n in (1, 2, 7, 64, 300):
        want = [at for _, at in binary.resampled(list(range(n)), 200, 5)]
        assert [at for draw in binary.places(n, 200, 5) for at in draw.tolist()] == want
