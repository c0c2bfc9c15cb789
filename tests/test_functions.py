"""Canonical JSON, ids, text and span functions against known answers and small independent models."""

import datetime as dt
import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citeplane.functions import ids, spans as sp, stats, text as tx


@pytest.mark.parametrize("value, text", [(1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (4.5, "4.5"), (1 / 3, "0.3333333333333333"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (100.0, "100"), (2e-3, "0.002")])
def test_numbers(value, text):
    assert ids.number_text(value) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=200, deadline=None)
def test_numbers_read_back(x):
    assert float(ids.number_text(x)) == x


@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), st.one_of(st.none(), st.booleans(), st.integers(-(2**53) + 1, 2**53 - 1), st.text(st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_canonical_ignores_order(value):
    text = ids.canonical_json(value)
    assert json.loads(text) == value
    assert ids.canonical_json(dict(reversed(value.items()))) == text


def test_canonical_form():
    assert ids.canonical_json({"\U0001f600": 1, "דּ": 2, "a": "\u0007\n\"\\é"}) == '{"a":"\\u0007\\n\\"\\\\é","\U0001f600":1,"דּ":2}'
    assert ids.canonical_json(dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)) == '"2026-01-02T03:04:05.000000Z"'
    for bad in (2**53, float("nan"), dt.datetime(2026, 1, 1), "\ud800", {1: 2}):
        with pytest.raises((ValueError, TypeError)):
            ids.canonical_json(bad)
    assert ids.parse_canonical("12345678901234567890") == float(12345678901234567890)


def test_known_ids(spark):
    s = "s" * 64
    row = spark.range(1).select(ids.inclusion_id(F.lit(s), F.lit(0), F.lit(9)).alias("i"), ids.mention_id(F.lit(s), F.lit(3), F.lit(17), F.lit("tnm_t")).alias("m")).first()
    assert row["i"] == "7abe7b02dd15da73ad465e6fb49cacbec468cf8b2fe01666d5d9422b0e8b9ddf"
    assert row["m"] == "4ec5f72e870dbeb2cc748c11888a6f724cae721e20af2b9cee82c08b9d780299"


def test_ids_agree_with_canonical(spark):
    frags = spark.createDataFrame([("a\"b\\c", 1, 9, [(1, 3), (5, 9)])], "s string, b int, e int, f array<struct<start:bigint,end:bigint>>")
    got = frags.select(ids.mention_id(F.col("s"), F.col("b"), F.col("e"), F.lit("x"), F.col("f")).alias("m")).first()["m"]
    import hashlib

    want = ids.canonical_json({"end": 9, "fragments": [[1, 3], [5, 9]], "mention_type": "x", "source_id": 'a"b\\c', "start": 1})
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_ulids_producers_versions(spark):
    rows = spark.createDataFrame([("rule:a@1+h",), ("rule:a@1",), ("model:m",), ("model:m@2",), ("human:x y",), ("human:x@y",), ("tool:t@1",), ("rule:a",), ("x",)], "p string")
    got = [(r["p"], r["k"] and r["k"]["kind"], r["c"]) for r in rows.select("p", ids.parse_producer(F.col("p")).alias("k"), ids.configuration_key(F.col("p")).alias("c")).collect()]
    assert got == [("rule:a@1+h", "rule", "rule:a@1"), ("rule:a@1", "rule", "rule:a@1"), ("model:m", "model", "model:m"), ("model:m@2", "model", "model:m@2"), ("human:x y", None, None), ("human:x@y", "human", None), ("tool:t@1", "tool", None), ("rule:a", None, None), ("x", None, None)]
    u = spark.createDataFrame([("seed", i) for i in (1, 2)], "s string, n long").select(ids.seeded_ulid(F.col("s"), F.col("n")).alias("u"))
    found = [r["u"] for r in u.collect()]
    assert found[0] != found[1] and u.where(~ids.is_ulid(F.col("u"))).count() == 0
    versions = spark.createDataFrame([("citeplane/0.1",), ("citeplane/0.0",), ("citeplane/0.2",), ("citeplane/1.0",), ("citeplane/0.01",), (None,)], "v string")
    assert [r[0] for r in versions.select(ids.version_ok(F.col("v"))).collect()] == [True, True, False, False, False, False]


@given(st.text("aab\U0001f600.", max_size=12), st.text("ab\U0001f600.", max_size=3))
@settings(max_examples=25, deadline=None)
def test_occurrences(spark, text, candidate):
    want = [i for i in range(len(text)) if candidate and text.startswith(candidate, i)]
    assert spark.createDataFrame([(text, candidate)], "t string, c string").select(tx.occurrences(F.col("t"), F.col("c"))).first()[0] == want


def test_occurrences_overlap_and_quoting(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("x\\Ey\\E", "\\E"), ("(a)(a)", "(a)")], "t string, c string")
    assert [r[0] for r in rows.select(tx.occurrences(F.col("t"), F.col("c"))).collect()] == [[0, 1, 2], [1, 4], [0, 3]]


def test_text_checks(spark):
    rows = spark.createDataFrame([("a",), (" a",), (" ",), ("\x1c",), (" ",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(tx.nonblank(F.col("t")), tx.unpadded(F.col("t"))).collect()][:3] == [(True, True), (True, False), (False, False)]
    assert [r[0] for r in rows.select(tx.nonblank(F.col("t"))).collect()][3:] == [False, False, False]
    assert spark.range(1).select(tx.metric_key(F.lit("a:b"), F.lit("c"))).first()[0] == "a_b.c"
    assert spark.range(1).select(tx.person(F.lit(" Ann  Lee "))).first()[0] == "human:Ann-Lee"


def test_identifier_text(spark):
    lines = ["SSN 123-45-6789", "call 312-555-0100 now", "x@example.com", "jane@hospital.org", "MRN: 1234567", "born on 01/02/1960", "version 1.2.3", "DOB: Jan 2, 1960\\nnext"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "id long, t string")
    assert [(r["line"], r["kind"]) for r in tx.findings(df, "t", "id").orderBy("line").collect()] == [(1, "ssn"), (2, "phone"), (4, "email"), (5, "mrn"), (6, "dob"), (8, "dob")]


def test_fragments(spark):
    def error(s, e, f):
        df = spark.createDataFrame([(s, e, f)], "s long, e long, f array<struct<start:bigint,end:bigint>>")
        return df.select(sp.fragments_error(F.col("s"), F.col("e"), F.col("f"))).first()[0]

    assert error(0, 9, []) is None and error(0, 9, None) is None and error(0, 9, [(0, 2), (4, 9)]) is None
    assert error(0, 9, [(0, 9)]) == "single_fragment"
    assert error(0, 9, [(0, 2), (2, 9)]) == "unordered_fragments"
    assert error(0, 9, [(0, 2), (4, 8)]) == "not_the_hull"
    assert error(0, 9, [(0, 0), (4, 9)]) == "empty_fragment"


def test_statistics(spark):
    df = spark.createDataFrame([(3, 4), (0, 5), (5, 5), (0, 0)], "s long, n long").select(stats.wilson(F.col("s"), F.col("n")).alias("w"), stats.ratio(F.col("s"), F.col("n")).alias("r"))
    rows = df.collect()
    assert rows[3]["w"] is None and rows[3]["r"] is None
    z, p, n = 1.959963984540054, 0.75, 4
    low = (p + z * z / 8 - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    assert rows[0]["w"]["low"] == pytest.approx(low) and rows[1]["w"]["low"] == 0.0 and rows[2]["w"]["high"] == 1.0
    typed = spark.range(1).select(sp.permitted(F.struct(F.lit("bool").alias("type"), F.lit("1").alias("value")), F.array(F.struct(F.lit("int").alias("type"), F.lit("1").alias("value"))))).first()[0]
    assert typed is False
