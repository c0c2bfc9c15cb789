"""Bundles: layout, round trip, refusals; stores and gated exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeplane.operators import policy
from citeplane.sources import bundles, stores
from citeplane.sources.tables import REQUIRED, TABLES

NOW = dt.datetime(2026, 1, 2, 3, 4, 5)


def fill(spark, name, **values):
    schema = TABLES[name].schema
    defaults = {"string": "x", "bigint": 1, "double": 0.5, "boolean": True, "timestamp": NOW}
    row = {f.name: values.get(f.name, None if f.nullable else "[]" if f.name in TABLES[name].json else defaults[f.dataType.simpleString()]) for f in schema}
    return spark.createDataFrame([row], schema)


@pytest.fixture(scope="module")
def labels(spark):
    parts = {"cases": [fill(spark, "cases", case_id="c1"), fill(spark, "cases", case_id="c2")], "label_records": [fill(spark, "label_records", case_id="c1", value='{"present":true}')]}
    return bundles.build("labels", parts, closed=True, dataset="d")


def test_layout():
    assert len(TABLES) == 13 and set(REQUIRED["run"]) < set(REQUIRED["review"]) < set(REQUIRED["gold"])
    assert TABLES["evidence_edges"].key == ("claim_id", "evidence_id", "role")
    assert [f.name for f in TABLES["claims"].schema if f.name.startswith("provenance_")]


def test_round_trip(spark, labels, tmp_path):
    where = str(tmp_path / "b")
    bundles.write(labels, spark, where)
    again = bundles.read(spark, where)
    assert again.manifest == labels.manifest and bundles.check(again) == []
    with pytest.raises(bundles.BundleError, match="directory_exists"):
        bundles.write(labels, spark, where)
    rows, rest = bundles.load_labels(again)
    assert rows.count() == 1 and isinstance(rest["cases"], bundles.Unvalidated)
    with pytest.raises(bundles.BundleError, match="missing_manifest"):
        bundles.read(spark, str(tmp_path / "none"))


def test_refusals(spark, labels):
    changed = bundles.Bundle("labels", labels.tables | {"cases": labels.tables["cases"].withColumn("dataset", F.lit("y"))}, labels.manifest)
    assert ("content_mismatch", "cases") in bundles.check(changed)
    fewer = bundles.Bundle("labels", labels.tables | {"cases": labels.tables["cases"].where("case_id = 'c2'")}, labels.manifest)
    assert {("row_count", "cases"), ("case_scope", "label_records")} <= set(bundles.check(fewer))
    with pytest.raises(bundles.BundleError, match="derived_text_payload"):
        bundles.build("labels", {n: [r] for n, r in labels.tables.items()}, closed=False)
    with pytest.raises(bundles.BundleError, match="conflicting_rows"):
        bundles.build("labels", {"cases": [labels.tables["cases"], labels.tables["cases"].withColumn("dataset", F.lit("z"))], "label_records": [labels.tables["label_records"]]}, closed=True)


def test_row_errors(spark):
    t = TABLES["label_records"]
    good = fill(spark, "label_records", case_id="c1", value='{"a":1}')
    codes = lambda df: {(r["code"], r["column"]) for r in bundles.row_errors(t, df).collect()}
    assert codes(good) == set() and codes(good.withColumn("x_more", F.lit(1))) == set()
    assert codes(good.withColumn("value", F.lit('{ "a": 1}'))) == {("not_canonical", "value")}
    assert codes(good.withColumn("tier", F.lit(None).cast("string"))) == {("null_value", "tier")}
    assert codes(good.drop("tier").withColumn("more", F.lit(1))) == {("missing_column", "tier"), ("unknown_column", "more")}
    assert codes(good.union(good)) == {("duplicate_key", "case_id,variable")}


def test_provenance_flattens_and_nests(spark):
    rows = spark.range(1).select("id", F.struct(F.lit("p").alias("producer"), F.lit("r").alias("run_id")).alias("provenance"))
    assert bundles.nested(bundles.flat(rows)).first()["provenance"]["run_id"] == "r"


def test_store(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path))
    cases = spark.createDataFrame([("c1", "d", "s1", "train")], "case_id string, dataset string, source_id string, split string")
    store.put_cases(cases)
    with pytest.raises(bundles.BundleError, match="split_conflict"):
        store.put_cases(cases.withColumn("case_id", F.lit("c2")).withColumn("split", F.lit("test")))
    runs = spark.createDataFrame([("c1", "r1")], "case_id string, run_id string")
    store.put_results(runs)
    store.put_results(runs.withColumn("run_id", F.lit("r2")))
    with pytest.raises(bundles.BundleError, match="duplicate_run"):
        store.put_results(runs)
    assert store.read("results").count() == 2


def test_export_is_gated(spark, tmp_path):
    none = F.expr("CAST(array() AS array<string>)")
    to = spark.range(1).select(F.lit("phi").alias("sensitivity"), F.expr(f"CAST(array() AS {policy.RESTRICTION})").alias("restrictions"), F.lit("local").alias("zone"), F.lit("file").alias("kind"), F.array(F.lit("labels_only")).alias("accepts"), F.lit(False).alias("trains_on_inputs"), none.alias("tags"), F.current_timestamp().alias("now"), F.lit(None).cast("string").alias("policy_version"))
    rows = spark.range(3)
    with pytest.raises(policy.PolicyRefused):
        stores.export({"a": ("source_text", rows)}, str(tmp_path / "x"), to, policy.matrix(spark))
    assert not (tmp_path / "x").exists()
    stores.export({"a": ("labels_only", rows)}, str(tmp_path / "y"), to, policy.matrix(spark))
    assert spark.read.parquet(str(tmp_path / "y" / "a")).count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,report\n1,"two\nlines, ""quoted"""\n')
    assert stores.report_csv(spark, str(tmp_path / "r.csv")).first()["report"] == 'two\nlines, "quoted"'


def test_canonical_strings_and_records(spark):
    """Strings are escaped as canonical JSON; a table without rows has the hash of nothing."""
    import hashlib
    import json

    from pyspark.sql import functions as F

    texts = ["", "a\"b", "back\\u000B\\", "".join(map(chr, range(33))), "\u2028\u2029\x7f/<é\U0001f600", "]", "[x]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bundles.json_text(F.col("t")).alias("j")).collect()
    assert {r["t"]: r["j"] for r in got} == {t: json.dumps(t, ensure_ascii=False) for t in texts}
    record = spark.createDataFrame([(None, '{"b": 1, "a": "x"}'), ("text", None)], "text string, record string").select(bundles.text_hash(F.col("text"), F.col("record")).alias("h")).collect()
    assert [r["h"] for r in record] == [hashlib.sha256(x.encode()).hexdigest() for x in ('{"record":{"a":"x","b":1}}', "text")]
    table = bundles.TABLES["decisions"]
    empty = spark.createDataFrame([], table.schema)
    assert tuple(bundles.content_hash(table, empty).first()) == (0, hashlib.sha256().hexdigest())
