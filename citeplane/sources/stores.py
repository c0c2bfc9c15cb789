"""Files around bundles: a table store with write constraints, gated exports, review batches, CSV and JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import cases as cs, policy
from ..operators.replay import append_errors, replay
from .bundles import BundleError, _exists


class Resolver:
    """Authoritative sources by id; an unknown id has null text."""

    def __init__(self, sources: DataFrame):
        self.sources = sources

    def resolve(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sources, "source_id", "left")


class Store:
    """Append-only Parquet tables under one directory, checked before each write."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def read(self, table: str, like: DataFrame | None = None) -> DataFrame | None:
        path = f"{self.directory}/{table}"
        if _exists(self.spark, path):
            return self.spark.read.parquet(path)
        return None if like is None else self.spark.createDataFrame([], like.schema)

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.directory}/{table}")

    def put_cases(self, rows: DataFrame) -> None:
        """One split for each source of a dataset; a stored case never changes."""
        old = self.read("cases", rows)
        if not cs.split_conflicts(old.unionByName(rows)).isEmpty():
            raise BundleError("split_conflict", "cases")
        same = rows.join(old.select("case_id"), "case_id", "left_semi")
        if not same.select(rows.columns).exceptAll(old.select(rows.columns)).isEmpty():
            raise BundleError("case_changed", "cases")
        self._append("cases", rows.join(old.select("case_id"), "case_id", "left_anti").select(rows.columns))

    def put_results(self, rows: DataFrame) -> None:
        """Several runs of a case, each once."""
        old = self.read("results", rows)
        if not rows.join(old, ["case_id", "run_id"], "left_semi").isEmpty() or not rows.groupBy("case_id", "run_id").count().where("count > 1").isEmpty():
            raise BundleError("duplicate_run", "results")
        self._append("results", rows)

    def append_events(self, rows: DataFrame) -> None:
        old = self.read("events", rows)
        bad = append_errors(old, rows, "event_id").first()
        if bad:
            raise BundleError(bad["code"], "events")
        self._append("events", rows)

    def events(self, stream: str | None = None) -> DataFrame:
        rows = self.read("events")
        return rows if stream is None else rows.where(F.col("stream") == stream)

    def project(self, finals: tuple[str, ...] | None = None) -> DataFrame:
        return replay(self.events(), finals)

    def put_examples(self, rows: DataFrame) -> None:
        """Snapshots of events that are stored."""
        known = self.events().select("case_id", F.col("event_id").alias("as_of"))
        if not rows.join(known, ["case_id", "as_of"], "left_anti").isEmpty():
            raise BundleError("unknown_event", "examples")
        self._append("examples", rows)

    def current_examples(self) -> DataFrame:
        """The snapshot of each case at its latest event."""
        last = self.events().groupBy("case_id").agg(F.max("event_id").alias("as_of"))
        return self.read("examples").join(last, ["case_id", "as_of"])


def export(files: dict[str, tuple[str, DataFrame]], directory: str, transfers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Writes files (name: payload, rows) once the policy permits every payload, the manifest's too; else writes nothing.

    Files go to a sibling folder that is renamed when all are there. Returns the decisions.
    """
    spark = transfers.sparkSession
    payloads = spark.createDataFrame([(n, p) for n, (p, _) in files.items()] + [("manifest", "labels_only")], "file string, payload string")
    decided = policy.decide(transfers.drop("payload").crossJoin(F.broadcast(payloads)), allowed)
    policy.require(decided)
    if _exists(spark, directory):
        raise BundleError("directory_exists")
    staging = f"{directory.rstrip('/')}.staging"
    for name, (_, rows) in files.items():
        rows.write.mode("overwrite").parquet(f"{staging}/{name}")
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(staging)
    source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, jvm.org.apache.hadoop.fs.Path(directory))
    return decided


def export_reviews(cases: DataFrame, directory: str) -> None:
    """Review batch as JSON lines, partitioned by case."""
    cases.withColumn("case", F.col("case_id")).write.partitionBy("case").json(directory)


def import_reviews(spark: SparkSession, directory: str, people: DataFrame, finals: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(replayed reviews, foreign events): events by producers outside the batch's people are reported, not replayed."""
    schema = "case_id string, event_id string, variable string, actor string, role string, round long, stream string, action string, target_id string, before string, after string, reason string"
    events = spark.read.schema(schema).json(directory)
    foreign = events.join(people.select("actor"), "actor", "left_anti")
    return replay(events.join(people.select("actor"), "actor", "left_semi"), finals), foreign


def simulate_reviews(cases: DataFrame, streams: DataFrame, decision: str) -> DataFrame:
    """Reviewer events for tests: for each case and blind stream a submit, in id order."""
    rows = cases.select("case_id").crossJoin(F.broadcast(streams.select("stream", "actor")))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("stream"))
    return rows.withColumn("event_id", F.concat(F.lit("01"), F.lpad(n.cast("string"), 24, "0"))).select("case_id", "event_id", F.lit(None).cast("string").alias("variable"), "actor", F.lit("reviewer").alias("role"), F.lit(1).cast("long").alias("round"), "stream", F.lit("review.submit").alias("action"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("before"), F.to_json(F.struct(F.lit(decision).alias("decision"))).alias("after"), F.lit(None).cast("string").alias("reason"))


def source_manifest(sources: DataFrame) -> DataFrame:
    """Sources by id with the hash of their text, and the snapshot's hash over all of them."""
    each = sources.select("source_id", F.sha2("text", 256).alias("text_sha256"))
    whole = each.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("source_id", "text_sha256")))), 256).alias("snapshot"))
    return each.crossJoin(F.broadcast(whole))


def proposals(finals: DataFrame, edges: DataFrame, inclusions: DataFrame, failed: DataFrame) -> DataFrame:
    """Editable requests: for each case and variable the value with its evidence by place; failed and fragmented ones stay out."""
    cited = finals.join(edges.select("claim_id", "evidence_id"), "claim_id").join(inclusions, "evidence_id")
    spans = cited.groupBy("case_id", "variable", "value").agg(F.array_sort(F.collect_set(F.struct("start", "end", "quote"))).alias("evidence"))
    return spans.join(failed.select("case_id"), "case_id", "left_anti")


#: Caps of a reviewer's request.
CAPS = {"claims": 50, "evidence": 50, "mentions": 500}


def over_caps(requests: DataFrame) -> DataFrame:
    """Requests that hold more than they may (arrays named as in CAPS)."""
    code = F.coalesce(*(F.when(F.size(k) > most, F.lit(f"too_many_{k}")) for k, most in CAPS.items()))
    return requests.withColumn("code", code).where("code IS NOT NULL")


def stored_predictions(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """Labels of a JSON file {case_id: {"label": ...}}; a case without one fails with not_found."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    each = whole.select(F.explode("m").alias("case_id", "entry")).select("case_id", F.get_json_object("entry", "$.label").alias("value"))
    return cases.select("case_id").join(each, "case_id", "left").withColumn("status", F.when(F.col("value").isNull(), "not_found").otherwise("silver"))


def examples_dataset(examples: DataFrame) -> DataFrame:
    """One record for each example with a map of its variables' outcomes, by case and example."""
    return examples.groupBy("case_id", "example_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "outcome_status")))).alias("outcomes"), F.array_sort(F.collect_set("tier")).alias("tiers")).orderBy("case_id", "example_id")


def metric_maps(metrics: DataFrame) -> DataFrame:
    """Metrics under keys that metric stores accept; undefined ones stay out."""
    return metrics.where("denominator > 0").select(tx.metric_key(F.col("scorer"), F.col("name")).alias("key"), (F.col("numerator") / F.col("denominator")).alias("value"))


def report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV with a header, as the example corpora are written."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def note_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
