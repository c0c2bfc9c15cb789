"""Cases and results: outcome, scope, reference and budget predicates, labels-only projections, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import spans as sp



def outcome_error(status: Column, reason: Column, failure_kind: Column, evidence: Column, finals: Column, level: Column, reviewed: Column, sources: Column) -> Column:
    """First code that applies to a variable's outcome, else null."""
    answered, cited = status == "answered", F.coalesce(F.size(evidence), F.lit(0)) > 0
    return (
        F.when(~status.isin("answered", "not_mentioned", "conflicting_evidence", "insufficient_evidence", "failed"), "invalid_schema")
        .when(~answered & (reason.isNull() | (F.length(F.trim(reason)) == 0)), "missing_reason")
        .when((status == "failed") != failure_kind.isNotNull(), "failure_kind")
        .when((status == "conflicting_evidence") & ~cited, "conflict_without_evidence")
        .when((status == "conflicting_evidence") & (level == "mention"), "conflict_at_mention")
        .when(answered != (F.coalesce(F.size(finals), F.lit(0)) > 0), "final_claims")
        .when((status == "not_mentioned") & (F.array_sort(reviewed) != F.array_sort(sources)), "incomplete_review")
        .when(F.size(F.array_except(reviewed, sources)) > 0, "foreign_source")
        .when(~sp.distinct_ids(F.coalesce(finals, F.expr("CAST(array() AS array<string>)"))), "repeated_ids")
    )


def scope_errors(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case_id, run_id, code): nodes of another run, patient or source, or a budget that the usage exceeds."""
    foreign = nodes.groupBy("case_id", "run_id").agg(F.bool_and(F.col("node_run") == F.col("run_id")).alias("same"))
    rows = results.join(foreign, ["case_id", "run_id"], "left")
    over = F.col("max_tokens").isNotNull() & (F.col("tokens") > F.col("max_tokens"))
    code = F.when(~F.coalesce("same", F.lit(True)), "run_scope").when(over & ~F.col("budget_failure"), "budget_exceeded")
    return rows.select("case_id", "run_id", code.alias("code")).where("code IS NOT NULL")


def usage_exceeded(calls: DataFrame, limit: str = "max_tokens") -> DataFrame:
    """Calls with their running tokens and whether the budget still allowed them; a null limit allows all."""
    spent = F.sum("tokens").over(Window.partitionBy("case_id").orderBy("call").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return calls.withColumn("spent", spent).withColumn("exceeded", F.coalesce(F.col("spent") > F.col(limit), F.lit(False)))


def reference_error(tier: Column, annotators: Column, adjudicator: Column) -> Column:
    """First code that applies to a reference's annotators, else null."""
    people = F.forall(annotators, lambda a: a.startswith("human:"))
    return (
        F.when(~sp.distinct_ids(annotators), "repeated_annotator")
        .when((tier == "silver") & ((F.size(annotators) > 0) & people), "silver_by_people")
        .when((tier != "silver") & (~people | (F.size(annotators) == 0)), "annotators")
        .when((tier == "adjudicated") & (adjudicator.isNull() | ~adjudicator.startswith("human:")), "adjudicator")
        .when((tier != "adjudicated") & adjudicator.isNotNull(), "adjudicator")
    )


def status_by_tier(claims: DataFrame, served: DataFrame) -> DataFrame:
    """Claims whose status their references do not allow. served: case_id, claim_id, tier, final (whether it is a final claim)."""
    human = F.col("tier") != "silver"
    need = served.groupBy("case_id", "claim_id").agg(F.bool_or(human).alias("human"), F.bool_or(human & F.col("final")).alias("gold"))
    rows = claims.join(need, ["case_id", "claim_id"])
    bad = F.when(F.col("gold"), F.col("status") != "gold").when(F.col("human"), ~F.col("status").isin("gold", "verified")).otherwise(F.col("status") == "rejected")
    return rows.where(bad).select("case_id", "claim_id", F.lit("status_for_tier").alias("code"))


def not_synthetic(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("sensitivity") != "synthetic", F.lit(True)))


def split_conflicts(cases: DataFrame) -> DataFrame:
    """Sources of a dataset that lie in more than one split."""
    return cases.groupBy("dataset", "source_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def is_closed(schema: dict, root: dict | None = None, inside: frozenset = frozenset()) -> bool:
    """Whether a JSON schema admits no free text: walked through references, unions, arrays and objects."""
    root = root or schema
    if "$ref" in schema:
        name = schema["$ref"]
        if name in inside:
            return True
        target = root
        for part in name.removeprefix("#/").split("/"):
            target = target[part]
        return is_closed(target, root, inside | {name})
    if "const" in schema or "enum" in schema:
        return True
    for union in ("anyOf", "oneOf", "allOf"):
        if union in schema:
            return all(is_closed(x, root, inside) for x in schema[union])
    kind = schema.get("type")
    if kind in ("boolean", "integer", "number", "null"):
        return True
    if kind == "string":
        return schema.get("format") in ("date", "date-time")
    if kind == "array":
        return "items" in schema and is_closed(schema["items"], root, inside)
    if kind == "object":
        return schema.get("additionalProperties") is False and all(is_closed(x, root, inside) for x in schema.get("properties", {}).values())
    return False


def labels_only(outcomes: DataFrame, claims: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, refusals): one label for each outcome that did not fail; quotes, offsets and reasons stay behind.

    An answered one needs a closed schema (closed: variable), one value and one producer over its final claims.
    """
    live = outcomes.where("status <> 'failed'")
    finals = live.select("case_id", "variable", F.explode("final_claim_ids").alias("claim_id")).join(claims.select("case_id", "claim_id", "value", F.col("producer").alias("by")), ["case_id", "claim_id"])
    values = finals.groupBy("case_id", "variable").agg(F.count_distinct("value").alias("values"), F.count_distinct("by").alias("producers"), F.min("value").alias("value"), F.min("by").alias("by"))
    rows = live.join(values, ["case_id", "variable"], "left").join(closed.select("variable", F.lit(True).alias("closed")), "variable", "left")
    answered = F.col("status") == "answered"
    code = F.when(answered & F.col("closed").isNull(), "open_answer_fields").when(answered & (F.coalesce("values", F.lit(0)) != 1), "several_answer_values").when(answered & (F.col("producers") != 1), "several_producers")
    rows = rows.withColumn("code", code)
    good = rows.where("code IS NULL").select("case_id", "variable", F.col("status").alias("outcome_status"), F.when(answered, F.col("value")).alias("value"), F.when(answered, F.col("by")).otherwise(F.col("producer")).alias("producer"))
    return good, rows.where("code IS NOT NULL").select("case_id", "variable", "code")


def event_labels(events: DataFrame) -> DataFrame:
    """Events without what may hold text."""
    return events.drop("before", "after", "reason", *[c for c in events.columns if c.startswith("provenance")])


def failed_results(cases: DataFrame, variables: DataFrame, kind: str, reason: str) -> DataFrame:
    """Failed outcomes of all variables of these cases; the variables of a set are few and broadcast."""
    return cases.select("case_id").crossJoin(F.broadcast(variables.select("variable"))).select("case_id", "variable", F.lit("failed").alias("status"), F.lit(reason).alias("reason"), F.lit(kind).alias("failure_kind"))


def review_timing_error(timing: dict[str, Column]) -> Column:
    """First code that applies to a review's instants (opened, submitted), seconds and focus count, else null."""
    start, end = F.try_to_timestamp(timing["opened"]), F.try_to_timestamp(timing["submitted"])
    bad = lambda c: ~F.coalesce((c >= 0) & (c < 1_000_000_000), F.lit(False))
    return F.when(start.isNull() | end.isNull(), "invalid_instant").when(end < start, "instants_out_of_order").when(bad(timing["active_seconds"]) | bad(timing["idle_seconds"]), "invalid_seconds").when(F.coalesce(timing["focus"] < 0, F.lit(True)), "invalid_focus")
