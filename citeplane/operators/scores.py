"""Label scoring, structural validity, reference tiers, self-reference, baselines and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, stats

#: Kinds of the label metrics, and tiers from weakest to strongest.
KINDS = {"label_accuracy": "label", "coverage": "coverage", "omissions": "label", "evidence_overlap": "evidence"}
TIERS = ("silver", "single_review", "adjudicated")
SEVERITY = ("failed", "conflicting_evidence", "insufficient_evidence", "not_mentioned", "answered")


def single_values(records: DataFrame, claims: DataFrame) -> DataFrame:
    """values: the distinct canonical values of each record's final claims, sorted."""
    finals = records.select("record_id", F.explode_outer("final_claim_ids").alias("claim_id")).join(claims.select("claim_id", "value"), "claim_id", "left")
    return records.join(finals.groupBy("record_id").agg(F.array_sort(F.collect_set("value")).alias("values")), "record_id")


def label_tallies(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(name, kind, variable, numerator, denominator) over all references and by variable.

    reference: case_id, variable, status, values, and overlaps (whether evidence overlaps; null on labels);
    predicted: case_id, variable, status, values. A reference without a prediction is wrong and uncovered.
    """
    p = predicted.select("case_id", "variable", F.col("status").alias("p_status"), F.col("values").alias("p_values"))
    rows = reference.join(p, ["case_id", "variable"], "left")
    found, answered = F.col("p_status").isNotNull(), F.col("status") == "answered"
    right = F.coalesce((F.col("p_status") == F.col("status")) & (~answered | (F.col("p_values") == F.col("values"))), F.lit(False))
    hit = lambda name, value, when: F.struct(F.lit(name).alias("name"), F.when(when, value.cast("long")).alias("hit"))
    each = rows.select(
        "variable",
        F.explode(
            F.array(
                hit("label_accuracy", right, F.lit(True)),
                hit("coverage", F.coalesce(found & (F.col("p_status") != "failed"), F.lit(False)), F.lit(True)),
                hit("omissions", F.coalesce(F.col("p_status") != "answered", F.lit(True)), answered),
                hit("evidence_overlap", F.col("overlaps"), answered & right & F.col("overlaps").isNotNull()),
            )
        ).alias("t"),
    ).select("variable", "t.*").where("hit IS NOT NULL")
    sums = each.rollup("name", "variable").agg(F.grouping("name").alias("g"), F.grouping("variable").alias("all"), F.sum("hit").alias("numerator"), F.count("hit").alias("denominator"))
    kind = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v)))
    return sums.where("g = 0").select("name", F.element_at(kind, F.col("name")).alias("kind"), F.when(F.col("all") == 0, F.col("variable")).alias("variable"), F.col("numerator").cast("double").alias("numerator"), "denominator")


def tokens_per_case(usage: DataFrame) -> DataFrame:
    return usage.where("tokens IS NOT NULL").agg(F.lit("tokens_per_case").alias("name"), F.sum("tokens").cast("double").alias("numerator"), F.count(F.lit(1)).alias("denominator"))


def structural_validity(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """Shares of answered, failed and each failure kind among outcomes; grounding failures of each case."""
    total = outcomes.agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "failed").alias("failed"))
    first = total.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("numerator"), F.col("d").alias("denominator")) for n in ("answered", "failed")))).alias("m")).select("m.*")
    kinds = outcomes.where("failure_kind IS NOT NULL").groupBy("failure_kind").agg(F.count(F.lit(1)).cast("double").alias("numerator"))
    by_kind = kinds.join(F.broadcast(total.select(F.col("d").alias("denominator")))).select(F.concat(F.lit("failed:"), "failure_kind").alias("name"), "numerator", "denominator")
    per_case = cases.agg(F.lit("grounding_failures_per_case").alias("name"), F.coalesce(F.sum("grounding_failures"), F.lit(0)).cast("double").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return first.unionByName(by_kind).unionByName(per_case)


def tier_mix(references: DataFrame) -> DataFrame:
    """References of each tier, one for each record and variable; a label record is silver."""
    return references.groupBy(F.coalesce("tier", F.lit("silver")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def provisional(references: DataFrame) -> DataFrame:
    return references.agg(F.coalesce(F.bool_or(F.coalesce("tier", F.lit("silver")) != "adjudicated"), F.lit(False)).alias("provisional"))


def self_references(predicted: DataFrame, references: DataFrame) -> DataFrame:
    """Silver references (record_id) one of whose producers has a configuration of the predictions."""
    mine = predicted.select(ids.configuration_key(F.col("producer")).alias("key")).where("key IS NOT NULL").distinct()
    theirs = references.where(F.coalesce("tier", F.lit("silver")) == "silver").select("record_id", ids.configuration_key(F.col("producer")).alias("key")).where("key IS NOT NULL")
    return theirs.join(mine, "key", "left_semi").select("record_id").distinct()


def without_move_on(references: DataFrame, event: str) -> DataFrame:
    """Single-review references that do not include the move-on event."""
    return references.where((F.col("tier") == "single_review") & ((F.col("as_of_event") < event) | ~F.array_contains("derived_from_events", event)))


def case_status(outcomes: DataFrame) -> DataFrame:
    """Most severe outcome of each case."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    return outcomes.groupBy("case_id").agg(F.min_by("status", rank).alias("status"))


def fingerprint(references: DataFrame) -> DataFrame:
    """Hash of the sorted reference ids."""
    return references.agg(F.sha2(F.to_json(F.array_sort(F.collect_set("record_id"))), 256).alias("references"))


def baseline_from(metrics: DataFrame, lower_is_better: tuple[str, ...] = (), tolerances: dict[str, float] | None = None) -> DataFrame:
    """Tracks the metrics that are defined."""
    own = F.lit(None).cast("double")
    for name, value in (tolerances or {}).items():
        own = F.when(F.col("name") == name, F.lit(value)).otherwise(own)
    lower = F.col("name").isin(*lower_is_better) if lower_is_better else F.lit(False)
    return metrics.where("denominator > 0").select("name", "numerator", "denominator", lower.alias("lower_is_better"), own.alias("tolerance"))


def compare(metrics: DataFrame, baseline: DataFrame, default: float = 0.005, below: int = 0, low_support: float | None = None, inconclusive: tuple[str, ...] = ()) -> DataFrame:
    """Status of each tracked metric: inconclusive, missing, regressed (past tolerance and rounding slack) or passed."""
    now = metrics.select("name", F.try_divide(F.col("numerator"), F.col("denominator").cast("double")).alias("current"), F.col("denominator").alias("current_support"), F.lit(True).alias("reported"))
    rows = baseline.withColumn("base", F.col("numerator") / F.col("denominator")).join(now, "name", "left")
    rows = rows.withColumn("allowed", stats.tolerance(F.col("tolerance"), F.col("denominator"), F.lit(below), F.lit(low_support).cast("double"), F.lit(default)))
    edge = F.col("allowed") + stats.slack(F.col("base"), F.coalesce("current", F.lit(0.0)))
    past = F.when(F.col("lower_is_better"), F.col("current") > F.col("base") + edge).otherwise(F.col("current") < F.col("base") - edge)
    undefined = (F.col("name").isin(*inconclusive) if inconclusive else F.lit(False)) | (F.col("reported").isNotNull() & F.col("current").isNull())
    status = F.when(undefined, "inconclusive").when(F.col("current").isNull(), "missing").when(past, "regressed").otherwise("passed")
    return rows.select("name", status.alias("status"), F.col("base").alias("baseline"), "current", F.col("allowed").alias("tolerance"), "lower_is_better", F.col("denominator").alias("baseline_support"), "current_support")


def regression_status(compared: DataFrame, references_changed: bool = False) -> DataFrame:
    """regressed (exit 2) before inconclusive (3) before passed (0)."""
    bad = F.bool_or(F.col("status").isin("regressed", "missing"))
    open_ = F.coalesce(F.bool_or(F.col("status") == "inconclusive"), F.lit(False)) | F.lit(references_changed)
    said = compared.agg(F.when(bad, "regressed").when(open_, "inconclusive").otherwise("passed").alias("status"))
    return said.withColumn("exit_code", F.when(F.col("status") == "regressed", 2).when(F.col("status") == "inconclusive", 3).otherwise(0))


def untracked(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    return metrics.join(baseline.select("name"), "name", "left_anti").select("name")
