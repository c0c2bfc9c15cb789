"""Data policy: whether a payload of a dataset may go to a destination, restriction by restriction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Sensitivities from least to most, and the zones each may go to by default.
SENSITIVITIES = ("synthetic", "deidentified", "limited", "phi")
ZONES = ("local", "institution", "external_baa", "external")
ALLOWED = {"synthetic": ZONES, "deidentified": ("local", "institution", "external_baa"), "limited": ("local", "institution"), "phi": ("local", "institution")}
RESTRICTION = "array<struct<id:string,forbids_zones:array<string>,forbids_kinds:array<string>,forbids_training:boolean,requires_tags:array<string>,forbids_payloads:array<string>,valid_until:timestamp>>"


def matrix(spark: SparkSession, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    return spark.createDataFrame([(s, list(z)) for s, z in (allowed or ALLOWED).items()], "sensitivity string, zones array<string>")


def refusal(r: Column, row: dict[str, Column]) -> Column:
    """Why a restriction refuses a transfer, the first rule that does; null if none does."""
    return (
        F.when(r["valid_until"].isNotNull() & (row["now"] > r["valid_until"]), "restriction_expired")
        .when(F.array_contains(r["forbids_zones"], row["zone"]), "restriction_zone")
        .when(F.array_contains(r["forbids_kinds"], row["kind"]), "restriction_kind")
        .when(r["forbids_training"] & row["trains_on_inputs"], "restriction_training")
        .when(F.size(F.array_except(r["requires_tags"], row["tags"])) > 0, "restriction_tag")
        .when(F.array_contains(r["forbids_payloads"], row["payload"]), "restriction_payload")
    )


def decide(transfers: DataFrame, allowed: DataFrame, version: str = "1") -> DataFrame:
    """Transfers with permitted, reason and restriction_id: rules in order, the first failure is the reason.

    transfers: sensitivity, restrictions, zone, kind, accepts, trains_on_inputs, tags, payload, now, policy_version
    (null: not asked). The matrix has a row for each sensitivity, so it is broadcast.
    """
    rows = transfers.join(F.broadcast(allowed), "sensitivity", "left")
    row = {c: F.col(c) for c in ("now", "zone", "kind", "trains_on_inputs", "tags", "payload")}
    hits = F.filter(F.transform("restrictions", lambda r: F.struct(r["id"].alias("id"), refusal(r, row).alias("reason"))), lambda x: x["reason"].isNotNull())
    first = F.get(hits, F.lit(0))
    early = (
        F.when(F.col("policy_version").isNotNull() & (F.col("policy_version") != version), "policy_version_mismatch")
        .when(F.col("zones").isNull(), "unknown_sensitivity")
        .when(~F.array_contains("zones", F.col("zone")), "zone_not_allowed")
        .when(~F.array_contains("accepts", F.col("payload")), "payload_not_accepted")
    )
    rows = rows.withColumn("_early", early).withColumn("_first", first)
    reason = F.coalesce("_early", F.col("_first.reason"), F.lit("ok"))
    return rows.withColumns({"reason": reason, "restriction_id": F.when(F.col("_early").isNull(), F.col("_first.id"))}).withColumn("permitted", F.col("reason") == "ok").drop("_early", "_first", "zones")


class PolicyRefused(PermissionError):
    """A transfer was refused; carries the reasons and no content."""


def require(decided: DataFrame) -> DataFrame:
    """The decisions, if all are permitted; else raises with the reasons counted."""
    refused = decided.where(~F.col("permitted")).groupBy("reason").count().collect()
    if refused:
        raise PolicyRefused(", ".join(f"{r['reason']}: {r['count']}" for r in sorted(refused)))
    return decided


def combine(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(combined policy, conflicts) of policies (position, sensitivity, restrictions): the highest sensitivity, every
    restriction once in input order; an id with two definitions is a conflict."""
    rank = F.array_position(F.array(*map(F.lit, SENSITIVITIES)), F.col("sensitivity"))
    each = policies.select("position", F.posexplode("restrictions").alias("at", "r")).select(F.struct("position", "at").alias("place"), F.col("r.id").alias("id"), F.col("r").alias("definition"))
    once = each.groupBy("id").agg(F.min("place").alias("place"), F.count_distinct(F.to_json("definition")).alias("versions"), F.min_by("definition", "place").alias("definition"))
    top = policies.agg(F.max_by("sensitivity", rank).alias("sensitivity"))
    listed = once.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "definition"))), lambda x: x["definition"]).alias("restrictions"))
    return top.crossJoin(listed), once.where("versions > 1").select("id", "versions")


def stamp(df: DataFrame, run_id: str, policy_version: str, zone: str, **more: str) -> DataFrame:
    """Rows with a provenance struct of the run that made them."""
    fields = {"run_id": run_id, "policy_version": policy_version, "zone": zone} | more
    return df.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in fields.items())))


def role_error(producer_kind: Column, role: Column, stream: Column) -> Column:
    """Why an actor cannot act in a role, else null."""
    people = role.isin("reviewer", "adjudicator")
    return F.when(people & (producer_kind != "human"), "not_human").when(~people & (producer_kind == "human"), "human").when(stream.isNotNull() & (role != "reviewer"), "stream")
