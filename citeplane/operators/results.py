"""Variable sets, case results and the event log of an import.

variables: variable, level, final (a set is metadata; it is broadcast). outcomes: case_id, variable, status, failure_kind,
reviewed, evidence_ids, final_claim_ids, sensitivity, run_id. A result is one row for each case that has no error;
errors are rows (case_id, code) with the first code that applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import graph


def contains_all(whole: Column, part: Column) -> Column:
    """Whether every element of part is one of whole; an empty part is in any array."""
    return F.size(F.array_except(part, whole)) == 0


def review_error(status: Column, reviewed: Column, sources: Column) -> Column:
    """Reviewed sources must be the case's own, and all of them before something counts as not mentioned; else null."""
    return F.when(~contains_all(sources, reviewed), "invalid_context").when((status == "not_mentioned") & ~contains_all(reviewed, sources), "incomplete_review")


def set_errors(variables: DataFrame, inputs: DataFrame) -> DataFrame:
    """(set_id, code) of variable sets that may not be used, the first of: no final variable, an input outside the set, a
    mention-level variable resting on another level, inputs in a circle.

    variables: set_id, variable, level, final. inputs: set_id, variable, input.
    """
    finals = variables.groupBy("set_id").agg(F.bool_or("final").alias("any"))
    named = variables.select("set_id", F.col("variable").alias("input"), F.col("level").alias("input_level"))
    met = inputs.join(variables.select("set_id", "variable", "level"), ["set_id", "variable"]).join(named, ["set_id", "input"], "left")
    faults = met.groupBy("set_id").agg(F.bool_or(F.col("input_level").isNull()).alias("unknown"), F.bool_or((F.col("level") == "mention") & (F.col("input_level") != "mention")).alias("lifted"))
    reach = graph.closure(inputs.select(F.col("set_id").alias("case_id"), F.col("variable").alias("parent_id"), F.col("input").alias("child_id")))
    circles = reach.where("root_id = node_id").select(F.col("case_id").alias("set_id"), F.lit(True).alias("circle")).distinct()
    code = F.when(~F.col("any"), "no_final_variable").when(F.col("unknown"), "unknown_input").when(F.col("lifted"), "mention_from_other_level").when(F.col("circle"), "cycle")
    return finals.join(faults, "set_id", "left").join(circles, "set_id", "left").select("set_id", code.alias("code")).where("code IS NOT NULL")


def readings_of(asked: DataFrame, mentions: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, errors): the readings of the mentions asked for, with their place by reading_id; unknown mentions are errors.

    asked, mentions: case_id, mention_id. readings: case_id, mention_id, reading_id and more.
    """
    key = ["case_id", "mention_id"]
    asked = asked.select(*key).distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("reading_id"))
    found = readings.join(asked, key, "left_semi").join(mentions.select(*key), key, "left_semi").withColumn("place", place)
    unknown = asked.join(mentions, key, "left_anti").withColumn("code", F.lit("unknown_reference"))
    return found, unknown


def dataset_tags(examples: DataFrame, references: DataFrame, name: str, version: str, ref: str) -> DataFrame:
    """(tag, value) that describe a dataset: its variable set, its examples, and its references by tier."""
    session = examples.sparkSession
    fixed = session.createDataFrame([("variable_set", name), ("variable_set_version", version), ("variable_set_ref", ref)], "tag string, value string")
    total = examples.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("examples").alias("tag"), "value")
    tiers = references.groupBy("tier").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("tier."), "tier").alias("tag"), "value")
    return fixed.unionByName(total).unionByName(tiers)


def with_outcome_events(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events followed by the outcomes as events of their own; columns of one side only are null on the other."""
    return events.unionByName(outcomes.withColumn("action", F.lit("outcome.set")), allowMissingColumns=True)


def no_claim(cases: DataFrame, variable: str, status: str, reason: str, run_id: str) -> DataFrame:
    """Outcomes without claims for all sources of these cases: not mentioned, or evidence that is not enough."""
    if status not in ("not_mentioned", "insufficient_evidence") or not reason.strip():
        raise ValueError("an outcome without claims is not_mentioned or insufficient_evidence, with a reason")
    none = F.expr("CAST(array() AS array<string>)")
    return cases.select("case_id", F.lit(variable).alias("variable"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("failure_kind"), F.lit(reason).alias("reason"), F.col("source_ids").alias("reviewed"), none.alias("evidence_ids"), none.alias("final_claim_ids"), "sensitivity", F.lit(run_id).alias("run_id"))


def _any_missing(outcomes: DataFrame, ids: str, known: DataFrame, on: list[str], flag: str) -> DataFrame:
    named = outcomes.select("case_id", "variable", F.explode(ids).alias("id"))
    return named.join(known, on, "left_anti").select("case_id", "variable", F.lit(True).alias(flag)).distinct()


def create(cases: DataFrame, variables: DataFrame, outcomes: DataFrame, claims: DataFrame, grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of cases: one result row (case_id, run_id, outcomes by variable) or one first code for each case.

    cases: case_id, run_id, source_ids, sensitivity, max_tokens, tokens. claims: case_id, claim_id, variable, status.
    grounded: case_id, node_id of all evidence that rests on a source. A case needs one outcome for each final variable;
    outcomes are judged by variable, then the run, then the budget. Its outcomes are as many as the set has finals.
    """
    finals = F.broadcast(variables.where("final").select("variable", "level"))
    wanted = variables.where("final").agg(F.sort_array(F.collect_set("variable")).alias("wanted"))
    live = claims.where("status <> 'rejected'").select("case_id", "variable", F.col("claim_id").alias("id"))
    ungrounded = _any_missing(outcomes, "evidence_ids", grounded.select("case_id", F.col("node_id").alias("id")), ["case_id", "id"], "ungrounded")
    not_final = _any_missing(outcomes, "final_claim_ids", live, ["case_id", "variable", "id"], "not_final")
    key = ["case_id", "variable"]
    case = cases.select("case_id", "source_ids", F.col("sensitivity").alias("case_sensitivity"), F.col("run_id").alias("case_run"))
    rows = outcomes.join(finals, "variable", "left").join(case, "case_id").join(ungrounded, key, "left").join(not_final, key, "left")
    ids = F.col("final_claim_ids")
    code = (
        F.when(~F.col("sensitivity").eqNullSafe(F.col("case_sensitivity")), "invalid_context")
        .when(review_error(F.col("status"), F.col("reviewed"), F.col("source_ids")).isNotNull(), review_error(F.col("status"), F.col("reviewed"), F.col("source_ids")))
        .when(F.col("ungrounded"), "unknown_reference")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "invalid_schema")
        .when(((F.col("status") == "answered") != (F.size(ids) > 0)) | F.coalesce("not_final", F.lit(False)), "invalid_final_claims")
        .when((F.col("level") == "mention") & (F.col("status") == "conflicting_evidence"), "invalid_outcome")
    )
    first = F.min(F.when(code.isNotNull(), F.struct("variable", code.alias("code"))))["code"]
    said = F.sort_array(F.collect_list(F.struct("variable", "status", "final_claim_ids")))
    own = F.col("failure_kind").eqNullSafe("budget") & (F.col("status") == "failed")
    judged = rows.groupBy("case_id").agg(first.alias("fault"), said.alias("outcomes"), F.bool_and(F.col("run_id").eqNullSafe(F.col("case_run"))).alias("same_run"), F.bool_and(own).alias("said_budget"))
    over = F.coalesce(F.col("tokens") > F.col("max_tokens"), F.lit(False))
    whole = F.col("outcomes")["variable"].eqNullSafe(F.col("wanted"))
    found = F.when(~whole, "invalid_context").when(F.col("fault").isNotNull(), F.col("fault")).when(~F.col("same_run"), "run_mismatch").when(over & ~F.col("said_budget"), "budget_exceeded")
    done = cases.join(judged, "case_id", "left").crossJoin(F.broadcast(wanted)).withColumn("code", found)
    return done.where("code IS NULL").select("case_id", "run_id", "outcomes"), done.where("code IS NOT NULL").select("case_id", "code")


def load(stored: DataFrame, *parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of stored results, judged again from their parts (as in create); one that differs from what its
    parts give is invalid_schema."""
    made, errors = create(*parts)
    again = made.select("case_id", F.col("run_id").alias("made_run"), F.col("outcomes").alias("made"))
    rows = stored.join(again, "case_id", "left").join(errors, "case_id", "left")
    same = F.col("made").isNotNull() & F.col("made_run").eqNullSafe(F.col("run_id")) & F.col("made").eqNullSafe(F.col("outcomes"))
    rows = rows.withColumn("code", F.coalesce("code", F.when(~same, "invalid_schema")))
    return rows.where("code IS NULL").select(*stored.columns), rows.where("code IS NOT NULL").select("case_id", "code")


def import_events(results: DataFrame, mentions: DataFrame, readings: DataFrame, claims: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """(events, refused): the log that makes a silver reference of each result, numbered by seq within its case.

    It is import.result; for each mention with a live reading mention.create and its reading.create; claim.create of the
    live claims by rank (each after those it rests on, see graph.claim_order); outcome.set, then tier.set, by variable.
    A result with a failed outcome is refused. mentions: case_id, mention_id. readings: and reading_id, status. claims:
    case_id, claim_id, rank, status.
    """
    failed = F.exists("outcomes", lambda o: o["status"] == "failed")
    good = results.where(~failed)
    none = F.lit(None).cast("string")

    def rows(of: DataFrame, stage: int, action: str, target: Column, variable: Column, a: Column, b: Column, c: Column) -> DataFrame:
        return of.select("case_id", F.lit(stage).alias("stage"), a.alias("a"), b.alias("b"), c.alias("c"), F.lit(action).alias("action"), target.cast("string").alias("target_id"), variable.alias("variable"))

    here = good.select("case_id")
    read = readings.where("status <> 'rejected'").join(here, "case_id", "left_semi")
    spans = mentions.join(read, ["case_id", "mention_id"], "left_semi")
    said = good.select("case_id", F.explode("outcomes.variable").alias("name"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    kept = claims.where("status <> 'rejected'").join(here, "case_id", "left_semi")
    log = rows(good, 0, "import.result", F.col("run_id"), none, zero, empty, empty)
    log = log.unionByName(rows(spans, 1, "mention.create", F.col("mention_id"), none, zero, F.col("mention_id"), empty))
    log = log.unionByName(rows(read.join(mentions, ["case_id", "mention_id"], "left_semi"), 1, "reading.create", F.col("reading_id"), none, zero, F.col("mention_id"), F.col("reading_id")))
    log = log.unionByName(rows(kept, 2, "claim.create", F.col("claim_id"), none, F.col("rank").cast("long"), F.col("claim_id"), empty))
    for stage, action in ((3, "outcome.set"), (4, "tier.set")):
        log = log.unionByName(rows(said, stage, action, none, F.col("name"), zero, F.col("name"), empty))
    seq = F.row_number().over(Window.partitionBy("case_id").orderBy("stage", "a", "b", "c")).cast("long")
    events = log.select("case_id", seq.alias("seq"), "action", "target_id", "variable", F.lit(actor).alias("actor"), F.lit("importer").alias("role"))
    return events, results.where(failed).select("case_id", F.lit("failed_result").alias("code"))
