"""Rule derivation: roles reduced over a case's claims, conflicts, refusals, defaults, table rules and replay."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Role:
    source: str
    many: bool = False
    on_missing: str = "refuse"  # or default, none


@dataclass(frozen=True)
class RuleSpec:
    name: str
    version: str
    roles: dict[str, Role]
    output: str
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def ref(self) -> str:
        return f"{self.name}@{self.version}"


class Rule(Protocol):
    spec: RuleSpec

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds value (null: insufficient evidence) to rows with one column for each role."""


class Registry:
    """Rules by name@version; a name is registered once."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def register(self, rule: Rule) -> Rule:
        if rule.spec.ref in self.rules:
            raise ValueError(f"already registered: {rule.spec.ref}")
        self.rules[rule.spec.ref] = rule
        return rule

    def get(self, ref: str) -> Rule:
        return self.rules[ref]


class TableRule:
    """A lookup table over the roles: the table is a rule's own constant, so it is broadcast."""

    def __init__(self, spec: RuleSpec, table: DataFrame, suffix: str = ""):
        self.spec, self.table, self.suffix = spec, table, suffix

    def apply(self, rows: DataFrame) -> DataFrame:
        keys = list(self.spec.roles)
        found = rows.join(F.broadcast(self.table.select(*keys, F.col("value").alias("_value"))), keys, "left")
        return found.withColumn("value", F.concat("_value", F.lit(self.suffix))).drop("_value")


def gather(spec: RuleSpec, claims: DataFrame) -> DataFrame:
    """One row for each case: for each role its reduced value, its candidates in id order, whether they disagree."""
    live = claims.where("status <> 'rejected'")
    out = claims.select("case_id").distinct()
    for name, role in spec.roles.items():
        own = live.where(F.col("variable") == role.source).groupBy("case_id").agg(F.min_by("value", "claim_id").alias(name), F.array_sort(F.collect_list("claim_id")).alias(f"{name}_ids"), (F.count_distinct("value") > 1).alias(f"{name}_conflict"))
        if role.many:
            own = own.withColumn(f"{name}_conflict", F.lit(False))
        out = out.join(own, "case_id", "left")
    return out


def derive(rule: Rule, claims: DataFrame, conflicted: DataFrame | None = None) -> DataFrame:
    """(case_id, variable, status, value, inputs): a conflict of a role, or of what it rests on (case_id, variable),
    comes before a missing role, and that before the rule's own refusal."""
    spec = rule.spec
    rows = gather(spec, claims)
    conflict = F.lit(False)
    for name, role in spec.roles.items():
        conflict = conflict | F.coalesce(F.col(f"{name}_conflict"), F.lit(False))
        if conflicted is not None:
            up = conflicted.where(F.col("variable") == role.source).select("case_id", F.lit(True).alias(f"{name}_up")).distinct()
            rows = rows.join(up, "case_id", "left")
            conflict = conflict | F.coalesce(F.col(f"{name}_up"), F.lit(False))
    missing = F.lit(None).cast("string")
    for name, role in sorted(spec.roles.items(), reverse=True):
        if role.on_missing == "refuse":
            missing = F.when(F.col(f"{name}_ids").isNull(), name).otherwise(missing)
    cited = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(f"{n}_ids"), F.expr("CAST(array() AS array<string>)")) for n in spec.roles)))))
    rows = rows.withColumns({"_conflict": conflict, "_missing": missing, "inputs": cited})
    for name, role in spec.roles.items():
        if role.on_missing == "default":
            rows = rows.withColumn(name, F.coalesce(name, F.lit(spec.defaults[name])))
    rows = rule.apply(rows)
    status = F.when(F.col("_conflict"), "conflicting_evidence").when(F.col("_missing").isNotNull() | F.col("value").isNull() | (F.size("inputs") == 0), "insufficient_evidence").otherwise("answered")
    rows = rows.withColumn("status", status)
    return rows.select("case_id", F.lit(spec.output).alias("variable"), "status", F.when(F.col("status") == "answered", F.col("value")).alias("value"), "inputs")


def order(rules: list[Rule]) -> list[Rule]:
    """Rules after those whose output they read, ties by ref."""
    left, out = {r.spec.ref: r for r in rules}, []
    while left:
        made = {r.spec.output for r in left.values()}
        ready = [ref for ref, r in sorted(left.items()) if not made & {x.source for x in r.spec.roles.values()}]
        if not ready:
            raise ValueError("rules depend on each other")
        out.append(left.pop(ready[0]))
    return out


def derive_all(rules: list[Rule], claims: DataFrame) -> DataFrame:
    """All derivations in dependency order; answers become claims for later rules, conflicts propagate."""
    done = None
    for rule in order(rules):
        conflicted = None if done is None else done.where("status = 'conflicting_evidence'").select("case_id", "variable")
        now = derive(rule, claims, conflicted)
        made = now.where("status = 'answered'").select("case_id", F.concat_ws("/", F.lit(rule.spec.ref), "case_id").alias("claim_id"), "variable", "value", F.lit("proposed").alias("status"))
        claims = claims.select("case_id", "claim_id", "variable", "value", "status").unionByName(made)
        done = now if done is None else done.unionByName(now)
    return done


def replay(recorded: DataFrame, rule: Rule, claims: DataFrame) -> DataFrame:
    """Recorded derivations (case_id, value, inputs) that deriving again does not give, with the code."""
    again = derive(rule, claims).select("case_id", F.col("status").alias("_status"), F.col("value").alias("_value"), F.col("inputs").alias("_inputs"))
    both = recorded.withColumn("_recorded", F.lit(True)).join(again, "case_id", "full_outer")
    answered = F.coalesce(F.col("_status") == "answered", F.lit(False))
    code = F.when(F.col("_recorded").isNull(), F.when(answered, "missing")).when(~answered, "not_derivable").when(F.col("inputs") != F.col("_inputs"), "input_mismatch").when(~F.col("value").eqNullSafe(F.col("_value")), "value_mismatch")
    return both.select("case_id", code.alias("code")).where("code IS NOT NULL")
