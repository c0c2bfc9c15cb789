"""The thirteen tables of a bundle: columns, types, nullability, keys, payload kinds, and which a bundle kind needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Table layouts. A column is name, then ? if it may be null, then its type if that is not string
#: (j: JSON text, l: long, d: double, b: boolean, t: timestamp). +prov stands for the provenance columns.
_TYPES = {"": T.StringType(), "j": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType()}
PROVENANCE = ("producer", "run_id", "created_at:t", "zone", "sensitivity", "policy_version", "model?", "prompt_versions?:j", "parameters?:j", "trace_id?", "span_id?", "decision_id?")
LAYOUT = {
    "sources": ("source_id", "source_id patient_id kind external_id? datetime?:t text_hash record?:j sections:j meta:j", "derived_text"),
    "mentions": ("mention_id", "mention_id source_id start:l end:l quote mention_type fragments?:j section_category?", "derived_text"),
    "mention_readings": ("reading_id", "reading_id mention_id case_id label? value?:j unit? attributes:j concept?:j inputs?:j status +prov", "derived_text"),
    "claims": ("claim_id", "claim_id case_id source_id patient_id variable variable_set variable_set_version schema_ref reading_id? value:j effective_datetime?:t confidence?:d status +prov", "by_schema"),
    "evidence": ("evidence_id", "evidence_id kind source_id? start?:l end?:l quote? alignment? alignment_score?:d field? value?:j datetime?:t rationale? inputs?:j derivation?:j trace_id? span_id? +prov?", "derived_text"),
    "evidence_edges": ("claim_id evidence_id role", "claim_id evidence_id role? weight?:d", "labels_only"),
    "cases": ("case_id", "case_id dataset dataset_manifest_hash source_id patient_id variable_set variable_set_version variable_set_ref sensitivity split? created_at:t", "labels_only"),
    "variable_outcomes": ("case_id variable", "case_id variable status reason? failure_kind? reviewed_source_ids:j evidence_ids:j final_claim_ids:j +prov", "derived_text"),
    "results": ("case_id run_id", "case_id run_id grounding_failures:l tool_calls:l escalated:b trace_id? budget?:j usage?:j", "labels_only"),
    "annotation_events": ("event_id", "event_id case_id variable? actor role round:l stream? action target_id? before?:j after?:j reason? at:t external_ref? +prov", "derived_text"),
    "examples": ("example_id variable", "example_id variable case_id variable_set variable_set_version variable_set_ref as_of_event split? tier outcome_status final_claim_ids:j annotators:j adjudicator? derived_from_events:j created_at:t", "labels_only"),
    "label_records": ("case_id variable", "case_id variable variable_set variable_set_version variable_set_ref tier outcome_status value?:j producer split?", "by_schema"),
    "decisions": ("decision_id", "decision_id checked_at:t permitted:b reason restriction_id? policy_version destination destination_kind zone sensitivity payload dataset? run_id? case_id?", "labels_only"),
}
ALWAYS = ("sources", "mentions", "mention_readings", "claims", "evidence", "evidence_edges", "cases", "variable_outcomes")
REQUIRED = {"run": (*ALWAYS, "results"), "review": (*ALWAYS, "results", "annotation_events"), "gold": (*ALWAYS, "results", "annotation_events", "examples"), "labels": ("cases", "label_records")}
OPTIONAL = {kind: tuple(t for t in ("results", "annotation_events", "examples", "label_records", "decisions") if t not in need) for kind, need in REQUIRED.items()}


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    schema: T.StructType
    json: frozenset[str]
    payload: str


def _field(spec: str, prefix: str = "", loose: bool = False) -> tuple[T.StructField, bool]:
    name, _, kind = spec.partition(":")
    return T.StructField(prefix + name.rstrip("?"), _TYPES[kind], loose or name.endswith("?")), kind == "j"


def _table(name: str) -> Table:
    key, columns, payload = LAYOUT[name]
    fields = []
    for spec in columns.split():
        if spec.startswith("+prov"):
            fields += [_field(p, "provenance_", spec.endswith("?")) for p in PROVENANCE]
        else:
            fields.append(_field(spec))
    return Table(name, tuple(key.split()), T.StructType([f for f, _ in fields]), frozenset(f.name for f, j in fields if j), payload)


TABLES = {name: _table(name) for name in LAYOUT}


def payload_kind(table: str, closed: bool) -> str:
    """Kind of payload of a table; claims and labels are labels only if all answer schemas are closed."""
    kind = TABLES[table].payload
    return kind if kind != "by_schema" else "labels_only" if closed else "derived_text"
