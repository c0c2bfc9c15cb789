"""Bundles: directories of Parquet tables with a manifest of counts and content hashes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import ids, text as tx
from ..operators.replay import replay
from .tables import OPTIONAL, REQUIRED, TABLES, Table, payload_kind

VERSION = f"{ids.VERSION_NAME}/{ids.MAJOR}.{ids.MINOR}"


class BundleError(ValueError):
    """A bundle was refused; carries a code and a table, never content."""

    def __init__(self, code: str, table: str | None = None):
        super().__init__(code if table is None else f"{code}: {table}")
        self.code, self.table = code, table


@dataclass
class Bundle:
    kind: str
    tables: dict[str, DataFrame]
    manifest: dict = field(default_factory=dict)


class Unvalidated:
    """A table as read: validated interfaces take DataFrames and so refuse it."""

    def __init__(self, rows: DataFrame):
        self._rows = rows

    @property
    def columns(self) -> list[str]:
        return self._rows.columns

    def get(self, column: str) -> Column:
        return self._rows[column]


def text_hash(text: Column, record: Column | None = None) -> Column:
    """SHA-256 of a source's text; of its canonical record, under the name record, where it has no text but one (JSON)."""
    if record is None:
        return F.sha2(text, 256)
    shown = F.concat(F.lit('{"record":'), ids.canon(record), F.lit("}"))
    return F.when(text.isNotNull(), F.sha2(text, 256)).otherwise(F.sha2(shown, 256))


#: Control characters that JSON names by a letter.
_NAMED = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def json_text(c: Column) -> Column:
    """A string as canonical JSON: quotes, backslashes and control characters escaped, hexadecimal in lower case."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit("\\" + _NAMED.get(i, f"u{i:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r'["\\\x00-\x1f]'), out).otherwise(c), F.lit('"'))


def row_text(table: Table, columns: list[str]) -> Column:
    """A row's canonical form: its columns by name, numbers and times as canonical JSON prints them, nulls kept."""
    types = {f.name: f.dataType for f in table.schema}
    parts = []
    for name in sorted(columns):
        kind, c = types.get(name, T.StringType()), F.col(name)
        if isinstance(kind, T.TimestampType):
            shown = F.concat(F.lit('"'), ids.timestamp_column(c), F.lit('"'))
        elif isinstance(kind, (T.LongType, T.BooleanType)):
            shown = c.cast("string")
        elif isinstance(kind, T.DoubleType):
            shown = ids.canon(c.cast("string"))
        elif name in table.json:
            shown = c
        else:
            shown = json_text(c)
        parts.append(F.concat(F.lit(json.dumps(name) + ":"), F.coalesce(shown, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_hash(table: Table, rows: DataFrame) -> DataFrame:
    """rows and content: SHA-256 of the rows' canonical forms in key order, nulls first, key parts as strings, joined by line
    ends.

    The format hashes one ordered text, so this is one task whatever the size; its sort spills, and the rows are hashed as
    they stream by, so its memory does not grow with them.
    """

    def digest(batches):
        total, n = hashlib.sha256(), 0
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                total.update((("\n" if n else "") + "\n".join(lines)).encode())
                n += len(lines)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.hexdigest()])], names=["rows", "content"])

    kinds = dict(rows.dtypes)
    void = {"string": "''", "boolean": "false"}
    keys = [F.when(F.col(k) == F.expr(void.get(kinds[k], "0")), F.lit("")).otherwise(F.col(k).cast("string")) if kinds[k] in ("string", "boolean", "bigint", "int", "double") else F.col(k).cast("string") for k in table.key]
    each = rows.select(row_text(table, rows.columns).alias("row"), *(c.alias(f"k{i}") for i, c in enumerate(keys)))
    each = each.repartition(1).sortWithinPartitions(*(F.col(f"k{i}").asc_nulls_first() for i in range(len(keys)))).select("row")
    found = each.mapInArrow(digest, "rows long, content string")
    nothing = hashlib.sha256().hexdigest()
    return found.agg(F.coalesce(F.max("rows"), F.lit(0).cast("long")).alias("rows"), F.coalesce(F.max("content"), F.lit(nothing)).alias("content"))


def row_errors(table: Table, rows: DataFrame) -> DataFrame:
    """(code, column, n) of what is wrong with rows: schema first, then nulls, numbers and keys."""
    have = {f.name: f.dataType for f in rows.schema}
    want = {f.name: f for f in table.schema}
    found = [("missing_column", c) for c in want if c not in have]
    found += [("wrong_type", c) for c in want if c in have and have[c] != want[c].dataType]
    found += [("unknown_column", c) for c in have if c not in want and not c.startswith("x_")]
    spark = rows.sparkSession
    out = spark.createDataFrame([(a, b, 1) for a, b in found], "code string, column string, n long")
    fine = [c for c in want if c in have and have[c] == want[c].dataType]
    checks = {("null_value", c): F.col(c).isNull() for c in fine if not want[c].nullable}
    checks |= {("not_finite", c): F.isnan(c) | (F.abs(c) == float("inf")) for c in fine if isinstance(have[c], T.DoubleType)}
    checks |= {("not_canonical", c): F.col(c).isNotNull() & ~F.col(c).eqNullSafe(ids.canon(F.col(c))) for c in fine if c in table.json}
    if checks:
        counted = rows.agg(*(F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(checks.values())))
        pairs = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, (code, c) in enumerate(checks)))
        out = out.unionByName(counted.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0"))
    if all(k in fine for k in table.key):
        twice = rows.groupBy(*table.key).count().where("count > 1")
        out = out.unionByName(twice.agg(F.lit("duplicate_key").alias("code"), F.lit(",".join(table.key)).alias("column"), F.count(F.lit(1)).alias("n")).where("n > 0"))
    return out


def upsert(table: Table, *parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows once for each key, conflicting keys)."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.distinct()
    clash = rows.groupBy(*table.key).agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")
    return rows, clash


def plain(table: Table, rows: DataFrame) -> DataFrame:
    """Declared columns only."""
    return rows.select(*(f.name for f in table.schema))


def flat(rows: DataFrame, struct: str = "provenance") -> DataFrame:
    """A record's provenance struct as provenance_* columns."""
    names = rows.schema[struct].dataType.names
    return rows.select(*(c for c in rows.columns if c != struct), *(F.col(f"{struct}.{n}").alias(f"{struct}_{n}") for n in names))


def nested(rows: DataFrame, struct: str = "provenance") -> DataFrame:
    """provenance_* columns as one struct, null where all are."""
    own = [c for c in rows.columns if c.startswith(f"{struct}_")]
    made = F.struct(*(F.col(c).alias(c.removeprefix(f"{struct}_")) for c in own))
    return rows.select(*(c for c in rows.columns if c not in own), F.when(F.coalesce(*(F.col(c).cast("string") for c in own)).isNotNull(), made).alias(struct))


def build(kind: str, parts: dict[str, list[DataFrame]], closed: bool, **about: str) -> Bundle:
    """Assembles a bundle: tables united by key, refused on conflicts and on rows that do not fit, hashed into a manifest."""
    tables = {}
    for name in (*REQUIRED[kind], *(t for t in OPTIONAL[kind] if t in parts)):
        if name not in parts:
            raise BundleError("missing_table", name)
        if kind == "labels" and payload_kind(name, closed) != "labels_only":
            raise BundleError("derived_text_payload", name)
        rows, clash = upsert(TABLES[name], *parts[name])
        if not clash.isEmpty():
            raise BundleError("conflicting_rows", name)
        errors = row_errors(TABLES[name], rows).orderBy("code", "column").first()
        if errors:
            raise BundleError(errors["code"], name)
        tables[name] = rows
    manifest = {"schema_version": VERSION, "kind": kind, **about, "tables": {}}
    for name, rows in tables.items():
        h = content_hash(TABLES[name], rows).first()
        manifest["tables"][name] = {"rows": h["rows"], "content_sha256": h["content"], "payload": payload_kind(name, closed)}
    return Bundle(kind, tables, manifest)


def write(bundle: Bundle, spark: SparkSession, directory: str) -> None:
    """One sorted Parquet table each; the manifest comes last, so a directory without one is no bundle."""
    if _exists(spark, directory):
        raise BundleError("directory_exists")
    for name, rows in bundle.tables.items():
        rows.sortWithinPartitions(*TABLES[name].key).write.mode("errorifexists").parquet(f"{directory}/{name}.parquet")
    manifest = spark.createDataFrame([(ids.canonical_json(bundle.manifest),)], "value string")
    manifest.coalesce(1).write.text(f"{directory}/manifest.json")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, directory: str) -> Bundle:
    """Manifest first, with its version; then every table it declares, with its exact columns and types."""
    if not _exists(spark, f"{directory}/manifest.json"):
        raise BundleError("missing_manifest")
    manifest = json.loads(spark.read.text(f"{directory}/manifest.json").first()["value"])
    if not spark.range(1).select(ids.version_ok(F.lit(manifest.get("schema_version")))).first()[0]:
        raise BundleError("unsupported_version")
    tables = {}
    for name in manifest["tables"]:
        if name not in TABLES:
            raise BundleError("unknown_table", name)
        rows = spark.read.parquet(f"{directory}/{name}.parquet")
        have = {f.name: f.dataType for f in rows.schema}
        for f in TABLES[name].schema:
            if have.get(f.name) != f.dataType:
                raise BundleError("wrong_type" if f.name in have else "missing_column", name)
        if any(c not in TABLES[name].schema.names and not c.startswith("x_") for c in have):
            raise BundleError("unknown_column", name)
        tables[name] = rows
    return Bundle(manifest["kind"], tables, manifest)


def check(bundle: Bundle) -> list[tuple[str, str]]:
    """(code, table) of every structural fault: tables, counts, hashes, rows, case scope."""
    found = [("missing_table", t) for t in REQUIRED[bundle.kind] if t not in bundle.tables]
    found += [("unexpected_table", t) for t in bundle.tables if t not in REQUIRED[bundle.kind] and t not in OPTIONAL[bundle.kind]]
    for name, rows in bundle.tables.items():
        said, now = bundle.manifest["tables"].get(name), content_hash(TABLES[name], rows).first()
        if said is None or said["rows"] != now["rows"]:
            found.append(("row_count", name))
        elif said["content_sha256"] != now["content"]:
            found.append(("content_mismatch", name))
        found += [(r["code"], name) for r in row_errors(TABLES[name], rows).collect()]
    cases = bundle.tables.get("cases")
    for name, rows in bundle.tables.items() if cases is not None else ():
        if name not in ("cases", "decisions") and "case_id" in rows.columns and not rows.join(cases, "case_id", "left_anti").isEmpty():
            found.append(("case_scope", name))
    return found


def resolve(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Sources with text and code: source_unavailable without one, source_hash_mismatch where its text is another."""
    joined = rows.join(texts.select("source_id", "text"), "source_id", "left")
    return joined.withColumn("code", F.when(F.col("text").isNull(), "source_unavailable").when(text_hash(F.col("text")) != F.col("text_hash"), "source_hash_mismatch"))


def load(bundle: Bundle, texts: DataFrame, finals: tuple[str, ...] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(validated tables, errors as table, id, code): sources resolved, spans grounded again, references and events replayed."""
    faults = check(bundle)
    if faults:
        raise BundleError(*faults[0])
    t = bundle.tables
    errors = []
    if "sources" in t:
        sources = resolve(t["sources"], texts)
        errors.append(sources.where("code IS NOT NULL").select(F.lit("sources").alias("table"), F.col("source_id").alias("id"), "code"))
        for name, key in (("mentions", "mention_id"), ("evidence", "evidence_id")):
            spans = t[name].where("start IS NOT NULL").join(sources.select("source_id", "text"), "source_id")
            wrong = spans.where(tx.piece(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int")) != F.col("quote"))
            errors.append(wrong.select(F.lit(name), F.col(key), F.lit("quote_mismatch")))
        named = t["evidence"].select("evidence_id").union(t["claims"].select("claim_id"))
        edges = t["evidence_edges"].join(named, "evidence_id", "left_anti")
        errors.append(edges.select(F.lit("evidence_edges"), F.col("evidence_id"), F.lit("unknown_reference")))
    if "annotation_events" in t:
        bad = replay(t["annotation_events"], finals).where("error_code IS NOT NULL")
        errors.append(bad.select(F.lit("annotation_events"), F.col("error_event"), F.col("error_code")))
    out = errors[0] if errors else texts.sparkSession.createDataFrame([], "table string, id string, code string")
    for more in errors[1:]:
        out = out.union(more)
    return {name: plain(TABLES[name], rows) for name, rows in t.items()}, out


def load_labels(bundle: Bundle) -> tuple[DataFrame, dict[str, Unvalidated]]:
    """Label records, checked, and everything else as read."""
    errors = row_errors(TABLES["label_records"], bundle.tables["label_records"]).first()
    if errors:
        raise BundleError(errors["code"], "label_records")
    return plain(TABLES["label_records"], bundle.tables["label_records"]), {n: Unvalidated(r) for n, r in bundle.tables.items() if n != "label_records"}


def unconsumed(table: Table, stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Keys in one of both tables only."""
    a, b = stored.select(*table.key), rebuilt.select(*table.key)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("rebuilt")))
