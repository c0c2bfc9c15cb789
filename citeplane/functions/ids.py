"""Canonical JSON, content ids, ULIDs, producer references, versions and timestamps."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SAFE_INTEGER = 2**53 - 1
#: The alphabet of ULIDs.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ULID = "^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
VERSION_NAME, MAJOR, MINOR = "citeplane", 0, 1


def number_text(x: float) -> str:
    """A finite double as ECMAScript prints it."""
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x):.17e}".partition("e")
    for digits in range(17):  # the shortest mantissa that reads back
        mantissa, _, exponent = f"{abs(x):.{digits}e}".partition("e")
        if float(f"{mantissa}e{exponent}") == abs(x):
            break
    figures, point, sign = mantissa.replace(".", ""), int(exponent) + 1, "-" if x < 0 else ""
    if 0 < point <= 21:
        body = figures + "0" * (point - len(figures)) if len(figures) <= point else f"{figures[:point]}.{figures[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + figures
    else:
        tail = f".{figures[1:]}" if len(figures) > 1 else ""
        body = f"{figures[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + body


def timestamp_text(value: dt.datetime) -> str:
    """UTC with six fractional digits and Z; a naive time is refused."""
    if value.utcoffset() is None:
        raise ValueError("timestamps must have a zone")
    return value.astimezone(dt.UTC).replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"


def canonical_json(value: object) -> str:
    """RFC 8785: keys by UTF-16 code units, ECMAScript numbers, integers within the safe range, no lone surrogates."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        value.encode()
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > SAFE_INTEGER:
            raise ValueError("integer outside the safe range")
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, dt.datetime):
        return json.dumps(timestamp_text(value))
    if isinstance(value, dt.date):
        return json.dumps(value.isoformat())
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys must be strings")
        ordered = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in ordered) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    raise TypeError(f"no canonical form: {type(value).__name__}")


def parse_canonical(text: str) -> object:
    """JSON with integers beyond the safe range read as doubles."""

    def integer(literal: str) -> int | float:
        return int(literal) if abs(int(literal)) <= SAFE_INTEGER else float(literal)

    return json.loads(text, parse_int=integer)


@F.pandas_udf(T.StringType())
def canon(texts: pd.Series) -> pd.Series:
    """JSON text in canonical form; null where it is not JSON or has none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_json(parse_canonical(text))
        except (ValueError, TypeError):
            return None

    return texts.map(one)


def _quoted(x: Column) -> Column:
    """A JSON string. Native for text without control characters, which ids, kinds and types never hold."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))


def _sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def inclusion_id(source_id: Column, start: Column, end: Column) -> Column:
    return _sha('{"end":', end.cast("string"), ',"source_id":', _quoted(source_id), ',"start":', start.cast("string"), "}")


def mention_id(source_id: Column, start: Column, end: Column, mention_type: Column, fragments: Column | None = None) -> Column:
    """Fragments (array of struct start, end) enter only when there are some."""
    head = [F.lit('{"end":'), end.cast("string")]
    if fragments is not None:
        pieces = F.transform(fragments, lambda f: F.concat(F.lit("["), f["start"].cast("string"), F.lit(","), f["end"].cast("string"), F.lit("]")))
        head.append(F.when(F.size(fragments) > 0, F.concat(F.lit(',"fragments":['), F.array_join(pieces, ","), F.lit("]"))).otherwise(""))
    return _sha(*head, ',"mention_type":', _quoted(mention_type), ',"source_id":', _quoted(source_id), ',"start":', start.cast("string"), "}")


@F.pandas_udf(T.StringType())
def source_id(patient: pd.Series, kind: pd.Series, external: pd.Series, text: pd.Series, record: pd.Series) -> pd.Series:
    """Hash of a source; its structured record enters only when set. Texts need general escaping, so this is Arrow code."""

    def one(p, k, e, t, r) -> str:
        fields = {"external_id": e, "kind": k, "patient_id": p, "text": t}
        if r is not None:
            fields["record"] = parse_canonical(r)
        return hashlib.sha256(canonical_json(fields).encode()).hexdigest()

    return pd.Series([one(*row) for row in zip(patient, kind, external, text, record)])


@F.pandas_udf(T.StringType())
def content_id(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON text (structured evidence, examples, decisions, variable sets)."""
    return texts.map(lambda t: None if t is None else hashlib.sha256(canonical_json(parse_canonical(t)).encode()).hexdigest())


def example_id(content: dict) -> str:
    """Identity of a snapshot: its content without id and version, record lists in canonical order."""
    lists = ("claims", "mentions", "mention_readings", "evidence", "edges")
    fields = {k: sorted(v, key=canonical_json) if k in lists and isinstance(v, list) else v for k, v in content.items() if k not in ("example_id", "schema_version")}
    return hashlib.sha256(canonical_json(fields).encode()).hexdigest()


def is_ulid(x: Column) -> Column:
    return x.rlike(ULID)


def ulid_text(value: bytes) -> str:
    number = int.from_bytes(value, "big")
    return "".join(CROCKFORD[number >> 5 * i & 31] for i in reversed(range(26)))


@F.pandas_udf(T.StringType())
def seeded_ulid(seed: pd.Series, n: pd.Series) -> pd.Series:
    """The n-th id of a seed: zero time and the first 80 bits of SHA-256(seed, 0, n)."""
    return pd.Series([ulid_text(bytes(6) + hashlib.sha256(f"{s}\0{i}".encode()).digest()[:10]) for s, i in zip(seed, n)])


_SEGMENT = r"[^\s\x00-\x1f\x7f@+]+"
#: The four spellings of a producer reference.
PRODUCERS = {
    "rule": rf"^rule:({_SEGMENT})@({_SEGMENT})(?:\+({_SEGMENT}))?$",
    "model": rf"^model:({_SEGMENT})(?:@({_SEGMENT}))?$",
    "tool": rf"^tool:({_SEGMENT})(?:@({_SEGMENT}))?$",
    "human": r"^human:([^\s\x00-\x1f\x7f]+)$",
}


def parse_producer(x: Column) -> Column:
    """struct(kind, name, version, hash), null where the reference is malformed."""
    out = F.lit(None).cast("struct<kind:string,name:string,version:string,hash:string>")
    groups = {"rule": 3, "model": 2, "tool": 2, "human": 1}
    for kind, pattern in PRODUCERS.items():
        part = [F.nullif(F.regexp_extract(x, pattern, i + 1), F.lit("")) if i < groups[kind] else F.lit(None).cast("string") for i in range(3)]
        out = F.when(x.rlike(pattern), F.struct(F.lit(kind).alias("kind"), part[0].alias("name"), part[1].alias("version"), part[2].alias("hash"))).otherwise(out)
    return out


def configuration_key(x: Column) -> Column:
    """What identifies the configuration of a rule (its hash dropped) or a model; null for people and tools."""
    return F.when(x.rlike(PRODUCERS["rule"]), F.regexp_replace(x, r"\+[^+]*$", "")).when(x.rlike(PRODUCERS["model"]), x)


def version_ok(x: Column) -> Column:
    """Same major, minor at most the current one."""
    pattern = rf"^{VERSION_NAME}/(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
    return F.coalesce(x.rlike(pattern) & (F.regexp_extract(x, pattern, 1) == str(MAJOR)) & (F.length(F.regexp_extract(x, pattern, 2)) <= len(str(MINOR))) & (F.regexp_extract(x, pattern, 2) <= str(MINOR)), F.lit(False))


def timestamp_column(ts: Column) -> Column:
    """UTC with six digits and Z; the session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
