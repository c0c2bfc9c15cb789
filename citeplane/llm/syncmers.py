"""Document fingerprints from closed syncmers, and their likeness.

A k-mer is a closed syncmer when the smallest of its inner s-mers (by hash) is its first or its last one. Whether it
is chosen depends on its own characters only, so an edit changes the choice at most k - 1 characters around it and
the chosen k-mers are anchors with positions. A fingerprint keeps the `size` anchors of smallest hash with the
position of their first occurrence. Likeness matches anchors by position: of the `size` smallest anchors of both texts,
the share that lies on the longest chain of shared anchors with the same order in both. Insertions and deletions shift
a chain without breaking it; the same passages in another order do not count twice.

Defined cases: null text is empty; an empty text has the empty fingerprint, which is like itself (1.0) and unlike any
other (0.0); a text shorter than a k-mer, or without a syncmer, has one anchor made of all of it or of its smallest
k-mer; repeated rows and equal doc_ids are ordered by (doc_id, text), null doc_id first; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, shuffle_partitions, slices, texts_of

S, WINDOW = 8, 8
K = S + WINDOW - 1
SIZE = 48
_B = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _B2 = np.multiply(_B, _B)
    _B4 = np.multiply(_B2, _B2)


def anchors(text: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and positions of the anchors that the fingerprint keeps."""
    n = len(text)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if n < K:
        digest = hashlib.blake2b(text.encode(), digest_size=8).digest()
        return np.array([int.from_bytes(digest, "little") >> 32], np.uint64), np.zeros(1, np.int64)
    c = (c + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    c ^= c >> np.uint64(29)
    h = c[:-1] * _B + c[1:]
    h = h[:-2] * _B2 + h[2:]
    h = h[:-4] * _B4 + h[4:]
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(32)
    low = np.minimum(h[:-1], h[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    first, last = h[: n - K + 1], h[WINDOW - 1 :]
    at = np.flatnonzero((low == first) | (low == last))
    if not len(at):
        at = np.array([int(np.argmin(low))])
    key = mix64(first[at] * _B + last[at]) >> np.uint64(32)
    if len(at) > 4 * size:
        some = key <= np.partition(key, 3 * size)[3 * size]
        got, where = np.unique(key[some], return_index=True)
        if len(got) >= size:
            return got[:size], at[some][where[:size]]
    got, where = np.unique(key, return_index=True)
    return got[:size], at[where[:size]]


def matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many anchors of two fingerprints match by position: the longest chain of shared ones that has the same order in
    both texts."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    tails: list[int] = []
    for place in b[1][j][np.argsort(a[1][i], kind="stable")].tolist():
        at = bisect_left(tails, place)
        tails[at : at + 1] = [place]
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    """Share of the `size` smallest anchors of both texts that match by position; 1.0 for two empty fingerprints."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    a, b = ((h[h <= union[-1]], p[h <= union[-1]]) for h, p in (a, b))
    return matched(a, b) / len(union)


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as text: hash@position of each anchor, by hash."""
    return ",".join([f"{h:08x}@{p}" for h, p in zip(found[0].tolist(), found[1].tolist())])


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, ahead, doc_id, text): each document meets the next one of its bucket."""
    last = None
    for batch in slices(batches):
        out: list[list] = [[] for _ in FIELDS]
        for bucket, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id")), texts_of(batch)):
            found = anchors(text)
            if last and last[0] == bucket:
                _, was, own, print_ = last
                n = len(own)
                edited = own[: n - n // 4] + text[: n // 4]
                changed = anchors(edited)
                row = (was, n, hashlib.sha256(edited.encode()).hexdigest(), written(print_), written(changed), likeness(print_, changed), likeness(print_, found))
                for column, value in zip(out, row):
                    column.append(value)
            last = None if ahead else (bucket, doc_id, text, found)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, FIELDS)], names=[n for n, _ in FIELDS])


def next_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness to each other and to the next document.

    doc_id order is cut into buckets at quantiles of doc_id, a few for each shuffle partition; the first document of a
    bucket also goes to the bucket before it. So each text is shuffled once, no task sees more than its buckets, and the
    driver gets one id for each bucket.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = 4 * shuffle_partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n).alias("q")).first()["q"] or []
    cuts = np.array(sorted({int(x) for x in cuts}), dtype=np.int64)

    def place(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        return np.where(known, 1 + np.searchsorted(cuts, ids.fillna(0).astype("int64").to_numpy(), side="right"), 0)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(place(ids).astype("int32"))

    firsts = sorted((r["b"], r["id"]) for r in docs.groupBy(bucket_of("doc_id").alias("b")).agg(F.min("doc_id").alias("id")).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    first_id = dict(firsts)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        values = [None if pd.isna(x) else int(x) for x in ids]
        return pd.Series([[b, -1 - before[b]] if first_id[b] == x else [b] for b, x in zip(place(ids).tolist(), values)])

    placed = docs.withColumn("t", F.explode(targets("doc_id"))).select(F.when(F.col("t") < 0, -1 - F.col("t")).otherwise(F.col("t")).alias("bucket"), (F.col("t") < 0).alias("ahead"), "doc_id", "text")
    return placed.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text").mapInArrow(_rows, SCHEMA)
