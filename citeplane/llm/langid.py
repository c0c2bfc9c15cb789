"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case letters with every other character as a space; its bigrams and trigrams are hashed to
BUCKETS features. The model is the log-probability matrix (features x languages, add-one smoothing) and the log
priors; it is broadcast, its size being BUCKETS times the number of languages. A batch is scored as one sparse product:
the matrix rows of all its n-grams, summed within documents.

The n-gram counts are fitted on at most `train_docs` documents (by hash of doc_id; all, when there are fewer); the
priors count all training documents. All languages are learned; more than MAX_LANGS labels are an error, as their matrix
(128 KB a language) is too large to broadcast.

Defined cases: a text that is null or has no letter is `und` with score 0.0; without training documents every text is;
null lang is never learned; ties between languages go to the first by code point; repeated rows score alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, texts_of

BUCKETS, TRAIN_DOCS, MAX_LANGS = 1 << 15, 20_000, 2000
UNKNOWN = "und"


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each n-gram of the batch, where each document starts, and which documents have a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    joined = "".join([f"  {t}  " for t in texts]) + "  "  # no n-gram that a document starts reaches another's letters
    c = _TABLE[0][np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    starts = np.cumsum([0, *(len(t) + 4 for t in texts[:-1])])
    lettered = np.add.reduceat(c[:-1] != 32, starts) > 0
    two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B)
    three = two * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    features = np.empty((len(two), 2), np.uint32)
    features[:, 0] = ((two ^ (two >> 15)) * np.uint32(0x2C1B3C6D)) >> 17
    features[:, 1] = ((three ^ (three >> 15)) * np.uint32(0x2C1B3C6D)) >> 17
    return features, starts, lettered


def _count_rows(langs: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in slices(batches):
            texts, of = texts_of(batch), np.array(batch.column("lang").to_pylist(), object)
            for k, lang in enumerate(langs):
                own = [texts[i] for i in np.flatnonzero(of == lang)]
                if own:
                    total[k] += np.bincount(ngrams(own)[0].ravel(), minlength=BUCKETS)
        k, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(total[k, feature])], names=["k", "feature", "n"])

    return count


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (features x languages) and log priors, of rows with text and lang."""
    docs = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    per = docs.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(per) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    langs, total = sorted(r["lang"] for r in per), sum(r["count"] for r in per)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    keep = min(1.0, train_docs / total)
    part = docs.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    counts = np.ones((BUCKETS, len(langs)))
    found = part.mapInArrow(_count_rows(langs), "k int, feature int, n long").groupBy("k", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[found["feature"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    prior = dict((r["lang"], r["count"]) for r in per)
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(np.array([prior[x] for x in langs]) / total)


def score(texts: list[str], langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    if not langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    features, starts, lettered = ngrams(texts)
    sums = np.zeros((len(texts), len(langs)))
    for k in range(len(langs)):
        column = matrix[:, k]
        sums[:, k] = np.add.reduceat((column[features[:, 0]] + column[features[:, 1]]).astype(np.float64), starts)
    sums += prior
    best = sums.argmax(axis=1)
    chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, chance, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in dict.fromkeys((*keep, "text"))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said, chance = score(texts_of(batch), *shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(said, pa.string()), pa.array(chance)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*columns).mapInArrow(rows, schema)
