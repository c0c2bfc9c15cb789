"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training rows labelled 1; the unlabelled set is training text whatever its label; rows labelled 0
are not used as such. The class prior is estimated from these two sets: a discriminator of positives from unlabelled
text is fitted on one half, and on the other half the share of unlabelled text above a threshold over that of positives,
at the threshold whose upper bound is least, is how many positives the unlabelled text holds; the halves change places
and the mean counts (with fewer than FEW rows in either set, PRIOR). A linear scorer over text statistics (binned to
soft steps, so that each statistic may act in either direction) minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second term is negative its gradient is followed upwards, as the non-negative
estimator asks. Both sets are bounded samples (TRAIN_ROWS each, by hash of doc_id); scoring covers all rows and texts. The ids of
the sampled positives, as many as that bound, are broadcast, so no text is shuffled.

Defined cases: null and empty text have the statistics 0 and get a score like any other; without positives or
unlabelled text every score is the prior; repeated rows score alike; a doc_id labelled twice is positive where one label is; labels with null quality are not learned; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, texts_of

TRAIN_ROWS, PRIOR, STEPS, FEW = 12_000, 0.5, 600, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1
_CLASS[[32, 9, 13]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "<>{}[]|\\/=_"]] = 8
NAMES = ["log_bytes", "lower", "upper", "digit", "space", "line", "stop", "loud", "markup", "other", "word_len", "distinct", "repeated", "top_word", "long_words", "distinct_lines", "byte_entropy", "distinct_trigrams"]


def statistics(text: str) -> list[float]:
    """The numbers that the scorer sees, in the order of NAMES."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    each = np.bincount(data, minlength=256)
    kind = np.bincount(_CLASS, weights=each, minlength=9) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    count = Counter(words)
    lines = raw.split(b"\n")
    share = each[each > 0] / len(raw)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    grams = max(1, len(words) - 2)
    return [
        math.log1p(len(raw)) / 10,
        kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8], kind[0],
        min(1.0, len(raw) / n / 20),
        len(count) / n / min(1.0, 4 * n**-0.25) if n > 256 else len(count) / n,
        again,
        (count.most_common(1)[0][1] if words else 0) / n,
        sum(len(w) > 20 for w in count) / n,
        len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()) / 8,
        len(set(zip(words, words[1:], words[2:]))) / grams,
    ]


def features_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with x, the statistics of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(rows, docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType())))


class Scorer:
    """Linear in soft steps at the quantiles of each statistic."""

    def __init__(self, sample: np.ndarray, prior: float):
        cuts = np.quantile(sample, [0.01, 0.03, 0.08, 0.2, 0.5, 0.8, 0.92, 0.97, 0.99], axis=0) if len(sample) else np.zeros((9, len(NAMES)))
        self.cuts = cuts
        self.scale = np.maximum(1e-3, (cuts[-1] - cuts[0]) / 12)
        self.weight, self.bias = np.zeros(cuts.size), math.log(prior / (1 - prior))

    def steps(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None, :] - self.cuts[None]) / self.scale
        return np.tanh(z).reshape(len(x), -1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(x))


def descend(w: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Adam from w along the slope."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def discriminator(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS // 2, decay: float = 1e-3) -> Scorer:
    """Logistic regression of positives against unlabelled text, both sets of the same weight."""
    model = Scorer(np.concatenate([positive, unlabelled]), 0.5)
    p, u = (np.hstack([model.steps(x), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w = descend(np.append(model.weight, model.bias), lambda w: p.T @ (_logistic(p @ w) - 1) / len(p) + u.T @ _logistic(u @ w) / len(u) + decay * w, steps)
    model.weight, model.bias = w[:-1], float(w[-1])
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, from these two sets alone; the order of the rows does not matter."""
    if min(len(positive), len(unlabelled)) < FEW:
        return PRIOR
    p, u = (x[np.lexsort(x.T)] for x in (positive, unlabelled))
    found = []
    for half in (0, 1):
        model = discriminator(p[1 - half :: 2], u[1 - half :: 2])
        sp, su = np.sort(model.margin(p[half::2])), np.sort(model.margin(u[half::2]))
        above_p, above_u = (1 - np.searchsorted(x, sp, side="left") / len(x) for x in (sp, su))
        doubt = sum(math.sqrt(math.log(20) / 2 / len(x)) for x in (sp, su)) / 2
        best = int(np.argmin((above_u + doubt) / above_p))
        found.append(min(1.0, above_u[best] / above_p[best]))
    return float(np.mean(found))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = 1e-4) -> Scorer:
    """Minimises the non-negative risk over the whole sample."""
    prior = min(0.999, max(0.001, prior))
    model = Scorer(np.concatenate([positive, unlabelled]) if len(positive) and len(unlabelled) else np.empty((0, len(NAMES))), prior)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = (np.hstack([model.steps(x), np.ones((len(x), 1))]) for x in (positive, unlabelled))

    def slope(w: np.ndarray) -> np.ndarray:
        sp, su = _logistic(p @ w), _logistic(u @ w)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gain = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return prior * (p.T @ (sp - 1)) / len(p) + (gain if negative >= 0 else -gain) + decay * w

    w = descend(np.append(model.weight, model.bias), slope, steps)
    model.weight, model.bias = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, allowed, rows: int = TRAIN_ROWS) -> Scorer:
    """Fits on the allowed rows: a bounded sample of positives and of unlabelled text."""
    known = labels.where(F.col("quality") == 1).select("doc_id").distinct().where(allowed)
    positives = known.count()
    if not positives:
        return fit(np.empty((0, len(NAMES))), np.empty((0, len(NAMES))), PRIOR)
    total = docs.where(allowed).count()
    turn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    few = lambda most, of: turn < int(min(1.0, most / max(1, of)) * (1 << 20)) + 1
    trusted = known.where(few(rows, positives)).select("doc_id", F.lit(True).alias("trusted"))
    chosen = docs.select("doc_id", "text").where(allowed).join(F.broadcast(trusted), "doc_id", "left").where(F.col("trusted") | few(rows, total))
    got = features_of(chosen.withColumn("free", few(rows, total)), "trusted", "free").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(NAMES))
    positive, unlabelled = x[[bool(r["trusted"]) for r in got]], x[[bool(r["free"]) for r in got]]
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def predict(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
