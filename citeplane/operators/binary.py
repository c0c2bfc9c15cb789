"""Binary evaluation: confusion counts, measures, intervals, bootstrap and gates."""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import stats

#: Seed and number of resamples by default.
SEED, RESAMPLES = 20260915, 10_000
COUNTS = ("N", "B", "P", "Q", "A", "C", "A_pos", "TP", "FP", "O", "failures", "unattempted", "missing_gold")


def joined(eligible: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each eligible row (repeated ids stay repeated) with its reference and prediction, and what they amount to."""
    g = gold.select("case_id", F.col("value").alias("gold"), F.lit(True).alias("has_gold"))
    p = predicted.select("case_id", F.col("status").alias("p_status"), F.col("value").alias("pred"), "failure_kind", F.lit(True).alias("has_pred"))
    rows = eligible.join(g, "case_id", "left").join(p, "case_id", "left")
    answered = F.coalesce((F.col("p_status") == "answered") & F.col("pred").isNotNull(), F.lit(False))
    return rows.withColumns({"binary": F.col("gold").isNotNull(), "answered": answered})


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts of joined rows, one row, or one for each value of `by`."""
    c, binary, answered, gold, pred = F.count_if, F.col("binary"), F.col("answered"), F.col("gold"), F.col("pred")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("N"),
        c(binary).alias("B"),
        c(binary & gold).alias("P"),
        c(binary & ~gold).alias("Q"),
        c(answered).alias("A"),
        c(answered & binary & (gold == pred)).alias("C"),
        c(answered & pred).alias("A_pos"),
        c(answered & pred & binary & gold).alias("TP"),
        c(binary & ~answered).alias("O"),
        c(F.col("failure_kind").isNotNull()).alias("failures"),
        c(F.col("has_pred").isNull()).alias("unattempted"),
        c(F.col("has_gold").isNull()).alias("missing_gold"),
    )
    return out.withColumn("FP", F.col("A_pos") - F.col("TP")).select(*by, *COUNTS)


def failure_kinds(rows: DataFrame) -> DataFrame:
    return rows.where("failure_kind IS NOT NULL").groupBy("failure_kind").agg(F.count(F.lit(1)).alias("n"))


#: Numerator and denominator of each proportion.
MEASURES = {"precision": ("C", "A"), "ppv": ("TP", "A_pos"), "recall": ("TP", "P"), "omission_rate": ("O", "B"), "coverage": ("A", "N"), "correct_yield": ("C", "N")}


def measures(counted: DataFrame, *by: str, cost: float | None = None) -> DataFrame:
    """(name, kind, numerator, denominator, value); a proportion over 0 and false positives without negatives are null."""
    none = F.lit(None).cast("long")

    def row(name: str, kind: str, numerator, denominator, value):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), numerator.cast("double").alias("numerator"), denominator.cast("long").alias("denominator"), value.cast("double").alias("value"))

    rows = [row(n, "proportion", F.col(a), F.col(b), stats.ratio(F.col(a), F.col(b))) for n, (a, b) in MEASURES.items()]
    rows.append(row("false_positives", "count", F.col("FP"), none, F.when(F.col("Q") > 0, F.col("FP"))))
    rows.append(row("execution_failures", "count", F.col("failures"), none, F.col("failures")))
    if cost is not None:
        rows.append(row("mean_cost", "proportion", F.lit(cost), F.col("N"), stats.ratio(F.lit(cost), F.col("N"))))
    return counted.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.*")


def with_wilson(measured: DataFrame) -> DataFrame:
    """Intervals of the proportions that are binomial."""
    w = stats.wilson(F.col("numerator"), F.col("denominator"))
    fits = (F.col("kind") == "proportion") & (F.col("name") != "mean_cost")
    return measured.withColumn("low", F.when(fits, w["low"])).withColumn("high", F.when(fits, w["high"]))


def resampled(eligible: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> Iterable[tuple[int, str]]:
    """(replicate, case_id) draws with replacement, by the seeded Mersenne Twister, one replicate after the other."""
    draw = random.Random(seed)
    for r in range(resamples):
        for _ in eligible:
            yield r, eligible[draw.randrange(len(eligible))]


def places(n: int, resamples: int, seed: int) -> Iterable[np.ndarray]:
    """For each replicate the n places below n that resampled() draws: the same generator's words, taken in bulk."""
    key = random.Random(seed).getstate()[1]
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], np.uint32), "pos": key[-1]}}
    held = np.empty(0, np.int64)
    for _ in range(resamples):
        while len(held) < n:
            drawn = (twister.random_raw(max(n, 1 << 14)) >> np.uint64(32 - n.bit_length())).astype(np.int64)
            held = np.append(held, drawn[drawn < n])
        yield held[:n]
        held = held[n:]


def bootstrap(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """Percentile interval of each measure over whole-case resamples; undefined replicates are left out and counted.

    A replicate depends on how often it draws a case, and cases with equal flags are alike. So cases are grouped by
    their flags (a few dozen groups) and the driver draws groups: (replicate, group, times), joined with a group's counts and summed natively.
    The draws are those of a draw over cases in case_id order.
    """
    spark = rows.sparkSession
    flags = ["binary", "answered", "gold", "pred", "failure_kind", "has_pred", "has_gold"]
    kinds = {tuple(r[f] for f in flags): i for i, r in enumerate(rows.select(*flags).distinct().collect())}
    order = np.array([kinds[tuple(r[f] for f in flags)] for r in rows.select("case_id", *flags).orderBy("case_id").toLocalIterator()], np.int64)
    times = np.array([np.bincount(order[at], minlength=len(kinds)) for at in places(len(order), resamples if len(order) else 0, seed)], np.int64).reshape(-1, len(kinds))
    replicate, kind = np.nonzero(times)
    draws = spark.createDataFrame(pa.table({"replicate": replicate.astype(np.int32), "kind": kind.astype(np.int32), "times": times[replicate, kind]}))
    groups = spark.createDataFrame([(i, *k) for k, i in kinds.items()], "kind int, binary boolean, answered boolean, gold boolean, pred boolean, failure_kind string, has_pred boolean, has_gold boolean")
    per = draws.join(F.broadcast(counts(groups, "kind")), "kind").groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in COUNTS))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    spread = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return measures(per, "replicate").groupBy("name").agg(spread.alias("q"), F.count("value").alias("defined"), F.count_if(F.col("value").isNull()).alias("undefined")).select("name", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "defined", "undefined")


def gates(specs: DataFrame, measured: DataFrame, provisional: bool, label_only: bool, evidence: tuple[str, ...] = ()) -> DataFrame:
    """Status of each gate (name, measure, op, threshold). A pass on provisional references is inconclusive, a failure is not."""
    m = measured.select(F.col("name").alias("measure"), "value", "numerator", "denominator")
    value = F.when(F.col("measure").isin(*evidence) & F.lit(label_only), F.lit(None)).otherwise(F.col("value")) if evidence else F.col("value")
    found = specs.join(m, "measure", "left").withColumn("value", value)
    passed = F.when(F.col("op") == "ge", F.col("value") >= F.col("threshold")).when(F.col("op") == "le", F.col("value") <= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    found = found.withColumn("observed_pass", passed)
    status = F.when(F.col("observed_pass").isNull(), "inconclusive").when(~F.col("observed_pass"), "unmet").otherwise("inconclusive" if provisional else "met")
    return found.select("name", "measure", status.alias("status"), "observed_pass", F.lit(provisional).alias("provisional"), "value", "numerator", "denominator")


def overall(results: DataFrame, incomplete: bool = False) -> DataFrame:
    """unmet if any gate is; met if there are gates, all met, and nothing is incomplete; else inconclusive."""
    unmet, met = F.bool_or(F.col("status") == "unmet"), F.bool_and(F.col("status") == "met")
    return results.agg(F.when(unmet, "unmet").when(met & F.lit(not incomplete), "met").otherwise("inconclusive").alias("overall"))


def review_effort(events: DataFrame) -> DataFrame:
    """Submitted reviews, timed ones, active and idle seconds, and whether all are timed. after is JSON."""
    submits = events.where("action = 'review.submit'")
    active, idle = (F.get_json_object("after", f"$.{k}").cast("double") for k in ("active_seconds", "idle_seconds"))
    return submits.agg(F.count(F.lit(1)).alias("reviews"), F.count(active).alias("timed"), F.coalesce(F.sum(active), F.lit(0.0)).alias("active_seconds"), F.coalesce(F.sum(idle), F.lit(0.0)).alias("idle_seconds")).withColumn("complete", F.col("reviews") == F.col("timed"))


def expert_minutes(effort: DataFrame, accepted: int, other_minutes: float = 0.0) -> DataFrame:
    """Minutes for each accepted case; null while a review is untimed or nothing is accepted."""
    total = F.col("active_seconds") / 60 + F.lit(other_minutes)
    return effort.select(F.when(F.col("complete"), F.try_divide(total, F.lit(float(accepted)))).alias("minutes_per_case"))
