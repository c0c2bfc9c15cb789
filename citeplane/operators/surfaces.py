"""Where code from outside plugs in: providers, extractors, scorers, labelers.

A provider answers requests; calls are bounded by the budget of their case, so the calls of a case run in order in one
task, cases in parallel. Nothing raises for an expected failure: it is a row with its kind and reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Answer:
    """What a call gave: text, or a failure of a kind (parse, provider, budget) with its reason; and what it cost."""

    text: str | None = None
    kind: str | None = None
    reason: str | None = None
    retryable: bool = False
    tokens: int = 0
    seconds: float = 0.0


@dataclass(frozen=True)
class Budget:
    calls: int | None = None
    tokens: int | None = None
    retries: int | None = None
    seconds: float | None = None


@dataclass
class Meter:
    """Usage of a case against its budget. Without a number of retries none is made."""

    budget: Budget = field(default_factory=Budget)
    calls: int = 0
    tokens: int = 0
    retries: int = 0
    seconds: float = 0.0

    def add(self, answer: Answer, again: bool) -> None:
        self.calls, self.retries = self.calls + 1, self.retries + again
        self.tokens, self.seconds = self.tokens + answer.tokens, self.seconds + answer.seconds

    def over(self) -> bool:
        return any(most is not None and used > most for used, most in ((self.calls, self.budget.calls), (self.tokens, self.budget.tokens), (self.retries, self.budget.retries), (self.seconds, self.budget.seconds)))

    def may_call(self) -> bool:
        return self.budget.calls is None or self.calls < self.budget.calls

    def may_retry(self) -> bool:
        return self.budget.retries is not None and self.retries < self.budget.retries


class Provider(Protocol):
    capabilities: frozenset[str]

    def complete(self, request: dict, attempt: int) -> Answer: ...


class Extractor(Protocol):
    """Outcomes of cases: rows (case_id, variable, status, value, failure_kind), as many as the set has finals, for each."""

    def run(self, cases: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """Metrics (name, value) of predictions against references; a missing denominator gives null, never 0."""

    def score(self, predicted: DataFrame, reference: DataFrame) -> DataFrame: ...


class Labeler(Protocol):
    tier: str

    def label(self, cases: DataFrame) -> DataFrame: ...


class Rejected(ValueError):
    """A plug-in that may not be registered."""


def admit(labeler: object) -> object:
    """Models, rules and importers label silver only; people's tiers come from reviews."""
    if not callable(getattr(labeler, "label", None)) or getattr(labeler, "tier", None) is None:
        raise Rejected("not_a_labeler")
    if labeler.tier != "silver":
        raise Rejected("human_tier")
    return labeler


def score(scorer: Scorer, predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """The scorer's metrics; one named twice or without a name is refused."""
    found = scorer.score(predicted, reference).select("name", F.col("value").cast("double").alias("value"))
    names = found.groupBy("name").count().where("count > 1 OR name IS NULL OR trim(name) = ''")
    if not names.isEmpty():
        raise Rejected("metric_names")
    return found


def extract(extractor: Extractor, cases: DataFrame, finals: list[str]) -> DataFrame:
    """One outcome for each case and final variable: what the extractor leaves out has failed as its provider's fault, and
    what it gives for other cases or variables, or twice, is refused."""
    given = extractor.run(cases)
    want = cases.select("case_id").withColumn("variable", F.explode(F.array(*map(F.lit, finals))))
    if not given.groupBy("case_id", "variable").count().where("count > 1").isEmpty() or not given.join(want, ["case_id", "variable"], "left_anti").isEmpty():
        raise Rejected("outcomes")
    rows = want.join(given, ["case_id", "variable"], "left")
    lost = F.col("status").isNull()
    return rows.withColumn("failure_kind", F.when(lost, "provider").otherwise(F.col("failure_kind"))).withColumn("status", F.coalesce("status", F.lit("failed")))


def ask(provider: Provider, request: dict, meter: Meter) -> tuple[Answer, int]:
    """One call with the retries that the budget still allows: (answer, attempts)."""
    if set(request.get("needs") or ()) - set(provider.capabilities):
        return Answer(kind="provider", reason="capability_missing"), 0
    attempts = 0
    while meter.may_call():
        try:
            answer = provider.complete(request, attempts)
        except Exception:  # a provider's own fault is an answer, whatever it is
            answer = Answer(kind="provider", reason="unexpected_error")
        if not isinstance(answer, Answer):
            answer = Answer(kind="provider", reason="invalid_response")
        meter.add(answer, attempts > 0)
        attempts += 1
        if answer.kind is None and request.get("json"):
            answer = checked(answer)
        if meter.over():
            break
        if answer.kind is None or not answer.retryable or not meter.may_retry():
            return answer, attempts
    return Answer(kind="budget", reason="budget_exhausted"), attempts


def checked(answer: Answer) -> Answer:
    """The answer where its text is a JSON object, else a parse failure of the same cost."""
    try:
        good = isinstance(json.loads(answer.text or ""), dict)
    except ValueError:
        good = False
    return answer if good else Answer(kind="parse", reason="invalid_json", tokens=answer.tokens, seconds=answer.seconds)


CALLS = "case_id string, call long, text string, kind string, reason string, attempts long, calls long, tokens long, retries long"


def ask_all(requests: DataFrame, provider: Callable[[], Provider], budget: Budget) -> DataFrame:
    """The calls of each case in order under its budget, with the usage so far. requests: case_id, call and what the
    provider reads; provider makes one in each task. Rows of a case meet in one task but are streamed, never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, case, meter = provider(), None, Meter(budget)
        for batch in batches:
            out = []
            for request in batch.to_dict("records"):
                if request["case_id"] != case:
                    case, meter = request["case_id"], Meter(budget)
                answer, attempts = ask(own, request, meter)
                out.append((case, request["call"], answer.text, answer.kind, answer.reason, attempts, meter.calls, meter.tokens, meter.retries))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

    return requests.repartition("case_id").sortWithinPartitions("case_id", "call").mapInPandas(run, CALLS)
