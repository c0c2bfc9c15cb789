"""The replay fold over a stream: the same state machine, fed event by event, its state kept by case.

Late or repeated events are refused with a code, as in the batch form; nothing is buffered or reordered. On the same
prefix the stream's last row of a case is the batch fold's row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import FIELDS, SCHEMA, CaseState, fold


def replay_stream(events: DataFrame, finals: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each case and trigger that touched it."""
    names = None if finals is None else set(finals)

    def update(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last, code, at = CaseState(names), None, None, None
        if held.exists:
            blob, last, code, at = held.get
            state = pickle.loads(blob)
        rows = pd.concat(list(parts)).sort_values("event_id", kind="stable").astype(object)
        rows = rows.where(rows.notna(), None).to_dict("records")
        if code is None and last is not None and rows[0]["event_id"] <= last:
            code, at = "event_order", rows[0]["event_id"]
        if code is None:
            state, code, at = fold(rows, names, state)
        last = max(last or "", rows[-1]["event_id"])
        held.update((pickle.dumps(state), last, code, at))
        yield pd.DataFrame([{"case_id": key[0], "as_of": last, "state": state.summary(), "error_code": code, "error_event": at}])

    return events.select(*FIELDS).groupBy("case_id").applyInPandasWithState(update, SCHEMA, "blob binary, last string, code string, at string", "update", GroupStateTimeout.NoTimeout)
