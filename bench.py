"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through a full write of its rows to the no-op sink; the first run of the session warms up
on the flagship. The value is the sum over queries.
"""

from __future__ import annotations

import json
import os
import time

from citeplane.session import local_session
from citeplane.plans.queries import QUERIES

HEADLINE = ("ground_exact", "ground_failures", "content_ids", "section_innermost", "span_prf_strict", "span_prf_lenient", "binary_measures", "label_tallies", "regression_compare", "support_closure", "integrity_violations", "visible_events", "status_machine", "replay_full", "policy_decisions", "rule_derive", "pii_scan", "content_hash")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    took: dict[str, float] = {}
    for warm in (True, False):
        for name in HEADLINE[: 1 if warm else None]:
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
