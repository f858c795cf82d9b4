"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``shape`` and ``derive`` are the two batch jobs whole, with every table they
write. The other entries are single operators over full tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leasegrain.plans import catalog
from leasegrain.plans.derive import results, score
from leasegrain.session import local_session, staged
from leasegrain.sources.order_listings import Workbench

OPERATORS = (
    "weighted_quantiles",
    "weighted_medians",
    "survival_curves",
    "response_records",
    "window_reconciliation",
    "selected_listings",
    "coverage_verdicts",
)
RESULTS = ("comps", "anchor", "buckets", "price_test", "neighbors", "horizons", "breakdown", "warnings")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    bench = Workbench(spark, folder)
    seconds: dict[str, float] = {}

    def timed(name: str, job):
        start = time.perf_counter()
        out = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    # one small query, so that no job pays for starting the session
    run(bench.requests())
    comps = timed("shape", lambda: staged(bench.shaped().comps, "comps"))
    Workbench._written[(spark.sparkContext.applicationId, folder, "comps")] = comps
    scored, medians = timed(
        "score", lambda: score(bench.requests(), comps, bench.weights(), bench.overrides())
    )

    def derive() -> None:
        tables = results(scored, medians, bench.requests(), comps)
        for name in RESULTS:
            run(tables[name])

    timed("derive", derive)
    for name in OPERATORS:
        timed(name, lambda: run(catalog.QUERIES[name](spark, folder)))

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "requests": bench.requests().count(),
                "pairs": scored.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
