"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestry.plans import catalog  # noqa: E402
from attestry.session import env_cores, local_session  # noqa: E402

# One or two per job: ingest, contacts, graph, sites, evidence, calibration,
# freshness, queue and streams.
HEADLINE = ("s02", "p27", "a04", "j12", "g03", "g04", "w01", "w06", "p04", "j01", "j04", "e02",
            "e05", "a08", "e06", "a01", "a03", "w07", "a09", "p40", "w10", "st2", "st4")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(env_cores(), app="bench", memory="20g",
                          shuffle_partitions=2 * env_cores())
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.load()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.runner(known[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
