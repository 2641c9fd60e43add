"""Times the headline queries on local Spark and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ["flagship", "txfeatures", "agg4", "cln4", "gra3", "gra5a", "gra6", "gra10", "gra15", "rul_v", "clu2", "win9", "eva2"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from riskweave.plans.queries import QUERIES
    from riskweave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/events.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
