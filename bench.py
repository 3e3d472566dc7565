"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.
Every query is built and run to its last row and column, twice; the shorter time counts, as the
first run of a session also compiles. Names as arguments run only those.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries  # noqa: E402
from pluvia.session import local_session  # noqa: E402

HEADLINE = (
    "daily_sum brick_long last_n_issues consensus_reforecast consensus_operational "
    "consensus_realtime climatology_stats gamma_fit gamma_fit_bounded gamma_cdf quantile_map "
    "forecast_export contingency continuous_scores ecdf nearest_cell basin_mask idw_grid"
).split()


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start-up is not a query's time
    seconds = {}
    for name in names or HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries.registry()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "total_query_time", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
