"""Benchmark the headline operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The school tables are derived from the driver's tables once and written in
their Parquet layout (the way a deployment holds them), then each operator
is run over the whole tables and executed in full through the ``noop``
sink (no collect).  Each operator runs ``BENCH_RUNS`` times (default 3); the
reported time is the median, the first (cold) run is listed separately.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollbook.catalog import AS_OF  # noqa: E402
from rollbook.operators import fees, lifecycle, marks  # noqa: E402
from rollbook.plans.registry_lifecycle import marks_batch, rollover  # noqa: E402
from rollbook.session import get_spark  # noqa: E402
from rollbook.sources.fixtures import derive_school  # noqa: E402
from rollbook.sources.store import read_school, write_school  # noqa: E402

HEADLINE = {
    "R1_fee_status": lambda s: fees.fee_status(s),
    "R2_defaulters": lambda s: fees.defaulters(s),
    "R5_class_wise_fees": lambda s: fees.class_wise_fees(s),
    "R8_fee_summary": lambda s: fees.fee_summary(s),
    "R8_fee_summary_as_written": lambda s: fees.fee_summary_as_written(s),
    "R15_accountant_dashboard": lambda s: fees.accountant_dashboard(s, AS_OF),
    "R16_class_performance": lambda s: marks.class_performance(s),
    "R17_top_students": lambda s: marks.top_students(s, None, 10),
    "W9_add_marks": lambda s: lifecycle.add_marks(s, marks_batch(s))[1],
    "W10_promote": lambda s: rollover(s)[0],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    scratch = tempfile.mkdtemp(prefix="run-bench-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))

    t0 = time.time()
    write_school(derive_school(spark, sf_dir), os.path.join(scratch, "school"))
    load = time.time() - t0
    s = read_school(spark, os.path.join(scratch, "school"))

    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times, cold = {}, {}
    for name, fn in HEADLINE.items():
        samples = []
        for _ in range(runs):
            t0 = time.time()
            fn(s).write.format("noop").mode("overwrite").save()
            samples.append(time.time() - t0)
        times[name] = round(statistics.median(samples), 3)
        cold[name] = round(samples[0], 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "runs": runs, "load_sec": round(load, 3), "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
