"""Print the physical plans of the headline reports as a large deployment would get them.

    python tools/plans.py /path/to/school > plans.txt

The school tables are read from their Parquet layout (``write_school``).
Spark's automatic broadcast thresholds are switched off, so only the
size-checked broadcasts of ``rollbook.plans.dims`` remain — what the plan
looks like once facts and students are far beyond any broadcast size.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollbook.catalog import AS_OF  # noqa: E402
from rollbook.operators import fees, marks  # noqa: E402
from rollbook.session import get_spark  # noqa: E402
from rollbook.sources.store import read_school  # noqa: E402

REPORTS = {
    "R1 fee_status": lambda s: fees.fee_status(s),
    "R2 defaulters": lambda s: fees.defaulters(s),
    "R5 class_wise_fees": lambda s: fees.class_wise_fees(s),
    "R8 fee_summary": lambda s: fees.fee_summary(s),
    "R11 recent_transactions": lambda s: fees.recent_transactions(s, 50),
    "R15 accountant_dashboard": lambda s: fees.accountant_dashboard(s, AS_OF),
    "R16 class_performance": lambda s: marks.class_performance(s),
    "R17 top_students": lambda s: marks.top_students(s, None, 10),
}


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    return "\n".join(line for line in text.splitlines() if line.strip())


def main() -> None:
    spark = get_spark()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    s = read_school(spark, sys.argv[1])
    for name, fn in REPORTS.items():
        print(f"### {name}\n\n```")
        print(tree(fn(s)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
