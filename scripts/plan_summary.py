"""Summarise the physical plan of every registered job as a Markdown table:
shuffle exchanges, broadcast exchanges, joins by type, windows and
WindowGroupLimit.  The counts are from the plan before adaptive re-planning
(AQE may still turn a shuffle join into a broadcast join at run time).

    python scripts/plan_summary.py /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans.catalog import QUERIES  # noqa: E402
from tillroll.session import build_session  # noqa: E402


def summary(plan: str) -> dict[str, str]:
    shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    kinds = {}
    for k in shuffles:
        kinds[k] = kinds.get(k, 0) + 1
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r"[^\n]*?\b(Inner|LeftOuter|LeftSemi|LeftAnti|RightOuter|FullOuter|Cross)\b", plan)
    jtext = ", ".join(sorted({f"{a.replace('Join', '')} {b}" for a, b in joins})) or "-"
    return {
        "shuffles": str(len(shuffles)),
        "by": ", ".join(f"{v} {k.replace('partitioning', '').replace('Partitioning', '')}" for k, v in
                        sorted(kinds.items())) or "-",
        "broadcasts": str(plan.count("BroadcastExchange")),
        "joins": jtext,
        "window": ("WindowGroupLimit" if "WindowGroupLimit" in plan else
                   ("Window" if re.search(r"\bWindow\b", plan) else "-")),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=16)
    print("# Physical plans of the registered jobs\n")
    print(f"Generated by `scripts/plan_summary.py` on `{sf_dir}`; static plans before adaptive re-planning,")
    print("so a shuffle join may still become a broadcast at run time when its side is small.")
    print("Scalar subqueries list their exchanges too.  In jobs with a surrogate key (J14, J40-J42, J49 paths)")
    print("splitters and offsets read the counted rows from their exchange in the final adaptive plan")
    print("(`ReusedExchange`; `tests/test_keys.py` counts the rows evaluated).  A total over another column")
    print("(J53-J56) is a scan of its own of that column.\n")
    print("| job | shuffles | by | broadcasts | joins | window |")
    print("|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summary(plan)
        print(f"| {name} | {s['shuffles']} | {s['by']} | {s['broadcasts']} | {s['joins']} | {s['window']} |")
    spark.stop()


if __name__ == "__main__":
    main()
