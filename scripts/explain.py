"""Print the formatted physical plan of registered jobs.

    python scripts/explain.py [sf_dir] J05 J12 ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans.catalog import QUERIES  # noqa: E402
from tillroll.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1]
    spark = build_session(master="local[8]", shuffle_partitions=16)
    for name in QUERIES:
        if any(name.startswith(p) for p in sys.argv[2:]):
            print("=" * 30, name)
            QUERIES[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
