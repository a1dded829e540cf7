"""Print the formatted physical plan of registered queries (default: the bench set).

    python scripts/show_plans.py [query ...]

Useful checks: `WindowGroupLimit ... Partial` below the first exchange of every
dedup; `Exchange rangepartitioning(IDEstudiante ..., Fecha ..., _rid ...)` for the
sweeps; `ReadSchema` listing only the columns a query uses; broadcasts only over
bounded tables (cluster levels, section counts, range offsets).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from tutorlens.plans.registry import REGISTRY  # noqa: E402
from tutorlens.session import get_spark  # noqa: E402


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]", 8)
    for name in sys.argv[1:] or [q for q in HEADLINE if q != "ml_kmeans"]:
        print(f"==================== {name} ====================")
        REGISTRY[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
